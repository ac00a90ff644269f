"""JSON ends, rewards by provenance, validators and selections, against values made by hand or walks in plain Python."""

import hashlib
import itertools
import json
import random

import pytest
from lodestone.functions import json as J
from lodestone.operators import rewards as W
from lodestone.operators import selection as S
from lodestone.operators import validators as V
from pyspark.sql import functions as F


@pytest.mark.parametrize(("text", "end"), [
    ('{"a": {"b": [1, "}"]}} tail', 22), ('  {"a":1}{"b":2}', 9), ('{"a": "\\"}"}', 12), ("{}", 2), ('{"a": [}', None), ('{"a": "open', None), ("[1]", None), ("", None), (None, None), ("{bad}", 5), ('{"é": "]"} x', 10),
])
def test_object_end(text, end):
    assert J.object_end(text) == end


def test_objects_and_titles(spark):
    rows = [('{"a": {"b": 1}} ', True), ('{"a": 1} x', False), ("{bad}", False), (None, False), ("[]", False)]
    df = spark.createDataFrame(rows, "t string, w boolean")
    assert all(r["g"] == r["w"] for r in df.select("w", J.is_object(F.col("t")).alias("g")).collect())
    keys = spark.createDataFrame([("Łódź & Café -- No. 1",), ("ﬁne  ÀB",), (None,), ("ß",)], "t string").select(J.title_key(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in keys] == ["odz cafe no 1", "fine ab", None, ""]


def test_rewards_by_provenance(spark):
    row = ("Paris", "  PARIS ", ["it is Paris, France"], "answer", 2, ["A", "b"], ["a"], 1, 0)
    other = ("no", "no idea", None, "max_steps", 0, [], [], 0, 0)
    schema = "answer string, final_answer string, observations array<string>, reason string, searches int, support_titles array<string>, found_titles array<string>, over_steps int, empty_searches int"
    stored = {"v096": W.provenance(), "v098": W.provenance("v098-answer-v1", over_search=0.0, evidence_stop=0.3, incomplete=-0.15), "v102": W.provenance("v102-oversearch-zero"), "odd": '{"Mystery": {}}', "bare": '{"ExactMatchReward": 1}', "none": "{}", "broken": "{", "weight": '{"ExactMatchReward": {"weight": 2}}'}
    df = spark.createDataFrame([row, other], schema).crossJoin(spark.createDataFrame(list(stored.items()), "name string, stored string"))
    got = {(r["final_answer"], r["name"]): r["total"] for r in df.select("final_answer", "name", F.round(W.total(F.col("stored")), 6).alias("total")).collect()}
    paris, idea = row[1], other[1]
    assert got[paris, "v096"] == round(1 + 0.2 + 0.1 - 0.06 - 0.2, 6) and got[paris, "v098"] == round(1 + 0.2 + 0.1 - 0.06 - 0.15, 6)
    assert got[idea, "v096"] == round(-0.25 - 0.1, 6) and got[idea, "v098"] == round(-0.25 - 0.1, 6)
    assert [got[paris, n] for n in ("v102", "odd", "bare", "none", "broken")] == [None] * 5 and got[paris, "weight"] == 2.0
    with pytest.raises(ValueError):
        W.provenance("v1")


def _errors(spark, raws, column):
    return [r["e"] for r in spark.createDataFrame([(x,) for x in raws], "raw string").select(column.alias("e")).collect()]


def test_candidates(spark):
    registry = F.array(F.lit("s1"), F.lit("s2"))
    raws = [{"candidates": [{"answer": "x", "evidence_ids": ["s1"]}]}, {"candidates": [{"answer": " ", "evidence_ids": []}, {"answer": 3, "evidence_ids": ["s1", "s1", "s9"], "more": 1}]}, {"candidates": "no"}, [1], {"candidates": [{}] * 5, "x": 1}, {"candidates": []}]
    got = _errors(spark, map(json.dumps, raws), V.candidate_errors(F.col("raw"), registry))
    assert got == [
        [], ["candidate_0:answer_invalid", "candidate_0:missing_evidence", "candidate_1:unexpected_fields", "candidate_1:answer_invalid", "candidate_1:evidence_1:duplicate", "candidate_1:evidence_2:unknown_or_stale"],
        ["candidates_list_required_or_too_long"], ["object_required", "candidates_list_required_or_too_long"], ["unexpected_fields", "candidates_list_required_or_too_long"], [],
    ]
    many = json.dumps({"candidates": [{"answer": "x", "evidence_ids": ["s1"] * 65}]})
    assert _errors(spark, [many], V.candidate_errors(F.col("raw"), registry)) == [["candidate_0:evidence_ids_list_required_or_too_long"]]


def test_selections(spark):
    registry, ids = F.array(F.lit("s1")), F.array(F.lit("a"), F.lit("b"))
    one = lambda d, c, e: json.dumps({"decision": d, "candidate_id": c, "evidence_ids": e})
    got = _errors(spark, [one("select", "a", ["s1"]), one("select", "z", []), one("abstain", None, []), one("abstain", "a", ["s1"]), one("maybe", None, []), "7"], V.selection_errors(F.col("raw"), ids, registry))
    assert got == [[], ["unknown_candidate", "missing_evidence"], [], ["abstain_requires_null_id_empty_evidence"], ["decision_invalid"], ["object_required"]]


def test_reviews_and_decisions(spark):
    registry = F.array(F.lit("s1"))
    say = lambda i, s, e=("s1",): {"id": i, "status": s, "reason": "because", "evidence_ids": list(e)}
    whole = lambda *a, **k: json.dumps({"assessments": list(a), "information_gap": "", "queries": []} | k)
    raws = [
        whole(say("original", "supported"), say("selected", "supported")), whole(say("original", "insufficient", ()), say("selected", "supported")), whole(say("original", "supported", ()), say("selected", "supported")),
        whole(say("original", "supported"), queries=["a", "b", "c"]), "null",
    ]
    checked = V.review(F.col("raw"), ("original", "selected"), registry)
    d = V.decided(F.lit("o"), F.lit("s"), checked)
    got = spark.createDataFrame([(x,) for x in raws], "raw string").select(checked["errors"].alias("e"), d["answer"].alias("answer"), d["status"].alias("status")).collect()
    assert [(r["answer"], r["status"]) for r in got] == [("o", "preserve_supported_original"), ("s", "selected_supported"), ("o", "fallback_original"), ("o", "preserve_supported_original"), ("o", "fallback_original")]
    assert [r["e"] for r in got][:3] == [[], [], ["original:missing_evidence"]] and got[3]["e"] == ["queries_invalid", "selected:missing_or_duplicate_assessment"] and got[4]["e"][0] == "object_required"


def test_training_rows_and_frozen_sets(spark):
    good = [("system", "s"), ("user", "u"), ("assistant", '{"action": "search", "query": "q"}'), ("tool", "{}"), ("assistant", '{"action": "answer", "answer": {"x": 1}}')]
    rows = [(good, "g"), (good[:3], ""), ([*good[:2], ("assistant", "no"), good[3], ("assistant", '{"action": "run"}')], None), ([], "g")]
    got = spark.createDataFrame(rows, "messages array<struct<role:string,content:string>>, gold string").select(V.training_row_errors(F.col("messages"), F.col("gold")).alias("e")).collect()
    assert [r["e"] for r in got] == [[], ["five_turns_required", "assistant_4:not_json", "gold_answer_missing"], ["assistant_2:not_json", "assistant_4:illegal_action", "gold_answer_missing"], ["five_turns_required"]]
    cases = spark.createDataFrame([(f"{t}-{c}", c) for t in range(30) for c in V.CONDITIONS], "case_id string, condition string")
    assert tuple(V.frozen_cases(cases).first())[1:] == (True, True, True) and tuple(V.frozen_cases(cases.filter("condition <> 'one_hop'")).first())[1:] == (False, False, True)
    assert V.archive_errors(["a/b.txt", "A/B.txt", "../x", "/y", "c:z", "Holdout/q", "d/", "e\\f"]) == ["duplicate_archive_member:A/B.txt", "forbidden_archive_member:../x", "forbidden_archive_member:/y", "forbidden_archive_member:c:z", "forbidden_archive_member:Holdout/q"]


def _hash(seed, key):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


def test_balanced_like_a_walk(spark):
    r = random.Random(3)
    rows = [(i, r.sample(["a", "b", "c", "d"], r.randrange(3))) for i in range(120)]
    minima, count = {"d": 9, "a": 6, "b": 20}, 40
    order = sorted(rows, key=lambda x: (_hash("z", x[0]), x[0]))
    taken: list = []
    for label, least in minima.items():
        while sum(label in own for _, own in taken) < least and len(taken) < count:
            found = next((x for x in order if x not in taken and label in x[1]), None)
            if found is None:
                break
            taken.append(found)
    taken += [x for x in order if x not in taken][: count - len(taken)]
    df = spark.createDataFrame(rows, "id long, labels array<string>").repartition(4)
    got = S.balanced(df, "id", "labels", "z", count, minima).orderBy("place").collect()
    assert [x["id"] for x in got] == [i for i, _ in taken]
    assert [x["id"] for x in S.uniform_sample(df, "id", "z", 10).collect()] == [i for i, _ in order[:10]]


def test_disjoint_like_a_walk(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(20), r.choice("xyz"), r.sample(range(60), r.randrange(0, 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, o long, c string, e array<long>")
    used, want = set(), []
    for i, _, _, own in sorted(rows, key=lambda x: (x[1], x[0])):
        if own and not used & set(own):
            used |= set(own)
            want.append(i)
    assert sorted(x["id"] for x in S.disjoint_rounds(df, "id", "o", "e").collect()) == sorted(want)
    assert S.disjoint_rounds(df.limit(0), "id", "o", "e").count() == 0
    used, room, want = {7}, {"x": 5, "y": 2}, []
    for i, _, c, own in sorted(rows, key=lambda x: (x[1], x[0])):
        if room.get(c, 0) and not used & set(own):
            room[c] -= 1
            used |= set(own)
            want.append(i)
    got = S.quota_disjoint(df.withColumn("s", F.lit("one")), "s", "o", "id", "c", "e", {"x": 5, "y": 2}, frozenset({7})).orderBy("place").collect()
    assert [x["id"] for x in got] == want


def test_first_feasible_like_all_subsets(spark):
    r = random.Random(6)
    for _ in range(40):
        risks = [{k: r.randrange(3) for k in "ab"} for _ in range(8)]
        need, count = {"a": r.randrange(5), "b": r.randrange(6)}, r.randrange(1, 5)
        want = next((list(c) for c in itertools.combinations(range(8), count) if all(sum(risks[i][k] for i in c) >= n for k, n in need.items())), None)
        assert S.first_feasible(risks, count, need) == want
    df = spark.createDataFrame([("s", i, ["a"] if i % 3 == 0 else ["b", "b"]) for i in range(6)] + [("t", 9, ["a"])], "s string, i long, l array<string>")
    assert [x["i"] for x in S.risk_subsets(df, "s", "i", "i", "l", 3, {"a": 2, "b": 2}).orderBy("i").collect()] == [0, 1, 3]


def test_smallest_cohort_and_bounded_scans(spark):
    r = random.Random(8)
    rows = [(i, r.sample(["a", "b", "c"], r.randrange(1, 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, labels array<string>")
    gates = {"a": 9, "b": 9, "c": 9}
    chosen = S.smallest_cohort(df, "id", "labels", "s", gates, range(4, 40, 3))
    own = dict(rows)
    reached = lambda ids: all(sum(g in own[i] for i in ids) >= n for g, n in gates.items())
    ids = [x["id"] for x in chosen.collect()]
    assert reached(ids) and len(ids) == len(set(ids))
    assert not any(reached([x["id"] for x in S.balanced(df, "id", "labels", "s", n, gates).collect()]) for n in range(4, len(ids), 3))
    assert S.smallest_cohort(df, "id", "labels", "s", {"a": 61}, range(4, 40, 9)) is None
    one = df.coalesce(1).orderBy("id")
    assert [x["id"] for x in S.bounded_scan(one, F.array_contains("labels", "a"), 5, 20).orderBy("id").collect()] == [i for i, x in rows[:20] if "a" in x][:5]


def test_text_queries_by_hand(spark):
    import unicodedata

    from lodestone.operators import datasets as D

    texts = ["Ｆｕｌｌ width  Äpfel_und ß!", "full WIDTH äpfel und SS", None, "①②"]
    got = {r["i"]: r["question_key"] for r in D.nfkc_key(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t").collect()}
    plain = lambda x: " ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKC", x or "").casefold()).split())
    assert got == {i: plain(t) for i, t in enumerate(texts)} and got[0] == got[1]
    body, quote = "the quick brown fox jumps over the lazy dog", "quikc brown fox jumps"
    (found,) = D.quote_repairs(spark.createDataFrame([(1, quote, body)], "id long, quote string, body string")).collect()
    best = max(range(len(body) - len(quote) + 1), key=lambda at: sum(a == b for a, b in zip(body[at : at + len(quote)], quote, strict=True)))
    assert found["start"] == best and found["found"] == body[best : best + len(quote)] and 0.8 < found["ratio"] < 1


def test_review_pools(spark):
    rows = [(1, "x", 0, "reject", ["a"]), (1, "x", 1, "approve", ["a", "b"]), (1, "y", 0, "approve", ["b", "c"]), (2, "x", 0, "approve", ["a"]), (3, "x", 0, "approve", []), (3, "y", 0, "reject", ["a"])]
    got = S.review_pool(spark.createDataFrame(rows, "id long, reviewer string, attempt int, verdict string, labels array<string>")).orderBy("id").collect()
    assert [(r["approved"], r["labels"]) for r in got] == [(True, ["b"]), (False, None), (False, None)]
