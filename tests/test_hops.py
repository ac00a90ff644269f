import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import pytest
from lodestone.functions.text import STOPWORDS
from lodestone.operators import context as C
from lodestone.operators import hops as H
from lodestone.operators import selection as S
from pyspark.sql import functions as F

norm = lambda x: re.sub(r"[ \t\n\r\f\x0B]+", " ", (x or "").lower()).strip(" ")


class Bm25:
    """The ranking formula walked plainly: a title counts three times, ties go to the smaller id."""

    def __init__(self, docs):
        self.docs = docs
        toks = lambda x: [t for t in re.findall("[a-z0-9]+", x.lower()) if t not in STOPWORDS and len(t) >= 2]
        self.toks = toks
        self.counts = {i: Counter(toks(title) * 3 + toks(text)) for i, title, text in docs}
        self.size = {i: sum(c.values()) for i, c in self.counts.items()}
        self.mean = sum(self.size.values()) / max(1, len(docs))
        self.df = Counter(t for c in self.counts.values() for t in c)
        self.seen = {}

    def search(self, query, k=3):
        if query not in self.seen:
            terms, n, scores = set(self.toks(query)), len(self.docs), []
            for i, c in self.counts.items():
                s = sum(math.log(1 + (n - self.df[t] + 0.5) / (self.df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * self.size[i] / self.mean)) for t in terms if t in c)
                if s > 0:
                    scores.append((-round(s, 9), i))
            self.seen[query] = [i for _, i in sorted(scores)[:k]]
        return self.seen[query]


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["amber", "basin", "cedar", "delta", "ember", "fjord", "grove", "haven", "islet", "jetty", "knoll", "lagoon", "marsh", "north", "orchard", "prairie"]
    titles = [f"{a.title()} {b.title()} {i}" for i, (a, b) in zip(range(n), itertools.cycle(itertools.product(words, words)))]
    out = []
    for i in range(n):
        body = ". ".join(" ".join(r.choices(words, k=7)).capitalize() + f" number {r.randrange(40)}" for _ in range(4))
        out.append((f"d{i:03d}", titles[i], f"{body}. It lies near {titles[(i * 7 + 3) % n]} and beyond. The record of {titles[i]} holds item {i * 13 % 97}."))
    return out


def variants(question):
    """The query variants by their definition."""
    found = [question]
    for p in re.findall(H.PHRASE, question):
        if len(p) >= 5 and p.lower() not in H.OPENERS:
            found += [p, f"{question} {p}"]
    clause, clauses = [], []
    for w in re.split("[ \t\n]+", question):
        if w.lower() in H.CONJUNCTIONS:
            clauses, clause = [*clauses, clause], []
        else:
            clause.append(w)
    found += [c for c in (" ".join(c).strip(" ?.,") for c in [*clauses, clause]) if len(c) >= 12]
    content = [w for w in re.findall(H.WORD, question) if len(w) >= 3 and w.lower() not in H.FILLERS]
    for n in (2, 3, 4):
        found += [" ".join(content[i : i + n]) for i in range(len(content) - n + 1)]
    return list({norm(q): q for q in reversed(found + content) if norm(q)}.items())[::-1]


def walk(question, facts, index):
    """The greedy path of one question, hop by hop."""
    docs = {i: (title, text) for i, title, text in index.docs}
    closed = lambda ids: {f for f in facts if any(docs[i][0] == f[0] and f[1] in docs[i][1] for i in ids)}
    runs = [(closed(index.search(q)), q, key) for key, q in variants(question)]
    runs = [x for x in runs if x[0]]
    partial = sorted((x for x in runs if len(x[0]) < len(facts)), key=lambda x: (-len(x[0]), len(x[1]), x[2]))[:4]
    full = sorted((x for x in runs if len(x[0]) == len(facts)), key=lambda x: (len(x[1]), x[2]))[:1]
    best = None
    for place, (have, q, key) in [*enumerate(partial, 1), *enumerate(full, 5)]:
        queries, used, ids, have = [q], {key}, list(index.search(q)), set(have)
        for _ in range(4):
            if len(have) == len(facts):
                break
            options, keys = [], set()
            for i in ids:
                title, text = docs[i]
                sentences = [s.strip(" \t\n") for s in re.split(r"(?<=[.!?])[ \t\n]+", text)]
                for seed in [title, *[s for s in sentences if len(s) >= 24][:4]]:
                    for form in (seed, f"{question} {seed}".strip(" ")):
                        if norm(form) and norm(form) != norm(question) and norm(form) not in used | keys:
                            keys.add(norm(form))
                            options.append(form[:500])
            scored = [(len(closed(set(index.search(o)) - set(ids)) - have), -len(o), o) for o in options[:56]]
            scored = [x for x in scored if x[0]]
            if not scored:
                break
            o = max(scored)[2]
            new = [i for i in index.search(o) if i not in ids]
            queries, used, ids, have = [*queries, o], used | {norm(o)}, ids + new, have | closed(new)
        mine = (len(have), -len(queries), -place, queries)
        best = mine if best is None else max(best, mine)
    return (len(facts), best[0], best[3]) if best else (len(facts), 0, None)


def test_oracle_paths_like_a_walk(spark):
    docs = corpus(200)
    r = random.Random(5)
    questions, facts = [], []
    for q in range(12):
        picked = r.sample(docs, r.choice([1, 2, 3]))
        questions.append((q, f"Which item and number does the record of {picked[0][1]} hold or {r.choice(docs)[1]} name near the {r.choice(['amber', 'fjord'])}?"))
        linked = docs[(docs.index(picked[0]) * 7 + 3) % 200]
        facts += [(q, d[1], d[2].split(". ")[-1]) for d in [picked[0], linked, *picked[1:]]]
    questions += [(90, "Nothing"), (91, None)]
    facts += [(90, docs[3][1], "no such sentence stands there"), (91, docs[3][1], docs[3][2]), (0, *facts[0][1:])]
    frames = spark.createDataFrame(questions, "qid long, question string"), spark.createDataFrame(docs, "id string, title string, text string"), spark.createDataFrame(facts, "qid long, title string, quote string")
    index = Bm25(docs)
    got = {x["qid"]: (x["n_facts"], x["n_closed"], x["queries"]) for x in H.oracle_paths(*frames).collect()}
    want = {q: walk(text, {f[1:] for f in facts if f[0] == q}, index) if text else (1, 0, None) for q, text in questions}
    assert got == want
    assert any(x[2] and len(x[2]) > 1 for x in got.values())


def test_titles_anywhere(spark):
    texts = [(1, "x", "We saw the Old Mill Road, then (old mill) and OLD  MILL road again. Nothing of it!"), (2, "y", None), (3, "z", "")]
    titles = [("1", "Old Mill Road"), ("2", "Old Mill"), ("3", "old mill"), ("4", ""), ("5", None), ("6", "Nothing of it else"), ("7", "mill-road")]
    keys = H.title_keys(spark.createDataFrame(titles, "id string, title string"))
    got = {(x["n"], x["title_key"], x["place"], x["title"]) for x in H.mentioned(spark.createDataFrame(texts, "n long, place2 string, text string"), keys).collect()}
    assert got == {(1, "old mill road", 3, "Old Mill Road"), (1, "old mill", 3, "Old Mill"), (1, "mill road", 4, "mill-road")}
    assert H.mentioned(spark.createDataFrame(texts, "n long, p string, text string"), keys.limit(0)).collect() == []


def fold(rows, quotas):
    room, used, out = dict(quotas), set(), []
    for i, c, e in sorted(rows):
        if room.get(c, 0) and used.isdisjoint(e):
            room[c] -= 1
            used |= set(e)
            out.append(i)
    return out


@pytest.mark.parametrize("n, pool", [(2000, 4000), (300, 12)])
def test_quota_rounds_like_the_fold(spark, n, pool):
    r = random.Random(n)
    rows = [(i, r.choice("abc"), r.sample(range(pool), r.randrange(0, 4))) for i in range(n)]
    df = spark.createDataFrame([("s", *x) for x in rows], "s string, i long, c string, e array<long>")
    quotas = {"a": 40, "b": 7, "d": 3}
    got = [x["i"] for x in S.quota_disjoint(df, "s", "i", "i", "c", "e", quotas).orderBy("place").collect()]
    assert got == fold(rows, quotas)


def test_first_sets_of_large_shards(spark):
    rare = {70_001: "b", 99_998: "b", 99_999: "b"}
    risks = [{"a": 1} if i % 5 == 0 else {rare[i]: 1} if i in rare else {} for i in range(100_000)]
    began = time.time()
    assert S.first_feasible(risks, 6, {"a": 2, "b": 3}) == [0, 1, 5, 70_001, 99_998, 99_999]
    assert S.first_feasible(risks, 6, {"a": 2, "b": 4}) is None
    assert time.time() - began < 5
    df = spark.range(100_000).select(F.lit("s").alias("s"), F.col("id").alias("i"), F.when(F.col("id") % 5 == 0, F.array(F.lit("a"))).when(F.col("id").isin(*rare), F.array(F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("l"))
    assert [x["i"] for x in S.risk_subsets(df, "s", "i", "i", "l", 6, {"a": 2, "b": 3}).orderBy("i").collect()] == [0, 1, 5, 70_001, 99_998, 99_999]


def test_replay_of_a_sealed_set(spark):
    rows = [(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c"]), (4, ["c", "d"]), (5, ["e", "f"]), (6, ["g", "h"])]
    df = spark.createDataFrame([(i, i, e) for i, e in rows], "i long, o long, e array<string>")
    digest = hashlib.sha256(b"1\n4\n5").hexdigest()
    assert [tuple(x) for x in S.replayed(df, "i", "o", "e", 3, 5, digest).orderBy("place").collect()] == [(1, 1, digest), (2, 4, digest), (3, 5, digest)]
    with pytest.raises(ValueError, match="digest_mismatch"):
        S.replayed(df, "i", "o", "e", 3, 6, "0" * 64)
    with pytest.raises(ValueError, match="3_rows_of_4"):
        S.replayed(df, "i", "o", "e", 4, 5)


def test_budgets_by_hand(spark):
    long = "One two three. " + "word " * 60 + "end. "
    messages = spark.createDataFrame([(1, 0, "system", "be brief"), (1, 1, "user", "why is it so"), (1, 4, "assistant", "look"), (2, 0, "user", "no system"), (3, 0, "system", "x " * 100), (3, 1, "user", "y"), (4, 0, "system", "s"), (4, 1, "user", "u"), (5, 0, "system", "s"), (5, 1, "user", "u")], "case long, at long, role string, content string")
    shown = spark.createDataFrame([(1, 2, 1, "a", "T", long), (1, 2, 2, "b", "T", "Short one."), (1, 5, 1, "a", "T", long), (1, 5, 2, "a", "T", "Another text."), (4, 2, 1, "a", "T", "nosentence " * 90), (5, 2, 1, None, None, None)], "case long, at long, rank int, id string, title string, text string")
    result = {e: {x["case"]: x for x in C.context_budget(messages, shown, 60, e).collect()} for e in C.LADDERS}
    for e, found in result.items():
        assert found[2]["failure"] == "no_system_or_question" and found[3]["failure"] == "mandatory_over_budget"
        assert (found[4]["failure"] is None) == (e == "legacy")  # only the legacy ladder deletes
        assert (found[5]["stage"], found[5]["tokens"]) == ("none", 4 * 3 + 2 + 4)
        assert found[1]["original"] == 7 + 4 * 5 + 2 * (64 + 6) + 8 + 8 and found[1]["tokens"] <= 60
    first = {e: (x[1]["step"], x[1]["trimmed"], x[1]["references"], x[1]["conflicts"], x[1]["deleted"]) for e, x in result.items()}
    # the long text has 320 characters, so a cap of 320 leaves it whole; without references 61 tokens are left until a rank goes
    assert first == {"legacy": (7, 2, 0, 0, 2), "compact-v1": (1, 1, 1, 0, 0), "compact-v2": (2, 1, 1, 1, 0), "compact-v3": (6, 1, 1, 1, 0)}


def test_last_visible_needs_certainty(spark):
    kind = "case long, step long, context struct<presentation:string,document_changes:array<struct<document_id:string,original_text:string,visible:boolean,deleted:boolean,visible_segments:array<array<int>>>>,observation_encoding:string,truncation_stage:string,documents_deleted:long,prompt_truncated:boolean,lossy_body_trimmed:boolean,history_dropped:boolean,context_budget_error:boolean>, result array<struct<id:string,text:string>>"
    flags = ("legacy", "none", 0, False, False, False, False)
    saved = [("d", "abcdef", True, False, [[0, 2], [4, 9]]), ("e", None, False, False, None), ("f", "gone", True, True, [[0, 4]]), ("d", "xyz", True, None, [[1, 2]])]
    rows = [(1, 0, None, [("old", "seen")]), (1, 1, (None, saved, *flags), None), (2, 0, None, [("a", "one"), ("b", None)]), (2, 1, None, [("a", "two")]), (2, 2, (None, [], *flags), [("a", "unseen")]), (3, 0, (None, [], *flags[:3], None, *flags[4:]), None), (4, 0, None, None), (5, 0, (None, [("d", "t", True, False, [[0, None]])], *flags), None)]
    got = {x["case"]: (x["reason"], x["documents"] and [(d["id"], d["texts"]) for d in x["documents"]]) for x in C.last_visible(spark.createDataFrame(rows, kind)).collect()}
    assert got == {
        1: ("saved_document_changes_visible_segments", [("d", ["ab", "ef", "y"])]), 2: ("explicit_legacy_no_truncation_all_prior_tools_retained", [("a", ["one", "two"])]), 3: ("last_input_visibility_not_certified_by_saved_metadata", None),
        4: ("no_saved_model_input", None), 5: ("invalid_visible_segment_metadata", None),
    }


def test_exposed_at_any_depth(spark):
    a, b = "0123456789abcdef01234567", "f" * 24
    rows = [(1, f'[[{{"x": {{"id": "{a.upper()}", "question": " Why  So "}}}}, "id"], {{"qid": 7, "source_id": "set-{b}", "deep": [[[{{"task_id": "{a}z"}}]]]}}]'), (2, "not json"), (3, None), (4, '"id"'), (5, "{}"), (6, f'{{"question": {{"question": "in"}}, "id": ["{a}"]}}')]
    got = {tuple(x) for x in C.exposed(spark.createDataFrame(rows, "source long, raw string")).collect()}
    assert got == {(1, "id", a), (1, "question", "why so"), (1, "id", b), (6, "question", "in")}
    assert C.exposed(spark.createDataFrame([], "source long, raw string")).collect() == []


@pytest.mark.parametrize("most", [1, 2, 20_000])
def test_passages_in_blocks(spark, most):
    from lodestone.operators import retrieval as R

    docs = [("a", "one two three"), ("b", None), ("c", ""), ("d", "two")]
    passages = [(1, "two"), (2, "two three"), (3, ""), (4, None), (5, "two"), (6, "absent")]
    got = R.holding(spark.createDataFrame(docs, "id string, body string"), spark.createDataFrame(passages, "qid long, passage string"), most)
    assert sorted((x["qid"], x["id"]) for x in got.collect()) == sorted((q, i) for q, p in passages for i, b in docs if p is not None and b is not None and p in b)
    assert R.holding(spark.createDataFrame(docs, "id string, body string"), spark.createDataFrame([], "qid long, passage string"), most).collect() == []


def test_null_quotes(spark):
    from lodestone.operators import datasets as D

    got = D.quote_repairs(spark.createDataFrame([(1, None, "x"), (2, "q", None), (3, "bc", "abcd")], "id long, quote string, body string")).orderBy("id").collect()
    assert [tuple(x) for x in got] == [(1, None, None, None), (2, None, None, None), (3, 1, "bc", 1.0)]


def cohort(rows, sizes, n_sources, least_share, most_share, least_labels):
    """The cohort by its own walk over all rows."""
    h = lambda part, x: hashlib.sha256(f"t-{part}:{x}".encode()).hexdigest()
    for size in sizes:
        floor = {c: math.ceil(size * p / 100) for c, p in least_share.items()}
        taken, kinds, have = [], Counter(), Counter()
        lack = lambda r: (r[2] in floor and kinds[r[2]] < floor[r[2]]) + sum(have[x] < least_labels[x] for x in set(r[3]) & least_labels.keys())  # noqa: B023, E731
        sources = sorted({r[1] for r in rows}, key=lambda s: h("source", s))[:n_sources]
        for s in sources:
            taken.append(max((r for r in rows if r[1] == s), key=lambda r: (lack(r), h("pick", r[0]))))
            kinds[taken[-1][2]] += 1
            have.update(set(taken[-1][3]))
        if len(sources) < n_sources or len(taken) > size:
            continue
        while len(taken) < size and len(taken) < len(rows):
            taken.append(max((r for r in rows if r not in taken), key=lambda r: (lack(r), h("fill", r[0]))))
            kinds[taken[-1][2]] += 1
            have.update(set(taken[-1][3]))
        if len(taken) == size and all(kinds[c] / size >= p / 100 for c, p in least_share.items()) and all(kinds[c] / size <= p / 100 for c, p in most_share.items()) and all(have[x] >= n for x, n in least_labels.items()):
            return [r[0] for r in taken]
    return []


@pytest.mark.parametrize("sizes, gates", [(range(10, 40), {"a": 9, "b": 12, "c": 5}), (range(20, 21), {"a": 5}), (range(5, 8), {}), (range(10, 30), {"a": 400})])
def test_cohort_like_its_walk(spark, sizes, gates):
    r = random.Random(11)
    rows = [(i, r.randrange(60), r.choice(["x", "x", "y", "z"]), r.sample("abcd", r.randrange(3))) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, s long, c string, l array<string>")
    got = [x["i"] for x in S.deficit_cohort(df, "i", "s", "c", "l", "t", sizes, 10, {"x": 30, "y": 25}, {"z": 30}, gates).orderBy("place").collect()]
    assert got == cohort(rows, sizes, 10, {"x": 30, "y": 25}, {"z": 30}, gates)
    assert bool(got) == (gates != {"a": 400} and sizes.stop > 10)


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def test_token_spans_read_back(spark):
    """Bodies with quotes, backslashes, line ends, JSON of their own and repeated texts; tokens by the plain overlap rule."""
    import json

    from tokenizers import Tokenizer

    bodies = ['say "hi" \\ there', "line\nend\ttab", '"text":"fake"},{"id":"x', "", "é😀 naïve", "say \"hi\" \\ there", " lead", None]
    messages = spark.createDataFrame([(1, 0, "system", "Read <|endoftext|> this."), (1, 9, "user", None), (2, 0, "user", "none shown")], "case long, at long, role string, content string")
    shown = spark.createDataFrame([(1, 2 + i // 3, i % 3, f'd"{i}', b) for i, b in enumerate(bodies)], "case long, at long, rank int, id string, text string")
    inputs = C.rendered(messages, shown)
    text = {x["case"]: x["text"] for x in inputs.collect()}
    got = C.token_spans(inputs, C.byte_pairs(VOCABULARY)).orderBy("start").collect()
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    offsets = own.encode(text[1], add_special_tokens=False).offsets
    assert text[1].startswith("<|system|>\nRead") and len(got) == len(bodies)
    tool = text[1].split("<|tool|>\n")[1]
    assert [d["text"] for d in json.loads(tool)["result"]] == bodies[:3]
    for i, x in enumerate(got):
        body = text[1][x["start"] : x["end"]]
        assert x["body"] == body and json.loads(f'"{body}"') == (bodies[i] or "") and x["id"] == f'd"{i}'
        touching = [n for n, (a, b) in enumerate(offsets) if a < x["end"] and b > x["start"]] if body else []
        assert (x["first"], x["last"]) == ((touching[0], touching[-1] + 1) if touching else (0, 0))
        assert x["tokens"] == len(offsets)


def test_user_rewards(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 1.0), ("b", 1, None)], "k string, step long, v double")
    got = {x["k"]: (x["first"], x["none"], x["total"]) for x in C.user_rewards(df, "k", "step", {"first": lambda t: t["v"].iloc[0] if t["v"].notna().any() else 7, "none": lambda t: None}).collect()}
    assert got == {"a": (1.0, None, 1.0), "b": (7.0, None, 7.0)}
