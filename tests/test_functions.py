"""Literal cases of text functions, retrieval, rewards, statistics and readers."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import tools
from lodestone.operators import datasets as D
from lodestone.operators import retrieval as R
from lodestone.operators import stats as S
from lodestone.operators import trajectory as J
from lodestone.sources import readers, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("said", "gold", "f1"), [("The New-York!", "newyork", 1.0), ("", "", 1.0), ("", "x", 0.0), ("alpha beta gamma", "alpha beta gamma delta", 6 / 7), ("b b c", "c b", 0.8)])
def test_house_f1(spark, said, gold, f1):
    assert one(spark, T.token_f1(T.answer_words(F.col("s")), T.answer_words(F.col("g"))), s=said, g=gold) == pytest.approx(f1)


def test_orders_of_normalisation_differ(spark):
    assert one(spark, T.normalize_answer(F.col("s")), s="the-x") == "x"
    assert one(spark, T.official_answer(F.col("s")), s="the-x") == "thex"
    assert one(spark, T.official_f1(T.official_words(F.col("s")), T.official_words(F.col("g"))), s="yes indeed", g="yes") == 0.0
    assert one(spark, T.official_f1(T.official_words(F.col("s")), T.official_words(F.col("g"))), s="", g="the") == 0.0


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("s")), s="The Straße of 東京 x 42 is a b2") == ["strasse", "東", "京", "42", "b2"]
    assert one(spark, T.norm(F.col("s")), s="  A\t b\n") == "a b"
    assert one(spark, T.occurrences(F.col("s"), F.col("t")), s="aaaa", t="aa") == 2
    assert one(spark, T.occurrences(F.col("s"), F.col("t")), s="aaaa", t="") == 0
    assert one(spark, T.hash_mod(F.col("s"), 100), s="x") == 65


def test_fusion(spark):
    lists = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 3, "x"), ("b", 1, 1, "y"), ("b", 1, 2, "x")], "source string, qid long, rank long, id string")
    got = [tuple(r) for r in R.fuse(lists).orderBy("rank").collect()]
    assert got == [(1, 1, "x", round(1 / 61 + 1 / 62, 8)), (1, 2, "y", round(1 / 61 + 1 / 62, 8))]


def test_bm25_title_and_ties(spark):
    corpus = spark.createDataFrame([("1", "red apple", "fruit tree"), ("10", "pear", "apple fruit"), ("2", "pear", "apple fruit"), ("3", "stone", "rock")], "id string, title string, text string")
    q = spark.createDataFrame([(0, "red apple"), (1, "fruit"), (2, "of the")], "qid long, question string")
    got = {(r["qid"], r["rank"]): r for r in R.bm25_search(corpus, q).collect()}
    assert got[0, 1]["id"] == "1" and got[0, 1]["score"] > 10
    assert [got[1, k]["id"] for k in (1, 2, 3)] == ["10", "2", "1"]
    assert not any(k[0] == 2 for k in got)


def test_chunks_cover(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(768)), lambda x: x.cast("string")).alias("t"))
    c = [(x["start"], x["end"]) for x in df.select(D.chunks(F.col("t")).alias("c")).first()["c"]]
    assert c[0][0] == 0 and c[-1][1] == 768 and all(b - a <= 220 for a, b in c) and all(x[1] - y[0] == 32 for x, y in zip(c[:-2], c[1:-1]))
    empty = spark.range(1).select(D.chunks(F.array().cast("array<string>")).alias("c")).first()["c"]
    assert [(x["start"], x["end"]) for x in empty] == [(0, 0)]


def test_window_starts(spark):
    starts = lambda n: one(spark, R.window_starts(F.lit(n), 256, 256, 8))
    assert starts(0) == [0] and starts(256) == [0] and starts(300) == [0, 44] and starts(10_000)[-1] == 9744 and len(starts(10_000)) == 8


def test_spans_give_the_body_back(spark):
    r = random.Random(1)
    body = "\n".join("é" * r.randrange(0, 2000) for _ in range(6))
    got = spark.createDataFrame([(body,)], "b string").select(D.spans(F.col("b")).alias("s")).first()["s"]
    assert all(x["end"] - x["start"] <= 800 for x in got)
    assert "".join(body[x["start"] : x["end"]] for x in got) == body.replace("\n", "")


def test_rewards_and_advantages(spark):
    rows = [("g", "a", 1.0, True), ("g", "b", 0.0, False), ("h", "c", 0.5, False), ("h", "d", 0.5, False)]
    df = spark.createDataFrame(rows, "group_id string, rollout_id string, reward double, correct boolean")
    got = {r["rollout_id"]: r["advantage"] for r in J.advantages(df).collect()}
    assert got["a"] == pytest.approx(1, abs=1e-6) and got["b"] == pytest.approx(-1, abs=1e-6) and got["c"] == got["d"] == 0
    kinds = {r["group_id"]: r["signal"] for r in J.signal_class(J.group_stats(df)).collect()}
    assert kinds == {"g": "mixed_outcome", "h": "all_wrong_equal"}


def test_over_search(spark):
    steps = spark.createDataFrame([("r", 1, "search", 1), ("r", 2, "search", 4), ("r", 3, "search", None), ("r", 4, "answer", None)], "rollout_id string, step long, action string, found long")
    got = J.over_search(steps, F.array(F.lit(1).cast("long"), F.lit(4).cast("long"))).orderBy("step").collect()
    assert [r["over_search"] for r in got] == [False, False, True, False]


def test_pairing(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.0)], "case long, em double")
    b = spark.createDataFrame([(1, 1.0), (2, 0.0), (4, 1.0)], "case long, em double")
    r = S.paired_report(S.paired(a, b, "case", "em"), "em").first()
    assert (r["pairs"], r["before_only"], r["after_only"], r["gains"], r["losses"], r["mean_delta"], r["identical_case_sets"]) == (2, 1, 1, 1, 1, 0.0, False)


def test_distribution_ignores_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    r = S.distribution(df, "x").first()
    assert (r["count"], r["missing"], r["max"]) == (4, 3, 8.0) and r["p95"] == pytest.approx(7.4)


def test_action_parse(spark):
    cases = {'{"action":"search","query":" a "}': ("search", "a"), '```json\n{"action":"answer","answer":"b"}\n```': ("answer", "b"), '{"action":"search","text":"t"}': ("search", "t"), '{"action":"answer","answer":" "}': ("invalid", None), '{"action":"answer","answer":"x"} more': ("invalid", None), "no": ("invalid", None)}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    p = D.parsed_action(F.col("raw"))
    for r in df.select("raw", p["action"].alias("a"), p["argument"].alias("b")).collect():
        assert (r["a"], r["b"]) == cases[r["raw"]], r["raw"]


def test_quote_repair_is_the_longest_match(spark):
    body, quote = "The quick brown fox jumps over the lazy dog", "quikc brown fox jumqs"
    r = D.quote_repairs(spark.createDataFrame([(1, quote, body)], "id long, quote string, body string")).first()
    assert r["found"] == body[r["start"] : r["start"] + len(quote)] and r["ratio"] == round(SequenceMatcher(None, quote, r["found"], autojunk=False).ratio(), 4)


def test_guard():
    assert readers.guarded("/data/x.parquet") == "/data/x.parquet"
    for bad in ("/data/Sealed/x", "/data/%73ealed/x", "/data/%2573ealed", "/a/ｓealed", "/a/final_test.json"):
        with pytest.raises(PermissionError):
            readers.guarded(bad)
    with pytest.raises(ValueError):
        readers.guarded("/a/%2e%2e/b")


def test_tolerant_reader(spark, tmp_path):
    good = [json.dumps({"id": i}) for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join([*good, "", '{"id": 9']))
    assert sorted(r["id"] for r in readers.read_jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), "id long").collect()) == [0, 1, 2, 3, 4]
    (tmp_path / "b.jsonl").write_text("\n".join([good[0], "{bad", good[1]]))
    with pytest.raises(Exception, match="corrupt record"):
        readers.read_jsonl_tolerant(spark, str(tmp_path / "b.jsonl"), "id long").collect()


def test_store(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    sinks.upsert(rows((1, "a"), (2, "b")), str(tmp_path / "s"))
    sinks.upsert(rows((1, "c")), str(tmp_path / "s"))
    assert sorted(map(tuple, sinks.latest(spark, str(tmp_path / "s"), "id").collect())) == [(1, "c"), (2, "b")]
    sinks.append_events(rows((1, "a")), str(tmp_path / "e"))
    sinks.append_events(rows((2, "a")), str(tmp_path / "e"))
    with pytest.raises(ValueError):
        sinks.append_events(rows((2, "z")), str(tmp_path / "e"))
    sinks.write_once(rows((1, "a")), str(tmp_path / "o.csv"), "csv")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(rows((1, "a")), str(tmp_path / "o.csv"), "csv")
    assert readers.read_any(spark, str(tmp_path / "o.csv"), "id long, v string").collect()[0]["v"] == "a"
    assert readers.file_digests(spark, str(tmp_path / "o.csv")).count() >= 1


def test_tool_errors_are_rows(spark):
    def handler(argument):
        if argument == "bad":
            raise KeyError("no")
        return [argument.upper(), "x" * 9000]

    tools.register(spark, "lodestone_test_tool", handler, replace=True)
    got = spark.sql("SELECT a, t.* FROM VALUES ('ok'), ('bad'), (NULL) AS v(a), LATERAL lodestone_test_tool(a) t").collect()
    assert len(got) == 4 and sum(r["ok"] for r in got) == 2 and max(len(r["value"] or "") for r in got) == tools.TEXT_CAP
    with pytest.raises(ValueError):
        tools.register(spark, "lodestone_test_tool", handler)
