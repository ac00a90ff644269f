"""Results and memory where a table has many copies, many titles within questions, or large batches."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.functions import text as T
from lodestone.operators import retrieval as R


def _tokens(x):
    return [t for t in re.findall(T.TOKEN, x.lower()) if t not in T.STOPWORDS and (len(t) > 1 or ord(t) > 127)]


def test_boosts_of_many_titles(spark, monkeypatch):
    """F1, F2: boosts are added where a document is scored; no pairs of title and question go through a table, and no search keeps all pairs."""
    monkeypatch.setattr(R, "PAIRS", 3, raising=False)
    seen = []
    rows = R.bm25_rows
    monkeypatch.setattr(R, "bm25_rows", lambda *a, **k: (seen.append(k.get("k", a[3] if len(a) > 3 else None)), rows(*a, **k))[1])
    r = random.Random(3)
    words = "red fox runs far whale swims deep 中 tea unbelievable".split()
    line = lambda n: " ".join(r.choices(words, k=n))
    docs = [(str(i), line(r.randint(0, 4)), line(r.randint(0, 30))) for i in range(150)]
    docs += [(f"c{i}", "red fox", "red fox runs") for i in range(40)] + [("part", "ox", "nothing"), ("none", None, None)]
    asked = [(q, line(r.randint(1, 7))) for q in range(30)] + [(90, "red fox"), (91, "of the"), (92, "")]
    corpus, questions = spark.createDataFrame(docs, "id string, title string, text string"), spark.createDataFrame(asked, "qid long, question string")
    got = {(x.qid, x.rank): (x.id, x.score) for x in R.bm25_search(corpus, questions, 3, True).collect()}
    assert seen == [3]
    plain = {(x.qid, x.id): x.score for x in rows(corpus, questions).collect()}
    want = {}
    for q, text in asked:
        form = " ".join(_tokens(text))
        title = {i: " ".join(_tokens(t or "")) for i, t, _ in docs}
        score = {i: plain.get((q, i), 0.0) + (0.0 if not title[i] or title[i] not in form else 10.0 if title[i] == form else 4.0) for i, _, _ in docs}
        for n, i in enumerate(sorted((i for i in score if score[i] > 0), key=lambda i: (-round(score[i], 9), i))[:3]):
            want[q, n + 1] = (i, round(score[i], 6))
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_titles_within():
    r = random.Random(5)
    forms = [" ".join(r.choices(["ab", "abc", "b", "中", "abcdefghij", "x" * 30], k=r.randint(0, 9))) for _ in range(60)]
    find = R.Within(forms)
    titles = [f[a : a + n] for f in forms for a, n in [(r.randrange(len(f) + 1), r.choice([1, 3, 7, 8, 9, 23, 24, 25, 80]))]] + ["", "zz", "nowhere at all, at all", *forms]
    for t in titles * 2:
        q, boost = find(t)
        assert dict(zip(q.tolist(), boost.tolist(), strict=True)) == {n: 10.0 if f == t else 4.0 for n, f in enumerate(forms) if t and t in f}
    assert len(R.Within([])("ab")[0]) == 0


@pytest.mark.parametrize("k", [1, 3])
def test_copies_do_not_add_up(k):
    """of rows with the same score only the first k are kept, whatever order they come in."""
    r = random.Random(k)
    rows = [(float(r.randint(1, 4)), f"d{i:05}") for i in range(5_000)] + [(9.0, None)]
    r.shuffle(rows)
    best, most = R.Best(1, k, lambda i: [i]), 0
    for score, i in rows:
        best.offer(0, score, i, i)
        most = max(most, len(best.rows[0]))
    assert most <= 8 * k
    got = sorted(((-s, i is not None, i) for _, s, i in best))[:k]
    assert got == sorted((-s, i is not None, i) for s, i in rows)[:k]
    best = R.Best(1, k, lambda row: [row[1], row[0]])  # rows of one group
    for i in range(3_000):
        best.offer(0, 2.0, "title", (f"d{i}", i % 7))
    assert list(best) == [(0, 2.0, ("d0", 0))]


def test_parts_of_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["x"])
    assert [p.num_rows for p in R.parts([batch, batch.slice(0, 0), batch.slice(0, 4)], 4)] == [4, 4, 2, 0, 4]
    assert [x for p in R.parts([batch], 3) for x in p.column("x").to_pylist()] == list(range(10))


def _counting(most):
    """A tokenizer that fails if it gets more than one text at once."""

    def make():
        def offsets(texts):
            assert len(texts) <= most
            return [[m.span() for m in re.finditer(r"[^ \t\n]+", x)] for x in texts]

        return offsets

    return make


def test_one_text_tokenised_at_a_time(spark):
    """tokens of one text at a time are Python objects."""
    from lodestone.operators import context as C
    from lodestone.operators import excerpts as E

    shown = spark.createDataFrame([(case, 1, 1, "d", f"word {case} end") for case in range(300)], "case long, at long, rank int, id string, text string")
    messages = spark.createDataFrame([(case, 0, "user", "asks") for case in range(300)], "case long, at long, role string, content string")
    got = C.token_spans(C.rendered(messages, shown).coalesce(1), _counting(1)).collect()
    assert len(got) == 300 and all(x.body == f"word {x.case} end" and x.last - x.first == 3 for x in got)
    texts = spark.createDataFrame([(f"a bb {i}", ["bb"], 1) for i in range(300)], "text string, asked array<string>, limit int").coalesce(1)
    assert {(x.start, x.end) for x in E.excerpts(texts, _counting(1)).collect()} == {(2, 4)}


@pytest.mark.parametrize("rows", [3, 10_000])
def test_rewards_of_many_trajectories(spark, rows):
    """one frame for many trajectories; each function sees its own one in order, with the kinds that it alone has, also over batches' ends."""
    from lodestone.operators import context as C

    big = 2**60 + 1
    data = [(k, s, None if k == "b" and s == 2 else big + s, f"{k}{s}", s % 2 == 0) for k, n in (("a", 7), ("b", 3), (None, 2), ("c", 1)) for s in range(n)]
    data += [(f"x{i}", 0, None if i % 2 else i, "z", None) for i in range(200)]
    df = spark.createDataFrame(random.Random(2).sample(data, len(data)), "k string, step int, v long, t string, flag boolean").repartition(3)
    functions = {"n": len, "kind": lambda t: {"int64": 1, "float64": 2}[str(t["v"].dtype)], "last": lambda t: float(int(t["v"].iloc[-1]) % 1000) if t["v"].notna().all() else None, "first": lambda t: t["step"].iloc[0] + 10 * t.index[0], "order": lambda t: int("".join(str(x) for x in t["step"])), "columns": lambda t: list(t.columns) == ["k", "step", "v", "t", "flag"], "flags": lambda t: t["flag"].dtype == bool}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = C.user_rewards(df, "k", "step", functions)
        got = {r.k: tuple(r)[1:] for r in found.collect()}
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    last = lambda s: float((big + s) % 1000)
    assert got["a"][:7] == (7.0, 1.0, last(6), 0.0, 123456.0, 1.0, 1.0)
    assert got["b"][:7] == (3.0, 2.0, None, 0.0, 12.0, 1.0, 1.0) and got[None][:7] == (2.0, 1.0, last(1), 0.0, 1.0, 1.0, 1.0)
    assert got["c"][:3] == (1.0, 1.0, last(0)) and len(got) == 204
    assert got["x2"][:7] == (1.0, 1.0, 2.0, 0.0, 0.0, 1.0, 0.0) and got["x3"][:3] == (1.0, 2.0, None)
    assert got["a"][7] == sum(x for x in got["a"][:7])
    keys = spark.createDataFrame([(big, 1, 1), (None, 1, None), (big + 1, 1, None)], "k long, s int, v int").coalesce(1)
    assert {r.k: r.v for r in C.user_rewards(keys, "k", "s", {"v": lambda t: {"int32": 4, "float64": 8}[str(t["v"].dtype)]}).collect()} == {big: 4.0, None: 8.0, big + 1: 8.0}


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_dense_in_parts(spark, monkeypatch, cells):
    """scores are made for few vectors at a time; copies, documents of several chunks and values that are no numbers too."""
    monkeypatch.setattr(R, "CELLS", cells)
    g = np.random.default_rng(1)
    v = g.integers(-3, 4, (120, 4)).astype(float)
    v[7] = np.nan
    names = [f"d{i % 37}" for i in range(120)]
    chunks = spark.createDataFrame([(n, x) for n, x in zip(names, v.tolist(), strict=True)], "id string, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(v[20:40].tolist())], "qid long, vector array<double>")
    got = sorted((r.qid, r.rank, r.id, r.score) for r in R.dense_search(chunks, queries, 3).collect())
    want = []
    for q, own in enumerate(v[20:40]):
        score = {}
        for n, x in zip(names, v, strict=True):
            if not np.isnan(x).any():
                score[n] = max(score.get(n, -np.inf), float(own @ x))
        want += [(q, rank + 1, n, score[n]) for rank, n in enumerate(sorted(score, key=lambda n: (-score[n], n))[:3])]
    assert got == want


def test_sentences_as_lengths(spark):
    """F8: the running sums get lengths, no texts; nulls and empty lists stay what they are, in any slice of a batch."""
    from pyspark.sql import functions as F

    from lodestone.functions import structure as X

    rows = [(["ab", "", "é😀"],), (None,), ([],), (["x"],)]
    df = spark.createDataFrame(rows, "p array<string>").coalesce(1)
    got = df.select(X.with_offsets(F.col("p")).alias("o"))
    assert [r.o if r.o is None else [tuple(x) for x in r.o] for r in got.collect()] == [[(0, 2), (2, 2), (2, 4)], None, [], [(0, 1)]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"running\(transform\(", plan)


def test_searches_take_small_batches(spark, monkeypatch):
    """both passes of a search run with few rows in an Arrow batch, and leave the session's own number as it was."""
    key, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", [], R.written
    monkeypatch.setattr(R, "written", lambda df: (seen.append((int(spark.conf.get(key)), "MapInArrow" in df._jdf.queryExecution().executedPlan().toString())), written(df))[1])
    corpus = spark.createDataFrame([(f"d{i}", "red fox", f"fox number 1{i % 7}") for i in range(40)], "id string, title string, text string")
    questions = spark.createDataFrame([(1, "fox number 13"), (2, "red")], "qid long, question string")
    old = spark.conf.get(key, None)
    for own, want in ((None, R.BATCH), ("10000", R.BATCH), ("0", R.BATCH), ("7", 7)):
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
        try:
            seen.clear()
            found = R.bm25_search(corpus, questions, 3, False)
            assert spark.conf.get(key, None) == own and seen == [(want, True)] * 2
            assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
            assert [(r.qid, r.rank, r.id) for r in found.orderBy("qid", "rank").collect()] == [(1, 1, "d10"), (1, 2, "d17"), (1, 3, "d24"), (2, 1, "d0"), (2, 2, "d1"), (2, 3, "d10")]
        finally:
            spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def test_a_task_gives_only_its_best():
    """at its end a task gives the k best and what ties with the last, not all that it held."""
    best = R.Best(2, 3, lambda i: [i])
    for n in range(11):
        best.offer(0, float(n), f"d{n}", f"d{n}")
        best.offer(1, 1.0 + n * 1e-9, f"d{n}", f"d{n}")
    got = list(best)
    assert sorted(row for q, _, row in got if q == 0) == ["d10", "d8", "d9"] and len([1 for q, _, _ in got if q == 1]) > 3


@pytest.mark.parametrize("blocks, most, passes", [(8, 100_000, 1), (2, 100_000, 3), (8, 1, 6)])
def test_one_pass_counts_several_blocks(spark, monkeypatch, blocks, most, passes):
    """texts are read once for the terms of several blocks; a block's scores don't depend on the others' terms."""
    r = random.Random(7)
    words = "red fox runs far whale swims deep 中 tea b1 the x unbelievable".split()
    line = lambda n: " ".join(r.choices(words, k=n))
    docs = [(f"d{i:03}", line(r.randint(0, 4)), line(r.randint(0, 30))) for i in range(120)] + [("none", None, None)]
    asked = [(q, line(r.randint(0, 5))) for q in range(12)] + [(90, None), (91, "the x"), (92, "nowhere"), (93, "red red fox")]
    corpus, questions = spark.createDataFrame(docs, "id string, title string, text string"), spark.createDataFrame(asked, "qid long, question string")
    also = spark.createDataFrame([(92, "d001"), (93, "none"), (0, "d002")], "qid long, id string")
    rows = lambda: {(x.qid, x.id): round(x.score, 9) for x in R.bm25_rows(corpus, questions, k=3, also=also, boost=True).collect()}
    best = lambda: sorted(tuple(x) for x in R.bm25_search(corpus, questions, 3).collect())
    whole, ranked = rows(), best()
    assert whole[92, "d001"] == whole[93, "none"] == 0.0
    count, seen = R.counted, []
    monkeypatch.setattr(R, "counted", lambda *a, **k: (seen.append(len(a[1])), count(*a, **k))[1])
    monkeypatch.setattr(R, "BLOCK", 3)
    monkeypatch.setattr(R, "BLOCKS", blocks, raising=False)
    monkeypatch.setattr(R, "TERMS", most, raising=False)
    assert best() == ranked and len(seen) == passes
    assert {x: s for x, s in rows().items() if x in whole} == whole


def test_only_pages_found_are_scored(spark, monkeypatch):
    """with k = 0 Python gets the rows of the documents asked for alone, once for all blocks of a pass; what isn't eligible is left out where terms are counted."""
    r = random.Random(13)
    words = "red fox runs far whale swims deep 中 tea b1 the x notes".split()
    line = lambda n: " ".join(r.choices(words, k=n))
    docs = [(f"d{i:03}", n, None, r.choice(["", "the of", "Notes", "x", "see notes"]) if r.random() < 0.4 else line(r.randint(1, 30))) for i in range(80) for n in range(3)]
    eligible = [d for d in docs if _tokens(d[3]) and " ".join(_tokens(d[3])) not in ("notes", "see notes")]
    kind = "id string, paragraph_index long, title string, text string"
    questions = spark.createDataFrame([(q, line(r.randint(0, 6))) for q in range(11)], "qid long, question string")
    also = spark.createDataFrame([(q, f"d{r.randrange(90):03}") for q in range(11) for _ in range(3)], "qid long, id string").distinct()
    rows = lambda df: {(x.qid, x.id, x.paragraph_index): x.score for x in df.collect()}
    every = rows(R.bm25_rows(spark.createDataFrame(eligible, kind), questions, ("id", "paragraph_index"), title_weight=0))
    want = {(x.qid, d[0], d[1]): every.get((x.qid, d[0], d[1]), 0.0) for x in also.collect() for d in eligible if d[0] == x.id}
    writes, written = [], R.written
    monkeypatch.setattr(R, "written", lambda df: (writes.append(df._jdf.queryExecution().optimizedPlan().toString()), written(df))[1])
    monkeypatch.setattr(R, "BLOCK", 3)
    got = rows(R.bm25_rows(spark.createDataFrame(docs, kind), questions, ("id", "paragraph_index"), 0, also, title_weight=0, without=("notes", "see notes")))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert len(writes) == 2 and "LeftSemi" in writes[1]


def test_titles_looked_up_together():
    """titles whose first piece stands in no question are told apart for a whole batch; none that stands in one is lost."""
    r = random.Random(6)
    forms = [" ".join(r.choices(["ab", "abc", "b", "中", "abcdefghij", "x" * 30], k=r.randint(0, 9))) for _ in range(60)]
    find = R.Within(forms)
    titles = [f[a : a + n] for f in forms for a, n in [(r.randrange(len(f) + 1), r.choice([1, 3, 7, 8, 9, 23, 24, 25, 80]))]] + ["", "zz", "nowhere at all, at all", "nowhere", *forms]
    likely = find.likely(titles)
    assert all(x or not len(find(t)[0]) for t, x in zip(titles, likely, strict=True)) and not likely[titles.index("nowhere at all, at all")]
    assert find.likely([]) == [] and R.Within([]).likely(["ab", "x" * 30]) == [True, False]


@pytest.mark.parametrize("cells", [1, 500, 1 << 20])
def test_many_documents_scored_at_once(spark, monkeypatch, cells):
    """F1: scores of any number of documents at a time, rows that have no term too, give the same bits."""
    r = random.Random(9)
    words = "red fox runs far whale swims deep 中 tea b1 the x".split()
    line = lambda n: " ".join(r.choices(words, k=n))
    docs = [(f"d{i:03}", line(r.randint(0, 4)), line(r.randint(0, 30))) for i in range(300)] + [("none", None, None)] + [(f"c{i}", "red fox", "red") for i in range(9)]
    corpus = spark.createDataFrame(docs, "id string, title string, text string")
    questions = spark.createDataFrame([(q, line(r.randint(0, 6))) for q in range(20)] + [(90, "red fox")], "qid long, question string")
    best = lambda: sorted(tuple(x) for x in R.bm25_search(corpus, questions, 3).collect())
    want = best()
    monkeypatch.setattr(R, "CELLS", cells)
    assert best() == want and [x[2] for x in want if x[0] == 90] == ["c0", "c1", "c2"]
    assert list(R.runs(np.array([3, 0, 9, 2, 2, 2]), 2, 4)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
