"""Scores by hand, repeated and missing ids, very long texts and payloads, reserved names."""

import functools
import math
import random

import pytest
import regex
from lodestone.llm import chat, decontamination, licenses, mixing, ngram_join, substring, token_counts, toxicity, warc


@functools.cache
def distance(a: str, b: str) -> int:
    """Edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def naive_score(text, lexicon):
    """The score from all terms for all words, with no automaton and no shared state."""
    if not text:
        return toxicity.BASE_SCORE
    lower = text.lower()
    found = [(m.group(), m.start(), m.end()) for m in toxicity.TOKEN.finditer(lower)]
    weights = []
    for word, _, _ in found:
        own = [w * toxicity.PER_EDIT**e for term, w in lexicon.words.items() if (e := distance(word, term)) <= toxicity.allowed(term) and not (e and word in lexicon.excepted)]
        own += [w for stem, w in lexicon.stems.items() if word.startswith(stem)]
        weights.append(max(own, default=0.0))
    hit = [i for i, w in enumerate(weights) if w]
    clean = 1 - toxicity.BASE_SCORE
    for i in hit:
        near = range(max(0, i - toxicity.WINDOW), min(len(found), i + toxicity.WINDOW + 1))
        personal = any(found[j][0] in toxicity.SECOND_PERSON for j in near if j != i)
        reported = any(found[j][0] in toxicity.REPORTING for j in near if j != i)
        before, after = lower[found[near[0]][1] : found[i][1]], lower[found[i][2] : found[near[-1]][2] + 1]
        marked = sum(c in toxicity.QUOTES for c in before) % 2 == 1 and any(c in toxicity.QUOTES for c in after)
        w = weights[i]
        if (marked or reported) and not personal and not any(j in hit for j in near if j != i):
            w *= toxicity.QUOTED
        elif personal:
            w = min(1.0, w * toxicity.PERSONAL)
        clean *= 1 - min(w, 0.999)
    return 1 - clean


def test_toxicity_query_like_the_naive_score(spark, tmp_path):
    r = random.Random(11)
    plain = ["".join(r.choice("aeioublst") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    bad = ["zidyot", "kvetchingly", "grmx", "wretchedness"]
    docs = []
    for i in range(500):
        words = [r.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            for _ in range(2):
                words.insert(r.randrange(30), r.choice(bad[:3]) + (r.choice(plain) if r.random() < 0.3 else ""))
        docs.append((i, " ".join(words)))
    for i in range(500, 700):  # misspelt, quoted, reported, addressed
        words = [r.choice([*plain, "you", "said", '"', "«", "wrote", "."]) for _ in range(20)]
        for _ in range(r.randrange(3)):
            w = list(r.choice(bad))
            for _ in range(r.randrange(3)):
                at = r.randrange(len(w))
                r.choice([lambda w=w, at=at: w.__setitem__(at, r.choice("xyz")), lambda w=w, at=at: w.insert(at, "q"), lambda w=w, at=at: w.pop(at)])()
            words.insert(r.randrange(len(words)), "".join(w))
        docs.append((i, " ".join(words)))
    docs += [(700, "word " * 60_000 + "zidyot " * 3), (701, None), (1, docs[1][1])]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(500)] + [(4, 1, 0), (5, 1, None)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lexicon = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert lexicon.words or lexicon.stems
    got = toxicity.query(spark, str(tmp_path)).collect()
    want = dict(docs)
    assert len(got) == len(docs)
    for row in got:
        assert math.isclose(row["score"], naive_score(want[row["doc_id"]], lexicon), rel_tol=1e-9), row["doc_id"]


def test_a_label_of_either_kind_counts_as_toxic(spark):
    docs = spark.createDataFrame([(i, f"{'zidyot' if i % 2 else 'fine'} w{i % 7} w{i % 5} x{i}") for i in range(400)], "doc_id long, text string")
    both = spark.createDataFrame([(i, t) for i in range(400) for t in ({i % 2, 0})], "doc_id long, toxic int")
    one = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    assert toxicity.learn(docs, both) == toxicity.learn(docs, one)


def test_texts_of_one_id_are_one_node(spark):
    a, b = "p q r s t u v w", "k l m n o a b c"
    rows = [(3, a), (5, a), (5, b), (9, b), (12, ""), (12, None), (9, ""), (7, "other words stand here")]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3), (9, 3), (12, 12), (12, 12)]
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert kept == [3, 7, 12, 12]


def test_many_missing_ids(spark):
    line = "one two three four five six seven eight"
    rows = [(None, line), (None, line), (None, line + "\nown words"), (4, "nothing of the kind is here"), (None, None), (None, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in substring.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == sorted([(None, line), (None, ""), (None, "own words"), (4, rows[3][1]), (None, None), (None, "")], key=repr)
    want = substring.brute(rows)
    assert sorted(map(repr, want)) == sorted(repr(t) for _, t in got)


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 997}" for i in range(200_000))
    items = spark.createDataFrame([(1, " ".join(long.split()[150_000:150_012])), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (2, "w1 w2")], "doc_id long, text string")
    hit, none = decontamination.hits(docs, items).orderBy("doc_id").collect()
    assert hit["n_words"] == 200_000 and hit["items"] == [1] and not none["items"]
    assert [r["doc_id"] for r in decontamination.clean(docs, items).collect()] == [2]
    several = decontamination.hits(docs, spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(40)], "item_id long, text string"), block_bytes=40).orderBy("doc_id").collect()
    assert several[0]["items"] == list(range(40)) and several[1]["items"] == []
    sizes = mixing.rates(docs.selectExpr("doc_id", "text", "'s' AS source")).orderBy("doc_id").collect()
    assert [r["size"] for r in sizes] == [200_000, 2]
    turns = [(1, i, "assistant" if i % 2 else "user", "é<|im_end|> " * 200) for i in range(2_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    (row,) = chat.formatted(df).withColumn("loss", chat.under_mask("formatted", "loss_spans")).collect()
    assert row["loss"] == "é<|im_end|> " * 200 * 1_000


def test_archives_of_large_and_packed_payloads(spark, tmp_path):
    rows = [(1, "http://a", "é" * 3_000_000), (2, "http://b", "é" * 3_000_000), (2, "http://c", "é" * 3_000_000), (None, None, "x" * 200), (None, "http://n", "x" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for packing in ("none", "gzip"):
        warc.write(df, f"{tmp_path}/{packing}", compression=packing)
    back = warc.resolved(warc.read(spark, f"{tmp_path}/none")).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in back), key=repr) == sorted([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (None, "response", None), (None, "revisit", None)], key=repr)
    assert len({r["record_id"] for r in back}) == 5
    names = spark.read.format("binaryFile").load(f"{tmp_path}/gzip").select("path").collect()
    assert any(r["path"].endswith(".gz") for r in names)


def test_names_of_the_mix(spark):
    df = spark.createDataFrame([(1, "a b", "s", 7), (2, "c", "t", 8)], "doc_id long, text string, source string, copy int")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "copy"] and {r["copy"] for r in out.collect()} <= {1, 2, 3}


def test_edits_with_missing_members(spark):
    from pyspark.sql import functions as F

    edits = [None, (None, 0, "x"), (0, None, None), (3, 2, "yy")]
    docs = spark.createDataFrame([(1, "alpha beta", edits), (2, None, edits), (3, "", None)], f"doc_id long, text string, e {token_counts.EDITS}")
    got = token_counts.counts(docs, F.col("e")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_chars"], r["n_chars_after"]) for r in got] == [(1, 10, 11), (2, 0, 3), (3, 0, 0)]


@pytest.mark.parametrize("text", ["mit licence mit license", "apach license apache license", "the mit licence and mit license gnu generl public license", "cc by cc by"])
def test_spans_like_trying_every_place(text):
    """Every disjoint place that a notice matches within its edits has a span, and spans of a notice don't overlap."""
    joined, searcher = f" {text} ", licenses.Searcher()
    found = searcher(text.encode().split())
    for k, (notice, _) in enumerate(searcher.notices):
        own = sorted((a, b) for n, a, b, _ in found if n == k)
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))
        errors = licenses.edits(notice)
        if not errors:
            continue
        pattern = regex.compile(rf"(?:{regex.escape(notice)}){{e<={errors}}}")
        bounds = [i for i, c in enumerate(joined) if c == " "]
        places = [(a + 1, b) for a in bounds for b in bounds if a < b and pattern.fullmatch(joined, a + 1, b)]
        assert all(any(a < y and x < b for x, y in own) for a, b in places)
