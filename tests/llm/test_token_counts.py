import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import token_counts as tc

COUNT = tc.Counter(tc.vocabulary())
PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "'", "'s", "'ll", "l", "'r", "e", "1", "23", "é", "ß", "!", "?!", "\t", "漢", "😀", " x", "word word", "d"])


def apply(text, edits):
    for p, d, t in edits:
        p = max(0, min(p, len(text)))
        text = text[:p] + t + text[p + max(0, d) :]
    return text


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.lists(st.tuples(st.integers(0, 130), st.integers(0, 30), st.lists(PIECES, max_size=6).map("".join)), max_size=6), st.sampled_from([1, 4, 128]))
def test_like_encoding_anew(text, edits, leaf):
    before, tc.LEAF = tc.LEAF, leaf
    try:
        tree = tc.SegmentTree(text, COUNT)
        for e in edits:
            tree.edit(*e)
        want = apply(text, edits)
        assert tree.text() == want and tree.characters == len(want)
        assert tree.tokens == len(COUNT.encoding.encode_ordinary(want))
    finally:
        tc.LEAF = before


def test_only_the_region_is_encoded():
    r = random.Random(1)
    text = " ".join(r.choice(["alpha", "beta", "it's", "42", "x,"]) for _ in range(20_000))
    tree = tc.SegmentTree(text, COUNT)
    first = tree.encoded
    tree.edit(50_000, 3, "new words here")
    assert tree.encoded - first < 200
    assert tree.tokens == len(COUNT.encoding.encode_ordinary(tree.text()))


def test_query(spark, tmp_path):
    rows = [(1, "It's a test of counting, isn't it? " * 20), (2, ""), (3, None), (None, "x"), (1, "again"), (4, "word " * 30_000)]
    spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = tc.query(spark, str(tmp_path)).collect()
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("e", tc.standard_edits()).collect()
    want = []
    for r in df:
        text = r["text"] or ""
        after = apply(text, [(e["position"], e["deleted"], e["inserted"]) for e in r["e"]])
        n = lambda t: len(COUNT.encoding.encode_ordinary(t))
        want.append((r["doc_id"], len(text), n(text), len(after), n(after)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    assert tc.counts(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0
    assert all(r["n_tokens"] == r["n_tokens_after"] for r in tc.counts(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
