"""Queries over whole tables, beside their statements or by hand."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import datasets as D
from lodestone.plans import registry
from verify import TABLES, rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


#: Queries that once left rows out, beside their statements on a larger table.
WHOLE = """agreed_splits block_render_roundtrip call_ledger_budget dense_max_per_doc evidence_spans_800 grpo_loss_columns logprob_comparison masked_keys normalized_dedup
pairwise_group_f1 proper_name_counts quota_cross_fill redirect_chain replication_diff sentence_offsets span_location superseded_decisions support_documents vote_reconciliation""".split()


@pytest.mark.parametrize("name", WHOLE)
def test_like_the_statement(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(300)],
    [(i, i + 1) for i in range(50)] + [(50, 20)] + [(100, 101), (101, 100)] + [(7000 + i, 7001 + i) for i in range(3)] + [(60, 60), (61, 60)],
    [(1, 2)],
    [],
])
def test_redirects_of_any_length(spark, edges):
    own = dict(edges)
    want = []
    for src in own:
        at, seen = src, []
        while at in own and at not in seen:
            seen.append(at)
            at = own[at]
        want.append((src, at, len(seen), at in seen))
    got = D.redirect_ends(spark.createDataFrame(edges, "src long, dst long")).select("src", "target", "hops", "cycle").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_spans_of_many_paragraphs(spark):
    body = "\n".join("x" * (n % 5) for n in range(60_000)) + "\n" + "é" * 1_700
    got = spark.createDataFrame([(body,), (None,), ("",)], "b string").select(D.spans("b").alias("s")).collect()
    spans = [(x["start"], x["end"]) for x in got[0]["s"]]
    assert len(spans) == 60_003 and max(b - a for a, b in spans) == 800
    assert hashlib.md5("".join(body[a:b] for a, b in spans).encode()).digest() == hashlib.md5(body.replace("\n", "").encode()).digest()
    assert got[1]["s"] is None and [tuple(x) for x in got[2]["s"]] == [(0, 0)]


def test_blocks_of_any_title_and_text(spark, tmp_path):
    texts = ["a|b > c\\p \\g\\e\\ <<x>> | e f g\nbody << >> | <<b7 ", "\\0 t", "t\\z", "", None, "x>>\n<<y|z>>\n"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = registry.QUERIES["block_render_roundtrip"](spark, str(tmp_path)).collect()
    assert got["n"] == len(texts) and got["same"]
    (odd,) = spark.createDataFrame([([("1|>", None, "t"), ("2", "a\n>>|", None), ("3", "", "")],)], "d array<struct<id:string,title:string,text:string>>").select((D.parse_blocks(D.blocks(F.col("d"), "q9"), "q9") == F.col("d")).alias("same")).collect()
    assert odd["same"]


def test_blocks_of_the_table(spark):
    got = registry.QUERIES["block_render_roundtrip"](spark, SF).collect()
    assert sum(r["n"] for r in got) == 1000 and all(r["same"] for r in got)
