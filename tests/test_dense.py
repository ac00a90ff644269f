"""The dense index: identity, damage, modes, the service's ledger."""

import json

import pytest
from lodestone.operators import dense as V
from lodestone.sources import sinks


def fixture(spark):
    texts = ["red fox runs far", "blue whale swims deep " * 60, "", "fox and whale meet", None]
    return spark.createDataFrame([(str(i), f"title {i}", t) for i, t in enumerate(texts)], "id string, title string, text string")


def test_index_and_modes(spark, tmp_path):
    corpus, encoder, path = fixture(spark), V.HashingEncoder(), str(tmp_path / "index")
    said = V.build_index(corpus, path, encoder)
    assert V.build_index(corpus, path, encoder) == said == V.manifest(spark, path)
    vectors = V.open_index(corpus, path, encoder)
    assert tuple(V.audit(vectors, 64).first()) == (said["chunks"], 5, 0, 0, 0) and said["chunks"] > 5
    with pytest.raises(ValueError, match="other documents"):
        V.open_index(corpus.filter("id <> '0'"), path, encoder)
    with pytest.raises(ValueError, match="other documents or another encoder"):
        V.open_index(corpus, path, V.HashingEncoder(32))
    vectors.filter("id <> '3'").coalesce(1).write.parquet(str(tmp_path / "damaged/vectors"))
    spark.createDataFrame([(json.dumps(said),)], "value string").write.text(str(tmp_path / "damaged/manifest"))
    with pytest.raises(ValueError, match="damaged"):
        V.open_index(corpus, str(tmp_path / "damaged"), encoder)
    asked = spark.createDataFrame([(1, "fox runs"), (2, "whale"), (3, "  ")], "qid long, question string")
    for mode in V.MODES:
        got = {(r["qid"], r["rank"]): r["id"] for r in V.search(corpus, vectors, asked, encoder, mode).collect()}
        assert got[1, 1] == "0" and not any(q == 3 for q, _ in got)
    with pytest.raises(ValueError, match="unknown"):
        V.search(corpus, vectors, asked, encoder, "best")
    found = V.served(corpus, vectors, asked, encoder, path, str(tmp_path / "ledger"), "bm25-v2")
    rows = {r["qid"]: r for r in sinks.latest(spark, str(tmp_path / "ledger"), "qid").collect()}
    assert rows[1]["ids"][0] == "0" and rows[3]["ids"] == [] and json.loads(rows[2]["metadata"])["index"] is None and found.count() == sum(len(r["ids"]) for r in rows.values())
