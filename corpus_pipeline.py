"""A training corpus from ``documents`` in five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept.  ``run`` deletes a stage's intermediate tables once its
result is written.  The first four return the columns of ``documents``; the last one repeats rows, numbered in ``copy``.
SQL can't express the learned lexicon of the first stage, so there is no statement for the whole; the tests hold it
against brute-force versions of the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, mixing, ngram_join, substring, toxicity
from lodestone.llm.common import mark, release, since, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return toxicity.reject(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-gram sets with a Jaccard similarity of 0.8 connect, the one of the smallest doc_id stays."""
    return ngram_join.keep_one(docs, size=5, num=80, den=100)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that an earlier document has too are cut out; n_chars is the new length."""
    cleaned = substring.clean(docs, report=False)
    return cleaned.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = mark()
        docs = written(stage(spark, docs, sf_dir))
        release(tables=since(before)[:-1])  # all but the result, which was written last
    return docs
