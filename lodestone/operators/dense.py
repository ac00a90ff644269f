"""Dense retrieval: an encoder boundary, index tables with an identity, and a router over sparse, dense and fused search.

An encoder is any picklable object with ``name``, ``width`` and ``encode(list of token lists) -> matrix``; the one here
hashes tokens and stands where a model's would.  An index is a folder of vectors and a manifest; it is written beside its
place and moved there whole, and opened only if its manifest's identity and digest still fit.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.structure import row_sums
from ..scratch import written
from ..sources.sinks import upsert
from . import datasets as D
from . import retrieval as R
from .retrieval import parts

MODES = ("bm25-v2", "dense-v1", "hybrid-rrf-v1")
SIZE, OVERLAP = 220, 32


class Encoder(Protocol):
    name: str
    width: int

    def encode(self, texts: list[list[str]]) -> np.ndarray: ...


class HashingEncoder:
    """Mean of signed unit axes of the tokens' MD5, of length 1; a text without tokens is the zero vector."""

    def __init__(self, width: int = 64):
        self.name, self.width = f"hashing-{width}", width

    def encode(self, texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, tokens in zip(out, texts, strict=True):
            for t in tokens:
                h = hashlib.md5(t.encode()).hexdigest()
                row[int(h[:4], 16) % self.width] += 1 - 2 * (int(h[4], 16) % 2)
        length = np.sqrt((out**2).sum(1, keepdims=True))
        return out / np.where(length > 0, length, 1)


def encoded(df: DataFrame, encoder: Encoder, tokens: str = "tokens") -> DataFrame:
    """The rows with ``vector`` in place of their tokens."""
    rest = [c for c in df.columns if c != tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            m = encoder.encode([x or [] for x in batch.column(tokens).to_pylist()])
            vector = pa.array(list(np.asarray(m, dtype=np.float64)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], vector], names=[*rest, "vector"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "vector array<double>"]))


def chunk_tokens(corpus: DataFrame) -> DataFrame:
    """(id, chunk, start, end, tokens): overlapping windows over a document's tokens."""
    t = T.tokens(F.col("text"))
    windows = F.get(F.transform(F.array(t), lambda t: F.transform(D.chunks(t, SIZE, OVERLAP), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.slice(t, (w["start"] + 1).cast("int"), (w["end"] - w["start"]).cast("int")).alias("tokens")))), F.lit(0))
    return corpus.select("id", F.posexplode(windows).alias("chunk", "w")).select("id", F.col("chunk").cast("long").alias("chunk"), "w.*")


def identity(corpus: DataFrame, encoder: Encoder) -> dict:
    """What an index depends on: the encoder, the windows, and the documents in any order."""
    return {"encoder": encoder.name, "width": encoder.width, "size": SIZE, "overlap": OVERLAP, "corpus": row_sums(corpus, "id", "text").first()["fingerprint"]}


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _digest(vectors: DataFrame) -> str:
    return row_sums(vectors.select("id", "chunk", F.to_json("vector").alias("v")), "id", "chunk", "v").first()["fingerprint"]


def build_index(corpus: DataFrame, path: str, encoder: Encoder) -> dict:
    """The manifest of the index at ``path``: built if nothing is there, else opened and checked."""
    spark = corpus.sparkSession
    fs, place = _files(spark, path)
    if fs.exists(place):
        open_index(corpus, path, encoder)
        return manifest(spark, path)
    staging = f"{path}.building-{uuid.uuid4().hex}"
    encoded(chunk_tokens(corpus), encoder).write.parquet(f"{staging}/vectors")
    made = spark.read.parquet(f"{staging}/vectors")
    said = {"identity": identity(corpus, encoder), "chunks": made.count(), "digest": _digest(made)}
    spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/manifest")
    if not fs.rename(_files(spark, staging)[1], place):
        raise FileExistsError(path)
    return said


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def open_index(corpus: DataFrame, path: str, encoder: Encoder) -> DataFrame:
    """The vectors (id, chunk, start, end, vector), if the index fits its manifest, the encoder and the documents."""
    spark = corpus.sparkSession
    said, vectors = manifest(spark, path), spark.read.parquet(f"{path}/vectors")
    if said["identity"] != identity(corpus, encoder):
        raise ValueError("the index is of other documents or another encoder")
    if said["digest"] != _digest(vectors) or audit(vectors, encoder.width).filter("misshapen + not_unit + not_finite > 0").count():
        raise ValueError("the index's vectors are damaged")
    if vectors.select("id").distinct().join(corpus.select("id").distinct(), "id", "full_outer").count() != corpus.select("id").distinct().count():
        raise ValueError("the index holds other documents")
    return vectors


def audit(vectors: DataFrame, width: int) -> DataFrame:
    """One row: chunks, documents, and vectors of a wrong width, of a length that is neither 1 nor 0, or not finite."""
    n = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.agg(F.count("*").alias("chunks"), F.count_distinct("id").alias("documents"), F.count_if(F.size("vector") != width).alias("misshapen"), F.count_if((F.abs(F.sqrt(n) - 1) > 1e-4) & (n > 0)).alias("not_unit"), F.count_if(F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"))


def search(corpus: DataFrame, vectors: DataFrame, questions: DataFrame, encoder: Encoder, mode: str = "hybrid-rrf-v1", k: int = 3) -> DataFrame:
    """(qid, rank, id, score) in a mode; blank questions get nothing; fusion takes ``CANDIDATES`` of each list, or k if that is more."""
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode: {mode}")
    asked = questions.filter(F.trim("question") != "")
    if mode == "bm25-v2":
        return R.bm25_search(corpus, asked, k, boost=False)
    deep = k if mode == "dense-v1" else max(k, R.CANDIDATES)
    dense = R.dense_search(vectors, encoded(asked.select("qid", T.tokens(F.col("question")).alias("tokens")), encoder), deep)
    if mode == "dense-v1":
        return dense
    sparse = R.bm25_search(corpus, asked, deep, boost=False)
    lists = sparse.select(F.lit("bm25").alias("source"), "qid", "rank", "id").unionByName(dense.select(F.lit("dense").alias("source"), "qid", "rank", "id"))
    return R.fuse(lists, k)


def metadata(spark: SparkSession, path: str, mode: str) -> dict:
    """What a search in a mode rests on."""
    said = manifest(spark, path)
    return {"retriever": mode, "corpus": said["identity"]["corpus"], "index": said["digest"] if mode != "bm25-v2" else None, "candidates": R.CANDIDATES, "rrf_k": R.RRF_K if mode == "hybrid-rrf-v1" else None}


def served(corpus: DataFrame, vectors: DataFrame, questions: DataFrame, encoder: Encoder, path: str, ledger: str, mode: str = "hybrid-rrf-v1", k: int = 3) -> DataFrame:
    """The search's rows, written once, after a batch of the ledger has taken one row for each question: its digest, what it got, and what the search rested on."""
    found = written(search(corpus, vectors, questions, encoder, mode, k))
    got = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    said = json.dumps(metadata(corpus.sparkSession, path, mode), sort_keys=True)
    upsert(questions.join(got, "qid", "left").select("qid", F.sha2("question", 256).alias("question_sha256"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.lit(said).alias("metadata")), ledger)
    return found
