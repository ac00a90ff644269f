"""What the training-data operators share: scratch tables, Arrow maps, sized broadcasts, words, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import _made, checkpointed, mark, release, scratch, since, small, written  # noqa: F401

#: Rows of whole texts that a Python worker gets at once; Spark itself bounds their bytes (``arrow.maxBytesPerBatch``, 64 MB).
BATCH_ROWS = 512

_LOWER = bytes(range(256)).lower()
#: ASCII upper case lowered, other ASCII that is neither letter nor digit made a space; bytes of other characters stay.
ALNUM = bytes(c if c >= 128 or bytes([c]).isalnum() else 32 for c in _LOWER)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for whole long texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links: rows (id, component), component being the smallest id reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on a distributed edge table, cut by a
    checkpoint each round; nothing of the graph comes to the driver but a change count.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(lowest, "u").select("u", F.col("v").alias("w"), "m")
        after = after.filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = checkpointed(after)
        same = edges.exceptAll(after).isEmpty() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
