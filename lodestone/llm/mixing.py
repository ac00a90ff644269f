"""Operator 2: mix sources to target weights.

Aggregate sizes per source, solve for the targets, derive each source's repetition rate, then emit every
document floor(rate) times plus one hash-seeded Bernoulli copy with probability rate - floor(rate).

Defined cases: a null or empty text has size 0; a null source is a source of its own, last in order; a source
whose size is 0 has rate 0; rows that repeat a doc_id draw the same copies; an empty table gives an empty mix;
``rates`` reads no other column; ``mix`` passes all through, whatever their names, but that ``copy``, the number of the
copy, takes the place of one so named, and that names with ``_lodestone_`` in front are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small

WORD = r"[^\x20\x09-\x0D]+"
#: A source's target is at most so many times its size.
CAP = 3
#: Weights of the sources by rank, repeating.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def ranked(sources: DataFrame) -> DataFrame:
    """(source, source_size) with its 0-based rank by code point, null last, by a range sort and partition offsets."""
    in_order = checkpointed(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = in_order.groupBy(part.alias("p")).count().collect()  # one row per partition
    offsets, total = {}, 0
    for row in sorted(counts, key=lambda r: r["p"]):
        offsets[row["p"]] = total
        total += row["count"]
    if not offsets:
        return in_order.select("source", "source_size", F.lit(0).cast("long").alias("rank"))
    start = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return in_order.select("source", "source_size", (start[part] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): shares of the total by weight, capped, the excess reshared until none is above.

    The level L solves sum(min(cap * size, weight * L)) = total; each step fixes the sources above their cap and
    reshares, which is Newton's method on a concave function and ends after at most as many steps as there are caps.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    table = checkpointed(ranked(sources).select("source", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("cap")))
    total, mass = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    level = total / mass if mass else 0.0
    while True:
        above = F.col("cap") <= F.col("w") * F.lit(level)
        capped, free = table.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0))).first()
        if not free or (total - capped) / free <= level:
            break
        level = (total - capped) / free
    return table.select("source", "source_size", F.when(above, F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every document.

    The narrow (doc_id, source, size) table is written once; sums combine before the shuffle, so a hot source costs
    one row per task, and the per-source table is broadcast only when its counted rows are few.
    """
    sized = checkpointed(docs.select("doc_id", F.col("source"), words(F.col("text")).alias("size")))
    per = checkpointed(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = (whole + (uniform(F.col("doc_id"), seed) < rate - whole).cast("long")).cast("long")
    joined = sized.join(small(per), F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, numbered in ``copy``; one pass over the texts."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "copy"]
    per = checkpointed(targets(docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size")), weights, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.select(F.col("source").alias("_lodestone_source"), rate.alias("_lodestone_rate"))
    rate = F.col("_lodestone_rate")
    copies = (F.floor(rate) + (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("int").alias("_lodestone_copies")
    joined = docs.join(small(per), F.col("source").eqNullSafe(F.col("_lodestone_source")), "left").select(*kept, copies).filter("_lodestone_copies > 0")
    return joined.select(*kept, F.explode(F.sequence(F.lit(1), F.col("_lodestone_copies"))).alias("copy"))


def query(spark, sf_dir: str) -> DataFrame:
    return rates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, 3 * source_size AS cap, CAST(1 + (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 AS BIGINT) AS w FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS below, sum(w) OVER a AS rest, sum(source_size) OVER () AS total
      FROM r WINDOW b AS (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT max((total - below)::DOUBLE / rest::DOUBLE) FILTER (WHERE cap::DOUBLE * rest > (total - below)::DOUBLE * w) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap::DOUBLE ELSE w * level END AS target FROM r, l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate) AS BIGINT) + CAST(CAST(('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 < rate - floor(rate) AS BIGINT) AS copies,
  size * (CAST(floor(rate) AS BIGINT) + CAST(CAST(('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 < rate - floor(rate) AS BIGINT)) AS taken
FROM j
"""
