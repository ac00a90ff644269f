"""Operator 11: document fingerprints by order MinHash, in Spark expressions alone.

A text's letters are its words, cut into pieces of at most 16 characters, so that a text without spaces has letters too.
Its k-mers are three letters in a row, each numbered by how often it occurred before.  One 64-bit hash orders the
numbered k-mers and its top 6 bits deal them to 64 cells (one-permutation hashing, in place of 64 hash functions); of
each cell the two smallest are taken, put back into text order, and the ordered pair is hashed.  A pair is the same in
two texts only if both k-mers are, and stand in the same order, so likeness falls with the edit distance and not only
with the shared content.  The likeness of two fingerprints is the share of equal cells among those that either fills.

Work per text is linear but for two sorts of longs and, for repeated k-mers, the logarithm of their number; nothing of a text leaves its row.  ``with_next`` meets neighbours by
one shuffle of the texts and one of the parts that neighbours take; the order of the ids is made on narrow rows.

Defined cases: a null text is an empty one; a text without words has an empty fingerprint, like another one by 1 and any
other by 0; a text of fewer than three letters is one k-mer; equal texts have equal fingerprints.  In the order of
ids nulls stand last; rows of one id follow by a digest of id and text, and rows that repeat id and text are one document there, each
of them with its results; the only document is next to itself; an empty table gives no rows; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SPACE = r"[\x20\x09-\x0D]+"
LETTER, LONGEST = r"[^\x20\x09-\x0D]{1,16}", 16
#: Letters of a k-mer, and bits of a cell's number.
K, CELL_BITS = 3, 6
#: Low bits hold a place, which is below 2^30 in any string that Spark holds; the others hold a hash.
PLACE_BITS = 30
_LOW = (1 << PLACE_BITS) - 1
#: Occurrences found by looking back one by one; more are counted by halving steps.
_NEAR = 4


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_LOW)).bitwiseOR(place.cast("long"))


def _top(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _cell(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - CELL_BITS)


def _numbered(kmers: Column, steps: Column) -> Column:
    """Of k-mers sorted by hash and place: a first occurrence keeps its hash, the n-th takes the hash of both."""

    def value(x, j):
        same = lambda back: _top(F.get(kmers, j - back)) == _top(x)  # noqa: E731  (null before the first)
        number = F.aggregate(steps, F.lit(_NEAR), lambda n, s: F.when(same(n + s), n + s).otherwise(n))  # equal ones are neighbours
        for n in range(_NEAR, 1, -1):
            number = F.when(same(F.lit(n)), number).otherwise(F.lit(n - 1))
        return F.when(same(F.lit(1)), _packed(F.xxhash64(_top(x), number), _place(x))).otherwise(x)

    return F.transform(kmers, value)


def fingerprinted(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """The frame with a column ``out`` (array<long>: cell number above, hash of its tuple in the low 32 bits) for its column ``text``.

    Names with ``_omh_`` in front are the function's own.  Each step is a projection of its own, as an array that a lambda
    reads must be a column: within the lambda it would be made again for each element."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # what stands between spaces are the letters, unless a word is longer than a letter; splitting is faster than matching
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    df = df.select("*", F.transform(words, lambda w: F.when(F.length(w) <= LONGEST, F.xxhash64(w)).otherwise(F.lit(-1).cast("long"))).alias("_omh_w"))
    cut = F.transform(F.regexp_extract_all(whole, F.lit(LETTER), 0), lambda w: F.xxhash64(w))
    df = df.select(*kept, F.when(F.array_contains("_omh_w", F.lit(-1).cast("long")), cut).otherwise(F.col("_omh_w")).alias("_omh_l"))
    l, m = F.col("_omh_l"), F.col("_omh_m")
    rows = F.greatest(F.size(l) - (k - 1), F.lit(1))
    kmers = F.transform(F.arrays_zip(*[F.slice(l, F.lit(j + 1), rows).alias(f"c{j}") for j in range(k)]), lambda x, i: _packed(F.xxhash64(x), i))
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(l) + 1)).cast("int"), F.lit(0)), lambda b: F.pow(F.lit(2), b).cast("int"))
    df = df.select(*kept, F.sort_array(kmers).alias("_omh_k"), steps.alias("_omh_s"))
    df = df.select(*kept, F.sort_array(_numbered(F.col("_omh_k"), F.col("_omh_s"))).alias("_omh_n"))
    n = F.col("_omh_n")
    df = df.select(*kept, F.filter(n, lambda x, j: (j < 2) | (_cell(F.get(n, j - 2)) != _cell(x))).alias("_omh_m"))  # two of each cell

    def entry(x, j):
        y = F.get(m, j + 1)
        pair = F.when(_place(x) < _place(y), F.xxhash64(_top(x), _top(y))).otherwise(F.xxhash64(_top(y), _top(x)))
        hashed = F.when(F.coalesce(_cell(y) == _cell(x), F.lit(False)), pair).otherwise(F.xxhash64(_top(x)))
        return F.when((j > 0) & (_cell(F.get(m, j - 1)) == _cell(x)), F.lit(-1).cast("long")).otherwise(F.shiftleft(_cell(x), 32).bitwiseOR(hashed.bitwiseAND(F.lit(0xFFFFFFFF))))

    return df.select(*kept, F.filter(F.transform(m, entry), lambda e: e >= 0).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal cells among those that either fingerprint fills; 1 for two empty ones."""
    cells = lambda x: F.transform(x, lambda e: F.shiftright(e, 32))
    filled = F.size(F.array_union(cells(a), cells(b)))
    return F.when(filled > 0, F.size(F.array_intersect(a, b)) / filled).otherwise(F.lit(1.0))


def as_text(fingerprint: Column) -> Column:
    """Ten hexadecimal digits for each filled cell."""
    return F.array_join(F.transform(fingerprint, lambda e: F.lower(F.lpad(F.hex(e), 10, "0"))), "")


def _places(rows: DataFrame) -> DataFrame:
    """(key, doc_id, n_chars, place, total): the rows range-sorted by (doc_id, key), numbered from 0 by partition offsets."""
    in_order = checkpointed(rows.orderBy(F.col("doc_id").asc_nulls_last(), "key").withColumn("_at", F.monotonically_increasing_id()))
    counts = in_order.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()  # one row for each partition
    offsets, total = {}, 0
    for row in sorted(counts, key=lambda r: r["p"]):
        offsets[row["p"]] = total
        total += row["count"]
    if not total:
        return in_order.select("key", "doc_id", "n_chars", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("total"))
    start = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    place = start[F.shiftright("_at", 33)] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return in_order.select("key", "doc_id", "n_chars", place.cast("long").alias("place"), F.lit(total).cast("long").alias("total"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, print, edited, edited_print, next_print): each document, its text edited by its successor's, and their fingerprints.

    Documents meet under a digest of id and text, by which the texts are shuffled once; only the heads that go to
    predecessors are shuffled again."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))).alias("key"))
    order = checkpointed(_places(keyed.select("doc_id", "key", F.length("text").cast("long").alias("n_chars")).distinct()))
    # for each document its predecessor, which takes the head of its text
    before = order.select(((F.col("place") + 1) % F.col("total")).alias("place"), F.col("key").alias("before"), F.col("n_chars").alias("n_before"))
    wanted = checkpointed(order.select("key", "doc_id", "place").join(before, "place").drop("place"))
    # both sides below read the same columns of the texts (the id comes from the narrow side), so that their shuffle is made once
    placed = fingerprinted(keyed.select("key", "text"), "text", "print").join(wanted.hint("shuffle_hash"), "key")
    n = F.length("text").cast("long")
    own = placed.select("key", "doc_id", n.alias("n_chars"), F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")).alias("head"), "print")
    given = placed.select(F.col("before").alias("key"), F.substring("text", F.lit(1), F.floor(F.col("n_before") / 2).cast("int")).alias("tail"), F.col("print").alias("next_print"))
    given = given.groupBy("key").agg(F.first(F.struct("tail", "next_print")).alias("g")).select("key", "g.*")
    met = own.join(given, "key").select("doc_id", "n_chars", "print", F.concat("head", "tail").alias("edited"), "next_print")
    return fingerprinted(met, "edited", "edited_print")


def query(spark, sf_dir: str) -> DataFrame:
    found = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
