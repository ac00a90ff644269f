"""Operator 10: substring dedup by hashing units of text.

A text is cut into units: lines, and the sentences of a line.  From each unit that has words on, the shortest run of
units of at least ``LEAST_WORDS`` words, mostly the unit alone, is normalised and hashed to 128 bits; runs of short units
go on over sentence and line ends and overlap, so a passage matches wherever it begins.  Digests are reduced globally, before the shuffle too, to the least and greatest doc_id that
has them, and only digests of several documents are joined back to their documents; a hot digest's documents can be
split among tasks, since its other side is one row.  Every occurrence but the earliest (by doc_id, then position) is
removed.  Short units that no such run takes go only where the long units of the line around them go.  What is removed is kept as character
ranges of the original text.

Defined cases: null and empty texts have no units and stay; a text that repeats within itself keeps the first place, also where
its later places overlap it; texts of fewer words in all than ``LEAST_WORDS`` stay;
documents rank by doc_id; rows without one rank last, by their texts, each as a document of its own (they take the
``2**52`` largest numbers, which no doc_id may have then); rows of one doc_id count as one document and lose nothing to each other; units
of any length are hashed whole; an empty table gives an empty one; other columns pass through, whatever their names, with ``text`` replaced; with a
report, its columns ``removed``, ``units`` and ``chars_before`` take the place of any that are so named.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, arrow_map, written

#: Words that a unit, or a run of units, has at least to be removed on its own account.
LEAST_WORDS = 6
#: A unit ends at a line end, or after a full stop, question or exclamation mark before white space.
UNIT = re.compile(r"[^\n]*?(?:[.?!](?=[ \t])|\n|$)", re.S)


def units(text: str) -> list[tuple[int, int]]:
    """Character [start, end) of the units, which make up the text without a gap; white space goes with what follows it."""
    out, at = [], 0
    while at < len(text):
        end = max(UNIT.match(text, at).end(), at + 1)
        out.append((at, end))
        at = end
    return out


def digest(unit: str) -> bytes | None:
    """128 bits of the unit's words, or None if they are too few."""
    words = unit.encode("utf-8", "surrogatepass").translate(ALNUM).split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if len(words) >= LEAST_WORDS else None


def runs(text: str, cut: list[tuple[int, int]]) -> list[tuple[int, int, bytes]]:
    """(first unit, last unit, 128 bits of the words) of the shortest run of ``LEAST_WORDS`` words from each unit with words."""
    words = [text[a:b].encode("utf-8", "surrogatepass").translate(ALNUM).split() for a, b in cut]
    out, j, n = [], -1, 0
    for i, own in enumerate(words):
        while n < LEAST_WORDS and j + 1 < len(words):
            j += 1
            n += len(words[j])
        if n < LEAST_WORDS:
            break
        if own:
            out.append((i, j, hashlib.blake2b(b" ".join([w for x in words[i : j + 1] for w in x]), digest_size=16).digest()))
        n -= len(own)
    return out


def _beside(line: list[int], long: set[int]) -> dict[int, int | None]:
    """For each unit of a line the long unit passed last before it."""
    out, last = {}, None
    for i in line:
        out[i] = last
        last = i if i in long else last
    return out


def removed(text: str, gone: set[int]) -> list[tuple[int, int]]:
    """Character ranges that go: the units of these numbers, and short units of a line between or beside such long units.

    A short unit goes if, within its line, the nearest long unit before it and the nearest after it go, a missing
    one being no objection so long as the other is there.
    """
    if not gone:
        return []
    cut, lines = units(text), []
    for i, (a, b) in enumerate(cut):
        if i == 0 or text[cut[i - 1][1] - 1] == "\n":
            lines.append([])
        lines[-1].append(i)
    out: list[tuple[int, int]] = []
    for line in lines:
        if not gone.intersection(line):
            continue
        long = {i for i in line if digest(text[slice(*cut[i])]) is not None}
        before, after = _beside(line, long), _beside(line[::-1], long)
        for i in line:
            beside = [j for j in (before[i], after[i]) if j is not None]
            if i in gone or i not in long and beside and all(j in gone for j in beside):
                if out and out[-1][1] == cut[i][0]:
                    out[-1] = (out[-1][0], cut[i][1])
                else:
                    out.append(cut[i])
    return out


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    at, kept = 0, []
    for a, b in ranges:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


#: Documents without an id are numbered from here.
UNNAMED = 2**63 - 2**52
GONE, RANK = "_lodestone_gone", "_lodestone_rank"


def _places(batches):
    """A row for each digest of a text, as two longs."""
    for batch in batches:
        ids, hashes = [], []
        for rank, text in zip(batch.column(RANK).to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            own = {h for _, _, h in runs(text, units(text))} if text else ()
            ids += [rank] * len(own)
            hashes += own
        two = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["d", "h1", "h2"])


def ranked(docs: DataFrame) -> DataFrame:
    """The documents with their rank; those without an id are numbered once, in a written table, so that reruns agree."""
    unnamed = docs.filter("doc_id is null")
    named = docs.withColumn(RANK, F.col("doc_id").cast("long"))
    if unnamed.isEmpty():
        return named
    numbered = written(unnamed.orderBy(F.col("text").cast("string")).withColumn(RANK, F.lit(UNNAMED) + F.monotonically_increasing_id()))
    return named.filter("doc_id is not null").unionByName(numbered)


def repeats(docs: DataFrame) -> DataFrame:
    """(d, gone): the digests (first halves) that a ranked document has in common with an earlier one."""
    texts = docs.select(RANK, F.col("text").cast("string").alias("text"))
    places = written(arrow_map(texts, _places, "d long, h1 long, h2 long"))
    first = places.groupBy("h1", "h2").agg(F.min("d").alias("least"), F.max("d").alias("most")).filter("least < most").select("h1", "h2", "least")
    return places.join(first, ["h1", "h2"]).filter("d > least").groupBy("d").agg(F.collect_set("h1").alias("gone"))


def later(own: list[tuple[int, int, bytes]], gone: set[int]) -> set[int]:
    """The units that go: of runs that an earlier document has, and of repeated runs what lies behind their first place."""
    out, first = set(), {}
    for i, j, h in own:
        h = int.from_bytes(h[:8], "little", signed=True)
        out.update(range(i if h in gone else max(i, first[h] + 1) if h in first else j + 1, j + 1))
        first.setdefault(h, j)
    return out


SPANS = "array<struct<start:int,end:int>>"


REPORT = ("removed", "units", "chars_before")


def _clean(columns: list[str], report: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts, spans, counts = batch.column("text").to_pylist(), [], []
            for i, gone in enumerate(batch.column(GONE).to_pylist()):
                text, ranges = texts[i] or "", []
                cut = units(text)
                out = later(runs(text, cut), set(gone or ()))
                if out:
                    ranges = removed(text, out)
                    texts[i] = without(text, ranges)
                counts.append((len(cut), len(text)))
                spans.append([{"start": a, "end": b} for a, b in ranges])
            own = {"text": pa.array(texts, pa.string())}
            if report:
                own |= {"removed": pa.array(spans, span), "units": pa.array([c[0] for c in counts], pa.int64()), "chars_before": pa.array([c[1] for c in counts], pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in columns], names=columns)

    return run


def clean(docs: DataFrame, report: bool = True) -> DataFrame:
    """The documents with later occurrences cut out of ``text``.

    With a report, also ``removed`` (the ranges of the original text), ``units`` and ``chars_before``.  The lists of
    lost digests are the build side of a hash join, so texts are shuffled once and never sorted.
    """
    kept = docs.drop(*REPORT) if report else docs
    order = ranked(kept)
    gone = repeats(order).select(F.col("d").alias("_lodestone_d"), F.col("gone").alias(GONE))
    both = order.join(gone.hint("shuffle_hash"), order[RANK] == gone["_lodestone_d"], "left").drop("_lodestone_d", RANK)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ([f"removed {SPANS}, units long, chars_before long"] if report else [])
    return arrow_map(both, _clean([*kept.columns, *(REPORT if report else ())], report), ", ".join(fields))


def query(spark, sf_dir: str) -> DataFrame:
    found = clean(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.col("chars_before").alias("n_chars"), "units", size.alias("removed_chars"), F.size("removed").cast("long").alias("n_spans"), spans.alias("spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int | None, str | None]]) -> list[str | None]:
    """For tests: the kept texts, by walking all runs in rank order; doc_ids must be distinct, but for nulls."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    seen: dict[bytes, tuple[int, int]] = {}  # of each run, the row and the last unit of its first place
    out: list[str | None] = [t for _, t in rows]
    for i in order:
        text, gone = rows[i][1], set()
        cut = units(text) if text else []
        words = [text[a:b].encode().translate(ALNUM).split() for a, b in cut]
        for a in range(len(cut)):
            b = next((b for b in range(a, len(cut)) if sum(map(len, words[a : b + 1])) >= LEAST_WORDS), None)
            if words[a] and b is not None:
                row, end = seen.setdefault(b" ".join(w for x in words[a : b + 1] for w in x), (i, b))
                gone |= {n for n in range(a, b + 1) if row != i or n > end}
        if gone:
            out[i] = without(text, removed(text, gone))
    return out


SQL = r"""
WITH p AS (SELECT doc_id, text, string_split(replace(regexp_replace(coalesce(text, ''), '([.?!])([ \t])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS l FROM documents),
e AS (SELECT doc_id, u, n FROM (SELECT doc_id, unnest(l) AS u, unnest(range(0, len(l))) AS n FROM p) WHERE u <> ''),
w AS (SELECT *, regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
  sum(length(u)) OVER d - length(u) AS a, coalesce(sum(CAST(ends_with(u, chr(10)) AS INT)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
v AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY n) AS c FROM w),
f AS (SELECT doc_id, n, c, c - len(w) AS b FROM v WHERE len(w) > 0),
z AS (SELECT s.doc_id, s.n AS i, t.n AS j, s.b, t.c FROM f s ASOF JOIN f t ON s.doc_id = t.doc_id AND s.b + 6 <= t.c),
y AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS y FROM documents),
k AS (SELECT z.doc_id, i, j, array_to_string(y[b + 1 : c], ' ') AS k FROM z JOIN y ON z.doc_id = y.doc_id),
q AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least, first_value(j) OVER (PARTITION BY k, doc_id ORDER BY i) AS j0 FROM k),
x AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id > least THEN i ELSE greatest(i, j0 + 1) END, j + 1)) AS n FROM q),
g AS (SELECT v.*, x.n IS NOT NULL AS gone, CASE WHEN len(w) >= 6 THEN x.n IS NOT NULL END AS long FROM v LEFT JOIN x ON v.doc_id = x.doc_id AND v.n = x.n),
s AS (SELECT *, last_value(long IGNORE NULLS) OVER (PARTITION BY doc_id, line ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(long IGNORE NULLS) OVER (PARTITION BY doc_id, line ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM g),
o AS (SELECT *, gone OR (long IS NULL AND (before IS NOT NULL OR after IS NOT NULL) AND coalesce(before, true) AND coalesce(after, true)) AS goes FROM s),
i AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM o),
r AS (SELECT doc_id, count(*) AS c, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM (SELECT doc_id, min(a) AS a, max(a + length(u)) AS b FROM i WHERE goes GROUP BY doc_id, island) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS units, coalesce(sum(length(u)) FILTER (WHERE goes), 0) AS size, coalesce(string_agg(u, '' ORDER BY n) FILTER (WHERE NOT goes), '') AS kept FROM o GROUP BY doc_id)
SELECT d.doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, coalesce(units, 0)::BIGINT AS units, coalesce(size, 0)::BIGINT AS removed_chars, coalesce(c, 0)::BIGINT AS n_spans, coalesce(spans, '') AS spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
"""
