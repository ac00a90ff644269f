"""Operator 5: benchmark decontamination.

One Aho-Corasick automaton over the normalised benchmark windows scans each normalised text once; hits are kept as
word ranges and mapped to character offsets of the original text.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.  The
benchmark comes in blocks of about ``block_bytes`` of window text and item ids, each block being one automaton and one
pass over the texts; after ``PASSES`` of them the rows are written, so what the driver holds and sends has a fixed bound
whatever the benchmark's size.  One block is the normal case.

Defined cases: null and empty texts have no words and no hits; null items have no windows; equal items all count;
rows that repeat a doc_id are scanned each by itself; other columns are not read, or pass through ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, arrow_map, written

WIDTH = 10
BLOCK_BYTES = 32 << 20
#: Passes that one job makes, each with its block.
PASSES = 4


def windows(text: str | None, width: int = WIDTH) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def blocks(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> Iterator[dict[bytes, list[int]]]:
    """Window -> item ids, in blocks of bounded size, streamed to the driver partition by partition."""
    block, size = {}, 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        for w in set(windows(row["text"], width)):
            size += 8 if w in block else len(w) + 8
            block.setdefault(w, []).append(row["item_id"])
        if size >= block_bytes:
            yield block
            block, size = {}, 0
    if block:
        yield block


def automaton(block: dict[bytes, list[int]]) -> ahocorasick.Automaton:
    """Windows between spaces, one character for each byte, so that matches keep byte offsets."""
    found = ahocorasick.Automaton()
    for w, items in block.items():
        found.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(items)))
    found.make_automaton()
    return found


def scan(words: list[bytes], of: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set]:
    """(merged word ranges [start, end) that lie in windows, items whose windows occur)."""
    text = b" " + b" ".join(words) + b" "
    items: set = set()
    ends = [(at, n) for at, (n, of_items) in of.iter(text.decode("latin-1")) if items.update(of_items) is None]
    if not ends:
        return [], items
    ranges: list[tuple[int, int]] = []
    seen, word = 0, -1  # spaces up to ``seen``: one before each word and a last one
    for at, n in ends:
        word += text.count(b" ", seen, at + 1)
        seen = at + 1
        start, end = word - n, word
        while ranges and ranges[-1][1] >= start:
            before = ranges.pop()
            start, end = min(start, before[0]), max(end, before[1])
        ranges.append((start, end))
    return ranges, items


def offsets(text: str) -> list[tuple[int, int]]:
    """Character [start, end) of each word in the original text."""
    found, start = [], -1
    for i, c in enumerate(text):
        inside = c >= "\x80" or c.isalnum()
        if inside and start < 0:
            start = i
        elif not inside and start >= 0:
            found.append((start, i))
            start = -1
    if start >= 0:
        found.append((start, len(text)))
    return found


SPANS = "array<struct<start:int,end:int>>"
RESULT = f"doc_id long, n_words long, word_spans {SPANS}, char_spans {SPANS}, items array<long>"
BETWEEN = f"doc_id long, text string, word_spans {SPANS}, items array<long>"


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _pass(block: dict[bytes, list[int]], last: bool):
    """One automaton over every text; what earlier passes found comes along, so no pass shuffles."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    spans = lambda ranges: [{"start": a, "end": b} for a, b in ranges]

    def run(batches):
        of = automaton(block)
        for batch in batches:
            texts, found = batch.column("text").to_pylist(), []
            before = zip(batch.column("word_spans").to_pylist(), batch.column("items").to_pylist(), strict=True) if "items" in batch.schema.names else (((), ()) for _ in texts)
            for text, (had, items) in zip(texts, before, strict=True):
                words = text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []
                ranges, now = scan(words, of) if words and block else ([], set())
                found.append((len(words), merged([*ranges, *((x["start"], x["end"]) for x in had)]) if had else ranges, sorted({*now, *items})))
            word_spans = pa.array([spans(r) for _, r, _ in found], span)
            items = pa.array([i for _, _, i in found], pa.list_(pa.int64()))
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), word_spans, items], names=["doc_id", "text", "word_spans", "items"])
                continue
            chars = []
            for text, (_, ranges, _) in zip(texts, found, strict=True):
                at = offsets(text) if ranges else []
                chars.append(spans((at[a][0], at[b - 1][1]) for a, b in ranges))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()), word_spans, pa.array(chars, span), items], names=["doc_id", "n_words", "word_spans", "char_spans", "items"])

    return run


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, word_spans, char_spans (of the original text), items; no shuffle."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made, block = 0, {}
    for after in blocks(benchmark, width, block_bytes):
        if block:
            found, made = arrow_map(found, _pass(block, False), BETWEEN), made + 1
            found = found if made % PASSES else written(found)
        block = after
    return arrow_map(found, _pass(block, True), RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any that hold a benchmark window; columns and clean rows unchanged, in one pass."""

    def keep(block):
        def run(batches):
            of = automaton(block)
            for batch in batches:
                texts = batch.column("text").cast(pa.string()).to_pylist()
                yield batch.filter(pa.array([not t or not scan(t.encode("utf-8", "surrogatepass").translate(ALNUM).split(), of)[0] for t in texts], pa.bool_()))

        return run

    for made, block in enumerate(blocks(benchmark, width)):
        docs = arrow_map(docs if made == 0 or made % PASSES else written(docs), keep(block), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    found = hits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    length = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", length.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("word_spans") > 0).alias("contaminated"))


def brute(texts: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple]:
    """For tests: the query's rows by comparing every place with every window."""
    own = [(i, [w.split(b" ") for w in windows(t, width)]) for i, t in items]
    out = []
    for doc_id, text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []
        hit, found = set(), set()
        for i, ws in own:
            for w in ws:
                for at in range(len(words) - len(w) + 1):
                    if words[at : at + len(w)] == w:
                        hit.update(range(at, at + len(w)))
                        found.add(i)
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, n.n, p, array_to_string(w[p : p + n.n - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), n WHERE p + n.n - 1 <= len(w)),
m AS (SELECT o.doc_id, o.p, o.n, g.item_id FROM o JOIN g ON o.n = g.n AND o.s = g.s),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
