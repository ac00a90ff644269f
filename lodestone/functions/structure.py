"""Structure of texts and JSON as Column expressions: sentences, names, spans, fields, masks, windows, fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentence_prefix(text: Column, limit: int) -> Column:
    """The longest start of whole sentences within the limit, or the limit's characters if no sentence ends there."""
    cut = F.substring(text, 1, limit)
    whole = F.regexp_extract(cut, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= limit, text).when(whole != "", whole).otherwise(cut)


def sentences(text: Column) -> Column:
    """Pieces, cut by a fixed pattern, that end behind a mark before a capital, or behind a line end; they make up the text."""
    return F.filter(F.split(text, r"(?<=[.!?])(?=\s+[A-Z])|(?<=\n)"), lambda x: x != "")


def with_offsets(pieces: Column) -> Column:
    """Start and end of each piece in the text that all make up: one running sum over lengths, as an Arrow batch function; no text is sent to it."""

    def running(lists: pa.Array) -> pa.Array:
        sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(sizes)
        ends -= np.repeat(np.concatenate([[0], ends])[at[:-1]], count)  # what stands before the row
        spans = pa.StructArray.from_arrays([pa.array(ends - sizes), pa.array(ends)], names=["start", "end"])
        known = np.concatenate([lists.is_valid().to_numpy(zero_copy_only=False), [True]]).astype(bool)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=~known), spans)

    return F.arrow_udf(running, "array<struct<start:bigint,end:bigint>>")(F.transform(pieces, lambda x: F.length(x)))


def proper_names(text: Column) -> Column:
    """Distinct runs of capitalised ASCII words, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), 1))


def locate(value: Column, docs: Column) -> Column:
    """The first document (id, text) that holds the value, and where; null if none does or the value is empty."""
    hit = F.get(F.filter(docs, lambda d: F.contains(d["text"], value)), F.lit(0))
    start = F.instr(hit["text"], value) - 1
    return F.when((value != "") & hit.isNotNull(), F.struct(hit["id"].alias("id"), start.cast("long").alias("start")))


def think_split(text: Column) -> dict[str, Column]:
    """Reasoning and action of a text with exactly one think pair; without, all of it is action."""
    opens, closes = F.regexp_count(text, F.lit("<think>")), F.regexp_count(text, F.lit("</think>"))
    good = (opens == 1) & (closes == 1)
    return {
        "reasoning": F.when(good, F.trim(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1))),
        "action": F.when(good, F.trim(F.regexp_extract(text, r"(?s)</think>(.*)$", 1))).when((opens == 0) & (closes == 0), F.trim(text)),
        "valid": good | ((opens == 0) & (closes == 0)),
    }


def masked_match(value: Column, masked: Column) -> Column:
    """Whether a value is what a mask of * and • shows: same length, same visible characters."""
    same = F.forall(F.sequence(F.lit(1), F.length(masked)), lambda i: F.substr(masked, i, F.lit(1)).isin("*", "•") | (F.substr(masked, i, F.lit(1)) == F.substr(value, i, F.lit(1))))
    return (F.length(value) == F.length(masked)) & (F.length(masked) > 0) & F.when(F.length(masked) > 0, same).otherwise(False)


def fields_in_order(raw: Column, *fields: str) -> Column:
    """Whether a JSON object has exactly these fields in this order."""
    return F.coalesce(F.json_object_keys(raw) == F.array(*[F.lit(f) for f in fields]), F.lit(False))


def best_excerpt(words: Column, asked: Column, width: int) -> Column:
    """Start (from 0) of the window of ``width`` words with most distinct asked words, then most of them at all, then the earliest."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - width))
    score = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice(words, i + 1, width), asked)).alias("distinct"), F.size(F.filter(F.slice(words, i + 1, width), lambda w: F.array_contains(asked, w))).alias("all"), (-i).alias("at")))
    return F.array_max(score)


def row_sums(df: DataFrame, *columns: str) -> DataFrame:
    """One row: a digest of all rows in any order, and their number.

    Two sums of 60 bits each of the rows' SHA-256 and the count are partial aggregates, so no rows are collected.
    """
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]), 256)
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return df.select(row.alias("h")).agg(F.concat_ws("-", F.coalesce(part(1), F.lit("0")), F.coalesce(part(16), F.lit("0")), F.count("*").cast("string")).alias("fingerprint"), F.count("*").alias("rows"))
