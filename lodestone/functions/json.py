"""JSON texts as Column expressions: the end of the first object, strict objects, title keys."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What decides the structure: a whole string (or one without an end), an opening or a closing mark.
_PARTS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{\[\]}]', re.S)
_CLOSES = {"}": "{", "]": "["}


def object_end(text: str | None) -> int | None:
    """Characters up to the end of the object that a text starts with (behind white space), valid inside or not; None if it doesn't close."""
    if text is None or not text.lstrip().startswith("{"):
        return None
    depth: list[str] = []
    for part in _PARTS.finditer(text):
        mark = part.group()
        if mark in ("{", "["):
            depth.append(mark)
        elif mark in _CLOSES:
            if depth[-1] != _CLOSES[mark]:
                return None
            depth.pop()
            if not depth:
                return part.end()
    return None


def first_object_end(text: Column) -> Column:
    return F.arrow_udf(lambda texts: pa.array([object_end(t) for t in texts.to_pylist()], pa.int64()), "bigint")(text)


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else."""
    return F.coalesce((first_object_end(text) == F.length(F.rtrim(text))) & F.get_json_object(text, "$").isNotNull(), F.lit(False))


def title_key(text: Column) -> Column:
    """NFKD without what isn't ASCII, case-folded, other runs than letters and digits a space."""
    fold = lambda x: re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().casefold()).strip()
    return F.arrow_udf(lambda texts: pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string()), "string")(text)


def field_errors(raw: Column, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """object_required, or missing_fields and unexpected_fields of a JSON object's text."""
    keys = F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.json_object_keys(raw))
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) > 0
    more = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in required + optional]))) > 0
    return F.when(keys.isNull(), F.array(F.lit("object_required"))).otherwise(F.array_compact(F.array(F.when(missing, "missing_fields"), F.when(more, "unexpected_fields"))))
