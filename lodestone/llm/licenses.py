"""Operator 9: fuzzy search for short license notices.

Texts and notices are normalised to words between single spaces.  A notice that may have k errors is cut into k + 1
pieces; by the pigeonhole principle every match within k edits holds one piece unchanged, so one Aho-Corasick pass over
the pieces gives all candidate places, and the ``regex`` library's bounded-error matching verifies each place and
reports its span and edits.  Exact places are counted apart: they are the base that the labels rest on.

Defined cases: null and empty texts have no words and no labels; overlapping exact places all count; the search runs
over whole texts of any length, in memory proportional to one text; rows that repeat a doc_id are searched each by
itself; no other column is read.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, arrow_map

#: Phrases and labels that count as base places.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices that the method itself labels.
NOTICES = BASE | {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 3 clause license": "bsd",
    "bsd 2 clause license": "bsd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
}
#: One edit for so many characters of a notice, two at most.
CHARACTERS_AN_EDIT = 11


def edits(notice: str) -> int:
    return min(2, len(notice) // CHARACTERS_AN_EDIT)


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length with their offsets."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    """The pieces' automaton and a bounded-error pattern for each notice."""

    def __init__(self, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE):
        self.notices, self.base = list(notices.items()), base
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        self.errors, self.patterns = [], []
        for k, (notice, _) in enumerate(self.notices):
            n = edits(notice)
            self.errors.append(n)
            self.patterns.append([regex.compile(rf"(?<= )(?:{regex.escape(notice)}){{e<={m}}}(?= )") for m in range(1, n + 1)])
            for offset, piece in pieces(notice, n):
                at.setdefault(piece, []).append((k, offset))
        for piece, uses in at.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def __call__(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(notice number, first character, end, edits) in the joined text; for each notice, no two spans overlap."""
        text = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
        windows: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.seeds.iter(text):
            for k, offset in uses:
                slack = self.errors[k]
                start = end + 1 - size - offset
                a, b = max(0, start - slack - 1), min(len(text), start + len(self.notices[k][0]) + slack + 1)
                own = windows.setdefault(k, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])
        found = []
        for k, places in windows.items():
            notice = self.notices[k][0]
            for a, b in places:
                rest, at = [], text.find(f" {notice} ", a, b)
                while at >= 0:
                    found.append((k, at + 1, at + 1 + len(notice), 0))
                    rest.append((a, at + 1))
                    a = at + 1 + len(notice)
                    at = text.find(f" {notice} ", a, b)
                rest.append((a, b))
                for pattern in self.patterns[k]:  # fewer edits first; what lies between the matches is searched with one more
                    left = []
                    for a, b in rest:
                        for m in pattern.finditer(text, a, b):
                            found.append((k, m.start(), m.end(), sum(m.fuzzy_counts)))
                            left.append((a, m.start()))
                            a = m.end()
                        left.append((a, b))
                    rest = left
        return sorted(found)


def base_places(words: list[bytes], base: dict[str, str] = BASE) -> list[tuple[int, str]]:
    """(number of the first word, label) of every exact place, overlapping ones included."""
    text, found = b" ".join([b"", *words, b""]), []
    for phrase, label in base.items():
        needle = f" {phrase} ".encode()
        at = text.find(needle)
        while at >= 0:
            found.append((at, label))
            at = text.find(needle, at + 1)
    found.sort()
    out, seen, word = [], 0, 0
    for at, label in found:
        word += text.count(b" ", seen, at)
        seen = at
        out.append((word, label))
    return out


SPAN = "struct<label:string,notice:string,start_word:long,end_word:long,matched:string,edits:int>"
RESULT = f"doc_id long, n_words long, base array<struct<word:long,label:string>>, spans array<{SPAN}>"


def _search(notices, base):
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("matched", pa.string()), ("edits", pa.int32())]))),
    ])

    def run(batches):
        search = Searcher(notices, base)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = alnum_words(text.as_py())
                spans = []
                if found := search(words) if words else []:
                    joined = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
                    for k, a, b, n in found:
                        first = joined.count(" ", 0, a) - 1
                        spans.append({"label": search.notices[k][1], "notice": search.notices[k][0], "start_word": first, "end_word": first + joined.count(" ", a, b) + 1, "matched": joined[a:b], "edits": n})
                rows.append({"doc_id": doc_id, "n_words": len(words), "base": [{"word": w, "label": x} for w, x in (base_places(words, base) if words else [])], "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def search(docs: DataFrame, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, base places, and spans (label, notice, words, matched text, edits); one pass, no shuffle."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _search(notices, base), RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """score: 1 for an exact notice, else one less the share of a notice's characters that the best match edits; 0 if none."""
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_distinct(F.transform("base", lambda x: x["label"]))
    own = F.transform("spans", lambda x: x["label"])
    near = F.array_max(F.transform("spans", lambda x: 1.0 - x["edits"] / F.length(x["notice"])))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"), F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(near, F.lit(0.0))).alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )


def brute(text: str | None, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE) -> tuple:
    """For tests: (n_words, base places, labels of notices with a match) by trying every place of the text."""
    words = [w.decode() for w in alnum_words(text)]
    places = sorted((i, label) for phrase, label in base.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    joined = " " + " ".join(words) + " "
    labels = set()
    for notice, label in notices.items():
        if re.search(rf"(?<= ){re.escape(notice)}(?= )", joined) or edits(notice) and regex.search(rf"(?<= )(?:{regex.escape(notice)}){{e<={edits(notice)}}}(?= )", joined):
            labels.add(label)
    return len(words), places, labels | {x for _, x in places}
