"""Page search with excerpts: rank pages, take each one's best paragraph, cut it to a budget of tokens, say where it came from."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import written
from .retrieval import bm25_rows, bm25_search, few, parts

#: Tokens of the first paragraph alone, of the best one, and of the first one before it.
LEAD, BODY, INTRO = 384, 288, 96
#: Normalised paragraphs that head a section.
HEADINGS = ("bibliography", "references", "external links", "see also", "notes", "further reading")
#: Narrow rows (a paragraph taken) up to which they are broadcast to the paragraphs.
PLACES = 400_000

Offsets = Callable[[], Callable[[list[str]], list[list[tuple[int, int]]]]]


def words() -> Callable[[list[str]], list[list[tuple[int, int]]]]:
    """A tokenizer by runs without blanks; ``context.byte_pairs`` gives one by a vocabulary."""
    word = re.compile(r"[^ \t\n]+")
    return lambda texts: [[m.span() for m in word.finditer(x)] for x in texts]


def best_window(own: list[list[str]], asked: set[str], limit: int) -> int:
    """The first window of ``limit`` tokens with most distinct asked terms, then most of them; one pass, however long the text."""
    hits = [[t for t in x if t in asked] for x in own]
    inside = Counter(t for x in hits[:limit] for t in x)
    total = inside.total()
    best, at = (len(inside), total), 0
    for start in range(1, len(hits) - limit + 1):
        for t in hits[start - 1]:
            inside[t] -= 1
            if not inside[t]:
                del inside[t]
        inside.update(hits[start + limit - 1])
        total += len(hits[start + limit - 1]) - len(hits[start - 1])
        if (len(inside), total) > best:
            best, at = (len(inside), total), start
    return at


def excerpts(rows: DataFrame, tokenizer: Offsets = words) -> DataFrame:
    """``rows`` with (start, end) of the excerpt of ``text`` within ``limit`` tokens; ``asked`` holds the distinct terms.

    A text without tokens gives 0, 0; one within the limit is taken from its first to its last token."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets_of, token, stop = tokenizer(), re.compile(T.TOKEN), frozenset(T.STOPWORDS)
        terms = lambda x: [t for t in token.findall(x.lower().replace("ß", "ss")) if t not in stop and (len(t) > 1 or ord(t) > 127)]
        for batch in parts(batches):
            found = []
            for text, asked, limit in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), batch.column("limit").to_pylist(), strict=True):
                text = text or ""
                spans = [(a, b) for a, b in offsets_of([text])[0] if b > a]  # one text's at a time
                if not spans:
                    found.append((0, 0))
                    continue
                at = 0 if len(spans) <= limit else best_window([terms(text[a:b]) for a, b in spans], set(asked or ()), limit)
                found.append((spans[at][0], spans[min(at + limit, len(spans)) - 1][1]))
            places = np.array(found, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places[:, 0]), pa.array(places[:, 1])], names=[*batch.schema.names, "start", "end"])

    return rows.mapInArrow(run, f"{kinds}, start int, end int")


def page_excerpts(corpus: DataFrame, paragraphs: DataFrame, questions: DataFrame, tokenizer: Offsets = words, k: int = 3, lead: int = LEAD, body: int = BODY, intro: int = INTRO) -> DataFrame:
    """(qid, rank, id, page_score, paragraph_index, text, segments) of the k best pages.

    corpus: id, title, text; paragraphs: id, paragraph_index, text; questions: qid, question.  Paragraphs that head a section or
    hold no token are left out.  A page's best paragraph is that of the highest own score above 0, ties to the smaller
    index.  Without one the first paragraph is cut to ``lead`` tokens; if the best one is the first, to ``body``; else
    ``intro`` tokens of the first stand before ``body`` of the best.  segments: array of (paragraph_index, start, end), characters
    of each paragraph; their texts joined by a line end make up ``text``.  Pages whose text is blank are dropped, their ranks stay free.

    Own scores are made for the pages found alone.  Only the paragraphs taken are shuffled, each with its question.
    """
    questions = written(questions)  # read again by each search, one partition after another
    pages = written(bm25_search(corpus, questions, k).withColumnRenamed("score", "page_score"))
    eligible = paragraphs.select("id", "paragraph_index", F.lit(None).cast("string").alias("title"), "text")
    scored = bm25_rows(eligible, questions, ("id", "paragraph_index"), 0, pages, title_weight=0, without=HEADINGS)
    first = F.min(F.when(F.col("score") > 0, F.struct((-F.round("score", 9)).alias("s"), "paragraph_index")))
    own = scored.groupBy("qid", "id").agg(F.min("paragraph_index").alias("lead"), first.alias("b"))
    j = pages.join(own.select("qid", "id", "lead", F.col("b.paragraph_index").alias("best")), ["qid", "id"])
    part = lambda n, at, limit: F.struct(F.lit(n).alias("n"), at.alias("paragraph_index"), F.lit(limit).alias("limit"))
    parts = F.when(F.col("best").isNull(), F.array(part(0, F.col("lead"), lead))).when(F.col("best") == F.col("lead"), F.array(part(0, F.col("best"), body))).otherwise(F.array(part(0, F.col("lead"), intro), part(1, F.col("best"), body)))
    wanted = written(j.select("qid", "rank", "id", "page_score", F.coalesce("best", "lead").alias("chosen"), F.explode(parts).alias("p")).select("qid", "rank", "id", "page_score", "chosen", "p.*"))
    asked = questions.select("qid", F.array_distinct(T.tokens(F.col("question"))).alias("asked"))
    cut = excerpts(paragraphs.select("id", "paragraph_index", "text").join(few(wanted, PLACES), ["id", "paragraph_index"]).join(asked, "qid"), tokenizer)
    own = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    piece = F.struct("n", F.struct("paragraph_index", "start", "end").alias("segment"), own.alias("own"))
    found = cut.groupBy("qid", "rank", "id", "page_score", "chosen").agg(F.array_sort(F.collect_list(piece)).alias("s"))
    text = F.array_join(F.filter(F.transform("s", lambda s: s["own"]), lambda x: x != ""), "\n")
    return found.select("qid", "rank", "id", "page_score", F.col("chosen").alias("paragraph_index"), text.alias("text"), F.transform("s", lambda s: s["segment"]).alias("segments")).filter(F.trim("text") != "")
