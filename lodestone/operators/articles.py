"""Articles from wiki markup: plain paragraphs with their places in the source, and corpora of requested titles."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .datasets import redirect_ends

#: Tags whose contents aren't text.
HIDDEN = ("style", "script", "title", "math", "gallery", "timeline", "templatedata", "score")
#: Marks at which a scan stops; each alternative is bounded by its own end, so a scan is linear.
MARK = re.compile(
    r"<!--|</?[a-zA-Z!][^<>]*>|\{\{|\}\}|\[\[|\]\]|\[https?://[^\s\]]*[ \t]*|\]|\||'{2,5}|&#?\w{1,31};"
    r"|^[*#:;]+[ \t]*|^(?:\{\||\|\}|\|-)[^\n]*|^-{4,}|^={1,6}(?=[^\n]*=[ \t]*$)|={1,6}[ \t]*$",
    re.M,
)
NAME = re.compile(r"</?([a-zA-Z]+)")
CLOSES = {"}}": "{{", "]]": "[[", "]": "["}


def stripped(markup: str, hidden: tuple[str, ...] = HIDDEN) -> tuple[str, list[int], list[int]]:
    """Text without markup; places in it, and the source's places that they come from (between them both go in step).

    Templates go, nested ones too; a link leaves what stands behind its first bar, or its target; a link to an address
    leaves its label.  Comments, tags, quote and heading marks, list marks and table lines go; entities are decoded.  The contents
    of hidden tags go.  A closing mark meets the nearest open one of its kind, and marks open between the two are text, as
    is a mark that is never closed; an unclosed comment goes to the end.
    """
    cuts: list[tuple[int, int, str]] = []
    open_: list[list] = []  # kind, start, end, place behind the first bar
    waiting = dict.fromkeys(CLOSES.values(), 0)
    missing, at, heading = set(), 0, False
    while m := MARK.search(markup, at):
        a, at = m.span()
        mark = m[0]
        if mark == "<!--":
            end = markup.find("-->", at)
            at = end + 3 if end >= 0 else len(markup)
            cuts.append((a, at, ""))
        elif mark[0] == "<":
            name = NAME.match(mark)
            name = name[1].lower() if name else ""
            if name in hidden and mark[1] != "/" and mark[-2] != "/" and name not in missing:
                close = re.compile(rf"</{name}\s*>", re.I).search(markup, at)
                if close:
                    at = close.end()
                else:
                    missing.add(name)
            cuts.append((a, at, ""))
        elif mark in ("{{", "[[") or mark.startswith("[http"):
            kind = mark if mark in waiting else "["
            open_.append([kind, a, at, None])
            waiting[kind] += 1
        elif mark in CLOSES:
            kind = CLOSES[mark]
            if not waiting[kind]:
                if mark == "]]" and waiting["["]:
                    at -= 1  # one of two closes a link to an address
                    kind = "["
                else:
                    continue
            while True:
                own = open_.pop()
                waiting[own[0]] -= 1
                if own[0] == kind:
                    break
            if kind == "{{":
                cuts.append((own[1], at, ""))
            else:
                cuts += [(own[1], own[3] or own[2], ""), (at - len(mark if kind == "[[" else "]"), at, "")]
        elif mark == "|":
            if open_ and open_[-1][0] == "[[" and open_[-1][3] is None:
                open_[-1][3] = at
        elif mark[0] == "&":
            cuts.append((a, at, unescape(mark)))
        elif mark[0] == "=":
            starts = a == 0 or markup[a - 1] == "\n"
            if starts or heading:
                cuts.append((a, at, ""))
            heading = starts
        else:
            cuts.append((a, at, ""))
    cuts.sort(key=lambda c: (c[0], -c[1]))
    out, places, sources, size, at = [], [], [], 0, 0

    def keep(text: str, source: int) -> None:
        nonlocal size
        if text:
            out.append(text)
            places.append(size)
            sources.append(source)
            size += len(text)

    for a, b, text in cuts:
        if a >= at:
            keep(markup[at:a], at)
            keep(text, a)
        at = max(at, b)
    keep(markup[at:], at)
    return "".join(out), places, sources


def article_paragraphs(markup: str, hidden: tuple[str, ...] = HIDDEN) -> list[tuple[int, int, str]]:
    """(start, end, paragraph): pieces between blank lines, white space collapsed, none that repeats the one before.

    Start and end bound the characters of the source, its line ends taken as one character, that the paragraph's own come from.
    """
    text, places, sources = stripped(markup.replace("\r\n", "\n").replace("\r", "\n") if "\r" in markup else markup, hidden)
    out: list[tuple[int, int, str]] = []

    def source(i: int) -> int:
        n = bisect_right(places, i) - 1
        return sources[n] + i - places[n]

    begin, at = None, 0
    for line in [*text.split("\n"), ""]:
        if line.strip():
            begin, end = (at if begin is None else begin), at + len(line)
        elif begin is not None:
            own = text[begin:end]
            if (words := " ".join(own.split())) and (not out or out[-1][2] != words):
                first, last = begin + len(own) - len(own.lstrip()), begin + len(own.rstrip()) - 1
                out.append((source(first), source(last) + 1, words))
            begin = None
        at += len(line) + 1
    return out


PARAGRAPHS = "array<struct<start:int,end:int,text:string>>"


def articles(pages: DataFrame, id_: str = "id", markup: str = "markup", hidden: tuple[str, ...] = HIDDEN) -> DataFrame:
    """``pages`` with ``paragraphs`` in place of the markup, and text_sha256 of them, joined by blank lines.

    A null or empty page has none.  One pass in Arrow batches without a shuffle; other columns stay.
    """
    rest = [c for c in pages.columns if c != markup]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "end": b, "text": t} for a, b, t in article_paragraphs(x.as_py() or "", hidden)] for x in batch.column(markup)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, kind)], names=[*rest, "paragraphs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*rest).schema)
    body = F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n\n")
    return pages.select(*rest, markup).mapInArrow(run, f"{schema}, paragraphs {PARAGRAPHS}").withColumn("text_sha256", F.sha2(body, 256))


def resolved(requests: DataFrame, redirects: DataFrame, named: DataFrame) -> DataFrame:
    """Requests (corpus, title) with the article that a title leads to, or null; of several of a name the smallest id.

    redirects: src, dst, normalisations among them; named: name, article.  A title is followed to its last name;
    if no article has that one, the title's own name is tried.
    """
    ends = redirect_ends(redirects.filter("src <> dst").groupBy("src").agg(F.min("dst").alias("dst"))).select(F.col("src").alias("title"), "target")
    first = named.groupBy("name").agg(F.min("article").alias("article"))
    j = requests.distinct().join(ends, "title", "left").withColumn("target", F.coalesce("target", "title"))
    j = j.join(first.select(F.col("name").alias("target"), F.col("article").alias("by_target")), "target", "left")
    j = j.join(first.select(F.col("name").alias("title"), F.col("article").alias("by_title")), "title", "left")
    return j.select("corpus", "title", F.coalesce("by_target", "by_title").alias("article"))


def paragraph_index(requests: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): paragraphs of each corpus with ids, and requested titles without an article or without paragraphs.

    requests: corpus, title, article; found: article, revision, paragraphs.  An article that several titles of a corpus lead to
    counts once, for the first title.  Repeats are found among narrow rows; texts meet them in one join.
    """
    sizes = found.select("article", F.size("paragraphs").alias("n"))
    missing = requests.join(sizes.filter("n > 0"), "article", "left_anti").select("corpus", "title", F.lit("page_missing_or_no_paragraphs").alias("reason"))
    wanted = requests.filter("article IS NOT NULL").groupBy("corpus", "article").agg(F.min("title").alias("title"))
    rows = wanted.join(found, "article").select("corpus", "title", "article", "revision", F.posexplode("paragraphs").alias("paragraph_index", "p"))
    key = F.concat_ws("\0", "corpus", F.col("article").cast("string"), F.col("revision").cast("string"), F.col("paragraph_index").cast("string"), "p.text")
    return rows.select("corpus", "title", "article", "revision", "paragraph_index", F.substring(F.sha2(key, 256), 1, 24).alias("id"), "p.start", "p.end", "p.text"), missing
