"""Operator 8: token counts that follow edits.

A document keeps its pre-tokens (the pieces that the tokenizer's pattern cuts before any merge) in the leaves of a
segment tree whose nodes hold sums of characters and tokens.  An edit finds its leaf by the sums, re-cuts the text from
a few pre-tokens before it until its cuts meet the old ones again, encodes the new pre-tokens only, and updates the sums
on the way up.  The count of the whole is the root's sum.

The pattern looks at most ``LOOK`` characters beyond a match, and nowhere back: pre-tokens that end so far before an
edit are as they were, and once a new cut falls on an old one behind the edit, all further cuts agree.

Defined cases: null and empty texts have no tokens; an edit is (position, deleted characters, inserted text), applied in
order, each to the text that the ones before left; positions and lengths beyond the text are held to it, and null
parts are 0 or empty; texts are read whole; rows that repeat a doc_id are counted each by itself; no other column is
read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Folder with the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary's texts are cut by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOK = 3
#: Pre-tokens of a full leaf.
LEAF = 128


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    """The rank file, read on the driver and sent along: executors need no local copy."""
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


class Counter:
    """Tokens of a pre-token, remembered up to a bound."""

    def __init__(self, ranks: bytes, most: int = 400_000):
        merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.known: dict[str, int] = {}
        self.most, self.find = most, regex.compile(PATTERN)

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > self.most:
                self.known.clear()
            n = len(self.encoding.encode_ordinary(piece))
            self.known[piece] = n
        return n

    def cut(self, text: str) -> list[str]:
        return self.find.findall(text)


@dataclass
class Leaf:
    pieces: list[str]
    counts: list[int]

    @property
    def sums(self) -> tuple[int, int]:
        return sum(map(len, self.pieces)), sum(self.counts)


class SegmentTree:
    """Leaves of pre-tokens under a complete binary tree of (characters, tokens)."""

    def __init__(self, text: str, count: Callable[[str], int]):
        self.count = count
        self.encoded = 0  # characters that were encoded, by edits too
        self._build(self._leaves(count.cut(text)))

    def _leaves(self, pieces: list[str]) -> list[Leaf]:
        self.encoded += sum(map(len, pieces))
        return [Leaf(p, [self.count(x) for x in p]) for i in range(0, len(pieces), LEAF) if (p := pieces[i : i + LEAF])] or [Leaf([], [])]

    def _build(self, leaves: list[Leaf]) -> None:
        self.leaves, self.width = leaves, 1
        while self.width < len(leaves):
            self.width *= 2
        self.sums = [(0, 0)] * (2 * self.width)
        for i, leaf in enumerate(leaves):
            self.sums[self.width + i] = leaf.sums
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = a + c, b + d

    def _update(self, leaf: int) -> None:
        i = self.width + leaf
        self.sums[i] = self.leaves[leaf].sums
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def characters(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def text(self) -> str:
        return "".join(x for leaf in self.leaves for x in leaf.pieces)

    def _locate(self, position: int) -> tuple[int, int]:
        """(leaf, characters before it) of the character at the position, or the last leaf."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if position - before >= self.sums[i][0] and self.sums[i + 1][0]:
                before += self.sums[i][0]
                i += 1
        return i - self.width, before

    def edit(self, position: int, deleted: int, inserted: str) -> None:
        position = max(0, min(position, self.characters))
        deleted = max(0, min(deleted, self.characters - position))
        if not deleted and not inserted:
            return
        # back to a pre-token that no changed character had a say in
        first, at = self._locate(max(0, position - LOOK - 1))
        k = 0
        pieces = self.leaves[first].pieces
        while k < len(pieces) and at + len(pieces[k]) + LOOK <= position:
            at += len(pieces[k])
            k += 1
        # the old pre-tokens from there, as many as needed: through the deleted part and on until the cuts meet
        old: list[str] = []
        leaf, length, end = first, 0, position - at + deleted
        tail: list[int] = []  # old cuts behind the edit, as offsets from ``at``
        fresh, done = None, None
        while done is None:
            while leaf < len(self.leaves) and (length < end + 64 or fresh is not None):
                for x in self.leaves[leaf].pieces[k if leaf == first else 0 :]:
                    old.append(x)
                    length += len(x)
                    if length >= end:
                        tail.append(length)
                leaf += 1
                if fresh is not None:
                    break
            whole = "".join(old)
            new = whole[: position - at] + inserted + whole[end:]
            shift = len(inserted) - deleted
            cuts = {x + shift for x in tail}
            fresh, reached, last = [], 0, leaf >= len(self.leaves)
            for x in self.count.find.findall(new):
                fresh.append(x)
                reached += len(x)
                # a cut is sure only if all that the pattern looked at is here
                if reached in cuts and reached >= position - at + len(inserted) and (last or reached + LOOK <= len(new)):
                    done = reached - shift
                    break
            else:
                if last:
                    done = length
        kept, used = 0, 0
        while kept < done:
            kept += len(old[used])
            used += 1
        rest = old[used:]
        self.encoded += sum(map(len, fresh))
        head = Leaf(self.leaves[first].pieces[:k], self.leaves[first].counts[:k])
        pieces = head.pieces + fresh + rest
        counts = head.counts + [self.count(x) for x in fresh] + [self.count(x) for x in rest]
        self._replace(first, leaf, pieces, counts)

    def _replace(self, first: int, end: int, pieces: list[str], counts: list[int]) -> None:
        """New content for the leaves [first, end); the tree is built anew only if they can't hold it."""
        room = end - first
        if len(pieces) > 2 * LEAF * room:
            size = LEAF
            new = [Leaf(pieces[i : i + size], counts[i : i + size]) for i in range(0, len(pieces), size)]
            self._build(self.leaves[:first] + new + self.leaves[end:])
            return
        size = -(-len(pieces) // room) or 1
        for j in range(room):
            self.leaves[first + j] = Leaf(pieces[j * size : (j + 1) * size], counts[j * size : (j + 1) * size])
            self._update(first + j)


EDITS = "array<struct<position:long,deleted:long,inserted:string>>"


def _count_all(ranks: bytes):
    def run(batches):
        count = Counter(ranks)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column("text"), batch.column("edits").to_pylist(), strict=True):
                tree = SegmentTree(text.as_py() or "", count)
                n, chars, first = tree.tokens, tree.characters, tree.encoded
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["position"] or 0, e["deleted"] or 0, e["inserted"] or "")
                out.append((chars, n, tree.characters, tree.tokens, tree.encoded - first))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in out], pa.int64()) for i in range(5)]], names=["doc_id", "n_chars", "n_tokens", "n_chars_after", "n_tokens_after", "reencoded_chars"])

    return run


def counts(docs: DataFrame, edits: Column | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """Token counts before and after each row's ``edits`` (an array of position, deleted, inserted); one pass, no shuffle."""
    own = (F.array() if edits is None else edits).cast(EDITS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), own.alias("edits"))
    return arrow_map(rows, _count_all(vocabulary(folder)), "doc_id long, n_chars long, n_tokens long, n_chars_after long, n_tokens_after long, reencoded_chars long")


def standard_edits() -> Column:
    """Three edits for a row, placed by its hash: a note put in, a span taken out, a word put in another's place."""
    size = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")
    place = lambda n: F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(n)), size)
    edit = lambda p, d, t: F.struct(p.alias("position"), F.lit(d).cast("long").alias("deleted"), F.lit(t).alias("inserted"))
    return F.array(edit(place(1), 0, " [edited: it's a note] "), edit(place(2), 40, ""), edit(place(3), 7, "changed"))


def query(spark, sf_dir: str) -> DataFrame:
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), standard_edits())
