"""Operator 13: grouping of spelling variants by full neighbourhood generation.

Runs of letters are counted; the words kept are the vocabulary, and its code points the alphabet.  For every word all
distinct deletions, replacements and insertions over that alphabet are generated, and the generated strings are
hash-joined with the vocabulary: whatever joins is one edit away, so no distance is computed.

A word of 9 letters has some 900 neighbours, nearly all of them no words, so they are not shuffled: each is looked up,
where it is generated, in a Bloom filter of the vocabulary that holds at most 2^28 bits (32 MB) at any size; what passes
is made a string and joined, so a fuller filter costs shuffled rows and never a result.  Neighbours are hashed without
being built: a word's hash is a sum over its places, so an edit changes it by a difference of prefix sums.

Being near is symmetric, so the generated rows are grouped by the string that they reach, which is the join's key too:
one shuffle.  A string is reached from at most as many words as it has neighbours.  Forms have ten times the occurrences
of their word, so chains of them are short, and doubling the steps finds roots in some four joins.

Defined cases: a null text has no runs; a null id reads as an empty one in the draw; an empty table, or one of rare or
short words only, gives no rows; words of any length are handled in steps of bounded memory; rows that repeat an id and
a text are counted each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, small, written

#: Least code points and occurrences of a word; times by which a form is more frequent; one of so many runs is misspelt by hash.
LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
RUN = f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter for each word, and at most (as powers of two); neighbours that a task hashes at once.
FILTER_BITS, MOST_BITS, AT_ONCE = 5, 28, 1 << 21


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n): runs of at least LEAST_LENGTH letters with A-Z lowered, some of them misspelt, that occur LEAST_COUNT times."""
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run).withColumn("run", F.translate("run", UPPER, LOWER))
    drawn = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (drawn % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(drawn % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits for each number (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _term(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to a word's hash."""
    return _mixed((place.astype(np.uint64) << np.uint64(21)) | letter.astype(np.uint64))


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups.items()


def probes(length: int) -> int:
    """Bits of the filter that a word of the length sets: more for longer ones, of which a false one costs more."""
    return 2 + (length // 16).bit_length()


def _bits(hashed: np.ndarray, probe: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(hashed + np.uint64(probe)) & np.uint64((1 << bits) - 1)


def vocabulary_filter(words: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of column ``word`` in 64-bit cells; tasks send their set cells, of which there are at most 2^22."""
    bits = min(MOST_BITS, max(10, count.bit_length() + FILTER_BITS))

    def local(batches):
        for batch in batches:
            found = []
            own = batch.column("word").to_pylist()
            for length, at in _by_length(own):
                with np.errstate(over="ignore"):
                    hashed = _term(np.arange(length)[None, :], _codes([own[i] for i in at])).sum(axis=1, dtype=np.uint64)
                found += [_bits(hashed, p, bits) for p in range(probes(length))]
            if found:
                at = np.unique(np.concatenate(found))
                cells, start = np.unique(at >> np.uint64(6), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start).view(np.int64))], names=["cell", "set"])

    table = np.zeros(1 << (bits - 6), np.uint64)
    cells = arrow_map(words.select("word"), local, "cell long, set long").groupBy("cell").agg(F.bit_or("set").alias("set")).toArrow()
    table[cells.column("cell").to_numpy()] = cells.column("set").to_numpy().view(np.uint64)
    return table, bits


def neighbours(word: str, letters: str) -> set[str]:
    """All distinct strings one edit from the word, plainly; the tests' measure."""
    cuts = {word[:i] + word[i + 1 :] for i in range(len(word))}
    puts = {word[:i] + a + word[i:] for i in range(len(word) + 1) for a in letters}
    return (cuts | puts | {word[:i] + a + word[i + 1 :] for i in range(len(word)) for a in letters}) - {word}


def _reached(words: list[str], letters: str, table: np.ndarray, bits: int):
    """(index of the word, neighbour) for all distinct neighbours that pass the filter."""
    alphabet = _codes(list(letters))[:, 0] if letters else np.zeros(0, np.uint32)

    def passing(hashed: np.ndarray, length: int) -> np.ndarray:
        flat, left = hashed.ravel(), np.arange(hashed.size)
        for p in range(probes(length)):
            at = _bits(flat[left], p, bits)
            left = left[(table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        return left

    for length, own in _by_length(words):
        step = max(1, AT_ONCE // max(1, (length + 1) * len(alphabet)))  # words at once; a very long one alone, by places
        places = max(1, AT_ONCE // max(1, len(alphabet)))
        for start in range(0, len(own), step):
            ids = own[start : start + step]
            codes = _codes([words[i] for i in ids])
            zero = np.zeros((len(ids), 1), np.uint64)
            with np.errstate(over="ignore"):
                terms = _term(np.arange(length)[None, :], codes)
                before = np.concatenate([zero, np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
                total = before[:, -1:]
                earlier = _term(np.maximum(np.arange(length) - 1, 0)[None, :], codes)  # the letters after a cut stand one place earlier
                earlier = np.concatenate([np.cumsum(earlier[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], zero], axis=1)
                later = np.concatenate([np.cumsum(_term(np.arange(1, length + 1)[None, :], codes)[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], zero], axis=1)
                hits = passing(before[:, :-1] + earlier[:, 1:], length - 1)
            for w, i in zip(*np.divmod(hits, length), strict=True):
                if i == 0 or codes[w, i] != codes[w, i - 1]:  # equal neighbours leave the same string
                    yield ids[w], words[ids[w]][:i] + words[ids[w]][i + 1 :]
            for low in range(0, length + 1, places):
                at = np.arange(low, min(length + 1, low + places))
                added = _term(at[:, None], alphabet[None, :])
                with np.errstate(over="ignore"):
                    hits = passing((before[:, at] + later[:, at])[:, :, None] + added[None], length + 1)
                    swaps = at[at < length]
                    swapped = passing((total - terms[:, swaps])[:, :, None] + added[None, : len(swaps)], length)
                for hit, count, found in ((0, len(at), hits), (1, len(swaps), swapped)):
                    for w, rest in zip(*np.divmod(found, max(1, count * len(alphabet))), strict=True):
                        i, a = divmod(int(rest), len(alphabet))
                        i += low
                        word, letter = words[ids[w]], letters[a]
                        if hit:
                            if word[i] != letter:
                                yield ids[w], word[:i] + letter + word[i + 1 :]
                        elif i == 0 or word[i - 1] != letter:  # beside an equal letter it makes the same string
                            yield ids[w], word[:i] + letter + word[i:]


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): for words (word, n) their near words' number, and the most frequent, the first by code point of equals.

    Words without near ones are left out."""
    count = words.count()
    letters = "".join(sorted(r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()))  # the letters of the runs' pattern
    table, bits = vocabulary_filter(words, count)
    shared = words.sparkSession.sparkContext.broadcast(table)

    def generate(batches):
        for batch in batches:
            own, n = batch.column("word").to_pylist(), batch.column("n")
            ids, reached = [], []
            for i, other in _reached(own, letters, shared.value, bits):
                ids.append(i)
                reached.append(other)
                if len(ids) == 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(reached), batch.column("word").take(pa.array(ids)), n.take(pa.array(ids))], names=["word", "other", "other_n"])
                    ids, reached = [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(reached), batch.column("word").take(pa.array(ids)), n.take(pa.array(ids))], names=["word", "other", "other_n"])

    generated = arrow_map(words.select("word", "n"), generate, "word string, other string, other_n long")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    per = generated.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    return per.join(words.select("word"), "word", "left_semi").select("word", "n_near", F.col("best.w").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): follow forms to the last, the steps doubling; forms never lead back."""
    at = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        step = checkpointed(at.join(small(further), "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        at = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            return at


def grouped(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts."""
    words = written(occurrences(docs))
    found = words.join(near(words), "word", "left")
    takes = F.col("form_n") >= F.col("n") * times
    found = written(found.select("word", F.when(takes, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form_n")).alias("form_n")))
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(small(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
