"""Ranked retrieval: BM25 and its variants, keyword and dense search, fusion, reranking, evaluation.

A search takes its questions in blocks of bounded size.  One pass over the corpus counts the terms of several blocks, one
narrow row for each document; document frequencies and the mean length are partial aggregates of those rows.  A pass
over them for each block scores a document for all its questions at once and keeps the best of each question in its task,
so no posting and no pair of question and document is shuffled.  Scores are rounded after ranking.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..scratch import written

K1, B, TITLE_WEIGHT = 1.5, 0.75, 3
EXACT_TITLE, WITHIN_TITLE = 10.0, 4.0
RRF_K, CANDIDATES = 60, 20
#: Query rows up to which the query side is broadcast; questions of a block; rows of an Arrow batch; rows that are Python objects at a time; (query, vector) pairs scored at a time.
QUERY_ROWS, BLOCK, BATCH, ROWS, CELLS = 50_000, 4096, 512, 128, 1 << 20
#: Blocks whose terms one pass over the corpus counts; distinct terms with which no further block joins them.
BLOCKS, TERMS = 8, 100_000
#: Scores as close as this to the last one kept are kept too, since ranks go by rounded scores.
NEAR = 1e-8


def few(df: DataFrame, rows: int = QUERY_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it is counted to be small; the count runs what isn't stored, so that should be cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top(df: DataFrame, k: int, *order: Column, by: str = "qid") -> DataFrame:
    """The first k rows of each query in a total order, ranked from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def _kind(df: DataFrame, column: str) -> tuple[pa.DataType, str]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[column].dataType
    return to_arrow_type(kind), kind.simpleString()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile gives Python at most ``BATCH`` rows at once, as a worker holds two batches of whole texts; the session's own number is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key, None)
    if own is None or not 0 < int(own) <= BATCH:
        spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def in_blocks(questions: DataFrame, value: Column, search: Callable[[list], DataFrame], size: int | None = None) -> DataFrame | None:
    """The union of a search over blocks of (qid, value); each block's result is written before the next comes, if there are several."""
    found, block = None, []
    for row in questions.select("qid", value.alias("v")).toLocalIterator():
        if len(block) == (size or BLOCK):
            own = written(search(block))
            found, block = own if found is None else found.unionByName(own), []
        block.append((row["qid"], row["v"]))
    if not block:
        return None
    return search(block) if found is None else found.unionByName(written(search(block)))


def term_blocks(questions: DataFrame, forms: bool = False) -> Iterator[tuple[dict[str, int], list[list[tuple]]]]:
    """(terms, blocks of (qid, numbers of its terms, normal form if asked for)): as many blocks at a time as one pass counts the terms of.

    Questions are kept as numbers, since their tokens as Python objects would take many times as much of the driver."""
    terms, blocks = {}, [[]]
    for row in questions.select("qid", T.tokens(F.col("question")).alias("v")).toLocalIterator():
        if len(blocks[-1]) == BLOCK:
            if len(blocks) >= BLOCKS or len(terms) >= TERMS:
                yield terms, blocks
                terms, blocks = {}, []
            blocks.append([])
        own = dict.fromkeys(terms.setdefault(t, len(terms)) for t in row["v"])
        blocks[-1].append((row["qid"], np.fromiter(own, np.int32, len(own)), " ".join(row["v"]) if forms else None))
    if blocks[-1]:
        yield terms, blocks


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, since a row as Python objects takes many times its bytes."""
    for batch in batches:
        yield batch if batch.num_rows == 0 else batch.slice(0, rows)
        for at in range(rows, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(work: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of at most ``rows`` rows whose work is at most ``most`` in all, or of one row."""
    done, at = np.concatenate(([0], np.cumsum(work))), 0
    while at < len(work):
        end = min(at + rows, max(at + 1, int(np.searchsorted(done, done[at] + most, "right")) - 1))
        yield at, end
        at = end


class Best:
    """A task's best rows of each question: those whose group is among its k best so far; all of them without k.

    Of groups with exactly the same score the first k by ``order`` of their rows stay, and of a group's rows the first, so copies
    of a text don't add up; scores that only differ by rounding are kept beside one another."""

    def __init__(self, questions: int, k: int | None, order: Callable = lambda row: row):
        self.k, self.rows = k, [{} for _ in range(questions)]  # group -> [(score, row)]
        self.floor = np.full(questions, -np.inf)
        self.most = [4 * k if k else 0] * questions
        self.first = lambda row: [(x is not None, x) for x in order(row)]

    def offer(self, q: int, score: float, group, row) -> None:
        own = self.rows[q].get(group)
        if own is None or self.k is None:
            self.rows[q].setdefault(group, []).append((score, row))
        elif score > own[0][0] + NEAR:
            self.rows[q][group] = [(score, row)]
        elif score >= own[0][0] - NEAR:
            same = next((n for n, x in enumerate(own) if x[0] == score), None)
            if same is None:
                own.append((score, row))
                own.sort(key=lambda x: -x[0])
            elif self.first(row) < self.first(own[same][1]):
                own[same] = (score, row)
        if self.k is not None and len(self.rows[q]) >= self.most[q]:
            self._cut(q)

    def _cut(self, q: int) -> None:
        ranked = sorted(self.rows[q].items(), key=lambda x: -x[1][0][0])
        if len({x[1][0][0] for x in ranked}) < len(ranked):
            ranked.sort(key=lambda x: (-x[1][0][0], self.first(x[1][0][1])))
        self.floor[q] = least = ranked[self.k - 1][1][0][0] - NEAR
        kept, last, same = {}, None, 0
        for group, own in ranked:
            same = same + 1 if own[0][0] == last else 1
            last = own[0][0]
            if last < least:
                break
            if same <= self.k or len(own) > 1:
                kept[group] = own
        self.rows[q], self.most[q] = kept, max(4 * self.k, 2 * len(kept))

    def __iter__(self):
        for q in range(len(self.rows)):
            if self.k and len(self.rows[q]) > self.k:
                self._cut(q)
            for rows in self.rows[q].values():
                for score, row in rows:
                    yield q, score, row


class Within:
    """The questions of a block whose normal form holds a title's, and the boosts; what was found for a title is kept for the next one like it.

    All normal forms make up one text.  A title's first characters say by a hash at which few of its places to look; one
    shorter than the shortest piece is searched for."""

    PIECES, TITLES = (24, 8), 4096

    def __init__(self, forms: list[str]):
        self.text, self.kept = "\n".join(forms), {}  # no token holds a line end
        self.size = np.array([len(x) for x in forms], np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.places = {}
        for n in self.PIECES:
            pieces = self._hash(codes, n)
            order = np.argsort(pieces, kind="stable").astype(np.int32)
            self.places[n] = pieces[order], order

    @staticmethod
    def _hash(codes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(out)]
        return out

    def likely(self, titles: list[str]) -> list[bool]:
        """Which of the titles may stand in a question: all but those whose first piece stands in none, looked up together."""
        found = np.array([bool(t) for t in titles], bool)
        size, most = np.array([len(t) for t in titles], np.int64), np.inf
        for n, (pieces, _) in self.places.items():
            own = np.flatnonzero((size >= n) & (size < most))
            codes = np.frombuffer("".join(titles[i][:n] for i in own).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, n)
            out = np.zeros(len(own), np.uint64)
            for i in range(n):
                out = out * np.uint64(0x9E3779B97F4A7C15) + codes[:, i]
            found[own] = np.searchsorted(pieces, out, "left") < np.searchsorted(pieces, out, "right")
            most = n
        return found.tolist()

    def _at(self, title: str) -> list[int]:
        for n, (pieces, order) in self.places.items():
            if len(title) >= n:
                own = self._hash(np.array([ord(c) for c in title[:n]], np.uint64), n)[0]
                return [a for a in order[np.searchsorted(pieces, own, "left") : np.searchsorted(pieces, own, "right")].tolist() if self.text.startswith(title, a)]
        found, at = [], self.text.find(title)
        while at >= 0:
            found.append(at)
            at = self.text.find(title, at + 1)
        return found

    def __call__(self, title: str) -> tuple[np.ndarray, np.ndarray]:
        if title not in self.kept:
            if len(self.kept) == self.TITLES:
                self.kept.clear()
            q = np.unique(np.searchsorted(self.start, self._at(title), "right") - 1) if title else np.zeros(0, np.int64)
            self.kept[title] = q, np.where(self.size[q] == len(title), EXACT_TITLE, WITHIN_TITLE)
        return self.kept[title]


def counted(corpus: DataFrame, terms: dict[str, int], keys: tuple[str, ...], title_weight: int = TITLE_WEIGHT, without: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, dl, terms, tfs, form), written, one row for each document: its length, the numbers and frequencies of the terms that it has, and its title's normal form; a title counts ``title_weight`` times.

    With ``without`` texts that hold no token, or whose normal form is one of these, are no documents."""
    longest = max((x.count(" ") + 1 for x in without or ()), default=0)
    folded = corpus.select(*keys, T.fold(F.coalesce("title", F.lit(""))).alias("_title"), T.fold(F.coalesce("text", F.lit(""))).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, stop = re.compile(T.TOKEN), frozenset(T.STOPWORDS) | set("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in parts(batches):
            dl, own, tfs, forms, kept = [], [], [], [], []
            for r, (title, text) in enumerate(zip(batch.column("_title").to_pylist(), batch.column("_text").to_pylist(), strict=True)):
                found = token.findall(text)
                head, body = [t for t in token.findall(title) if t not in stop], Counter(found)
                size = len(found) - sum(body[t] for t in body.keys() & stop)
                if without is not None and (size == 0 or size <= longest and " ".join(t for t in found if t not in stop) in without):
                    continue
                kept.append(r)
                dl.append(title_weight * len(head) + size)
                count = {n: c for t, c in body.items() if (n := terms.get(t)) is not None}  # no stopword is a term
                for n in map(terms.get, head if title_weight else ()):
                    if n is not None:
                        count[n] = count.get(n, 0) + title_weight
                own.append(sorted(count))  # so that copies of a text, in any order of words, get exactly the same sum
                tfs.append([count[n] for n in own[-1]])
                forms.append(" ".join(head))
            given = batch if len(kept) == batch.num_rows else batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[given.column(c) for c in keys], pa.array(dl, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32())), pa.array(forms, pa.string())], names=[*keys, "dl", "terms", "tfs", "form"])

    kinds = dict(folded.dtypes)
    return written(folded.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keys], "dl long, terms array<int>, tfs array<int>, form string"])))


def bm25_rows(corpus: DataFrame, questions: DataFrame, keys: tuple[str, ...] = ("id",), k: int | None = None, also: DataFrame | None = None, group: str | None = None, title_weight: int = TITLE_WEIGHT, boost: bool = False, order: tuple[str, ...] | None = None, without: tuple[str, ...] | None = None) -> DataFrame:
    """(qid, keys, score), a superset of each question's k best documents (or of the best of its k best ``group``s; without k all with a score), and all of ``also`` (qid, id), whatever their score.

    With k = 0 only ``also`` is scored: of the rows no others than its documents' are given to Python, for all blocks of a pass at once.
    Ties go by ``order``, some of the keys (all of them, if None).  ``boost`` adds that of a title that is the question, or part of it, where the document is scored, so no pair of title and question is made beside the k best."""
    search, found = scoring(corpus, questions, keys, k, also, group, boost, order), None
    with small_batches(corpus.sparkSession):
        for terms, blocks in term_blocks(questions, boost):
            rows = counted(corpus, terms, keys, title_weight, without)
            idf, mean = statistics(rows, len(terms))
            for block in [list(chain.from_iterable(blocks))] if k == 0 else blocks:
                own = written(search(block, rows, idf, mean))
                found = own if found is None else found.unionByName(own)
    kinds = [f"{c} {_kind(questions if c == 'qid' else corpus, c)[1]}" for c in ("qid", *keys)]
    return corpus.sparkSession.createDataFrame([], ", ".join([*kinds, "score double"])) if found is None else found


def statistics(rows: DataFrame, terms: int) -> tuple[np.ndarray, float]:
    """The weights of so many terms and the mean length, of counted rows."""
    n, mean = rows.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    df = np.zeros(terms or 1)
    for t, c in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).toLocalIterator():  # no more than the terms
        df[t] = c
    return np.log(1.0 + (n - df + 0.5) / (df + 0.5)), max(mean, 1.0)


def scoring(corpus: DataFrame, questions: DataFrame, keys: tuple[str, ...] = ("id",), k: int | None = None, also: DataFrame | None = None, group: str | None = None, boost: bool = False, order: tuple[str, ...] | None = None) -> Callable[..., DataFrame]:
    """The search of ``bm25_rows`` for one block of (qid, numbers of its terms, normal form) over counted rows."""
    q_kind, fields = _kind(questions, "qid"), [(c, *_kind(corpus, c)) for c in keys]
    schema = ", ".join([f"qid {q_kind[1]}", *[f"{c} {name}" for c, _, name in fields], "score double"])
    at = [keys.index(c) for c in order or keys]

    def search(block: list, rows: DataFrame, idf: np.ndarray, mean: float) -> DataFrame:
        names, forms = [qid for qid, _, _ in block], [form for _, _, form in block] if boost else None
        asked, asking = np.concatenate([own for _, own, _ in block]), np.repeat(np.arange(len(block)), [len(own) for _, own, _ in block])
        asking = asking[np.argsort(asked, kind="stable")]  # the questions of a term, term by term
        asks = np.bincount(asked, minlength=len(idf))
        first = np.cumsum(asks) - asks
        wanted: dict = {}
        if also is not None:
            number = {qid: q for q, qid in enumerate(names)}
            named = F.broadcast(corpus.sparkSession.createDataFrame([(qid,) for qid in number], f"qid {q_kind[1]}"))
            near = also.select("qid", "id").join(named, "qid", "left_semi")
            for qid, i in near.collect():
                wanted.setdefault(i, []).append(number[qid])
            if k == 0:
                rows = rows.join(F.broadcast(near.select("id").distinct()), "id", "left_semi")
        only, asked_by = k == 0 and not boost, [own for _, own, _ in block] if k == 0 else None

        def weights(t: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
            return idf[t] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size / mean))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, out, within = Best(len(names), k, lambda row: [row[c] for c in at]), [], Within(forms) if boost else None
            for batch in parts(batches, 8 * ROWS):
                titles = batch.column("form").to_pylist() if boost else None
                boosted = within.likely(titles) if boost else None
                cols = [batch.column(c).to_pylist() for c in keys]
                ids, groups = batch.column("id").to_pylist(), batch.column(group).to_pylist() if group else None
                t, tf = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
                doc = np.repeat(np.arange(len(ids)), pc.list_value_length(batch.column("terms")).to_numpy())
                here = asks[t] > 0
                t, tf, doc = t[here], tf[here], doc[here]
                weight, n = weights(t, tf, batch.column("dl").to_numpy()[doc]), asks[t]
                if only:  # the pairs asked for alone
                    start = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
                    for r, i in enumerate(ids):
                        own, w = t[start[r] : start[r + 1]], weight[start[r] : start[r + 1]]
                        for q in wanted.get(i, ()):
                            both = w[np.isin(own, asked_by[q])]
                            out.append((q, float(np.cumsum(both)[-1]) if len(both) else 0.0, tuple(c[r] for c in cols)))
                    continue
                for a, b in runs(np.bincount(doc, n, len(ids)).astype(np.int64), max(1, CELLS // len(names)), CELLS):
                    lo, hi = np.searchsorted(doc, [a, b])
                    many = n[lo:hi]
                    ends = np.cumsum(many)
                    q = asking[np.arange(many.sum()) + np.repeat(first[t[lo:hi]] - ends + many, many)]
                    score = np.bincount(np.repeat((doc[lo:hi] - a) * len(names), many) + q, np.repeat(weight[lo:hi], many), (b - a) * len(names)).astype(np.float64, copy=False).reshape(b - a, len(names))
                    for r in range(a, b):
                        if boost and boosted[r]:
                            where, more = within(titles[r])
                            score[r - a, where] += more
                        if extra := wanted.get(ids[r]):
                            row = tuple(c[r] for c in cols)
                            out += [(q, float(score[r - a, q]), row) for q in extra]
                    if k == 0:
                        continue
                    good = (score > 0) & (score >= best.floor)
                    full = np.flatnonzero(np.count_nonzero(good, axis=0) > k) if k and not group else ()
                    if len(full):  # no more than the k best of these rows, and what ties with them
                        good[:, full] &= score[:, full] >= np.partition(score[:, full], -k, axis=0)[-k] - NEAR
                    rs, qs = np.nonzero(good)
                    for r, q, x in zip((rs + a).tolist(), qs.tolist(), score[rs, qs].tolist(), strict=True):
                        if x >= best.floor[q]:
                            row = tuple(c[r] for c in cols)
                            best.offer(q, x, groups[r] if group else row, row)
            found = [*best, *out]
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q, _, _ in found], q_kind[0]), *[pa.array([row[c] for _, _, row in found], fields[c][1]) for c in range(len(keys))], pa.array([x for _, x, _ in found], pa.float64())], names=["qid", *keys, "score"])

        return rows.mapInArrow(run, schema).groupBy("qid", *keys).agg(F.max("score").alias("score"))

    return search


class Counted:
    """A corpus whose terms are counted once for any number of searches over a stated vocabulary, and for searches among few of its documents by the whole one's statistics."""

    def __init__(self, corpus: DataFrame, words: DataFrame):
        self.corpus, self.terms = corpus, {}
        for row in words.toLocalIterator():
            self.terms.setdefault(row[0], len(self.terms))
        with small_batches(corpus.sparkSession):
            self.rows = counted(corpus, self.terms, ("id",))
        self.idf, self.mean = statistics(self.rows, len(self.terms))

    def search(self, questions: DataFrame, k: int = 3, rows: DataFrame | None = None) -> DataFrame | None:
        """(qid, rank, id, score) among the given rows, or all; each token of a question that some of them hold must be in the vocabulary."""

        def one(block: list) -> DataFrame:
            known = [np.array([n for n in dict.fromkeys(map(self.terms.get, v)) if n is not None], np.int32) for _, v in block]
            return scoring(self.corpus, questions, k=k)([(qid, own, None) for (qid, _), own in zip(block, known, strict=True)], self.rows if rows is None else rows, self.idf, self.mean)

        with small_batches(self.corpus.sparkSession):
            found = in_blocks(questions, T.tokens(F.col("question")), one)
        if found is None:
            return None
        return top(found.filter("score > 0"), k, F.desc(F.round("score", 9)), F.col("id")).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def bm25_search(corpus: DataFrame, questions: DataFrame, k: int = 3, boost: bool = True) -> DataFrame:
    """(qid, rank, id, score): the k best documents, ties to the smaller id as a string."""
    return top(bm25_rows(corpus, questions, k=k, boost=boost).filter("score > 0"), k, F.desc(F.round("score", 9)), F.col("id")).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def bm25_paragraphs(paragraphs: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """The best paragraph of each title, then the k best titles."""
    keys = ("id", "paragraph_index", "title_key")
    keyed = paragraphs.withColumn("title_key", T.token_norm(F.col("title")))
    scored = bm25_rows(keyed, questions, keys, k, group="title_key", boost=True, order=("title_key", "paragraph_index", "id")).filter("score > 0").withColumn("s", F.round("score", 9))
    order = (F.desc("s"), F.col("title_key"), F.col("paragraph_index"), F.col("id"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid", "title_key").orderBy(*order))).filter("r = 1")
    return top(best, k, *order).select("qid", "rank", "id", "paragraph_index", F.round("score", 6).alias("score"))


def page_then_paragraph(corpus: DataFrame, paragraphs: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """Rank whole pages, then the best paragraph of each by the same terms without a title boost."""
    pages = written(bm25_search(corpus, questions, k).withColumnRenamed("score", "page_score"))
    found = bm25_rows(paragraphs, questions, ("id", "paragraph_index"), 0, pages, title_weight=0).filter("score > 0").join(few(pages), ["qid", "id"])
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("qid", "id").orderBy(F.desc(F.round("score", 9)), "paragraph_index"))).filter("r = 1")
    return best.select("qid", "rank", "id", "page_score", "paragraph_index", F.round("score", 6).alias("body_score"))


def keyword_search(corpus: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """Sum of substring counts of the distinct terms over title and text; documents without any are dropped.

    One automaton of a block's terms over each text; a task keeps the k best documents of each question.
    """
    q_kind, i_kind = _kind(questions, "qid"), _kind(corpus, "id")
    bodies = corpus.select("id", T.fold(F.concat_ws(" ", "title", "text")).alias("body"))
    schema = f"qid {q_kind[1]}, id {i_kind[1]}, score long"

    def search(block: list) -> DataFrame:
        asking: dict[str, list[int]] = {}
        for q, (_, own) in enumerate(block):
            for t in own:
                asking.setdefault(t, []).append(q)
        terms, lists = list(asking), [np.array(x, np.int64) for x in asking.values()]
        overlapping = {n for n, t in enumerate(terms) if any(t[i:] == t[:-i] for i in range(1, len(t)))}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for n, t in enumerate(terms):
                found.add_word(t, n)
            found.make_automaton()
            best = Best(len(block), k, lambda i: [i])
            for batch in parts(batches) if terms else ():
                for i, body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    count = Counter(n for _, n in found.iter(body))
                    for n in overlapping & count.keys():
                        count[n] = body.count(terms[n])  # occurrences that don't overlap
                    if not count:
                        continue
                    own = [lists[n] for n in count]
                    score = np.bincount(np.concatenate(own), np.repeat(list(count.values()), [len(x) for x in own]), len(block))
                    for q in np.flatnonzero((score > 0) & (score >= best.floor)):
                        best.offer(int(q), float(score[q]), i, i)
            rows = list(best)
            yield pa.RecordBatch.from_arrays([pa.array([block[q][0] for q, _, _ in rows], q_kind[0]), pa.array([i for _, _, i in rows], i_kind[0]), pa.array([int(x) for _, x, _ in rows], pa.int64())], names=["qid", "id", "score"])

        return bodies.mapInArrow(run, schema).groupBy("qid", "id").agg(F.max("score").alias("score"))

    scored = in_blocks(questions, T.terms(F.col("question")), search)
    scored = corpus.sparkSession.createDataFrame([], schema) if scored is None else scored
    return top(scored, k, F.desc("score"), F.col("id")).select("qid", "rank", "id", "score")


def holding(docs: DataFrame, passages: DataFrame, most: int = 20_000) -> DataFrame:
    """(qid, id) of documents (id, body) that hold a passage (qid, passage) verbatim: one automaton of a block of passages over each text.

    Passages come in blocks of ``most``, however many there are; nothing but the pairs found is made or moved."""
    stated = passages.filter("passage is not null")
    (q_kind, q_name), (i_kind, i_name) = _kind(stated, "qid"), _kind(docs, "id")
    schema = f"qid {q_name}, id {i_name}"

    def search(block: list) -> DataFrame:
        held: dict[str, list] = {}
        for qid, passage in block:
            held.setdefault(passage, []).append(qid)
        everywhere = held.pop("", [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            found = ahocorasick.Automaton()
            for passage, qids in held.items():
                found.add_word(passage, qids)
            found.make_automaton()
            for batch in parts(batches):
                rows = []
                for i, body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    if body is not None:
                        own = set(everywhere).union(*(q for _, q in found.iter(body))) if held else everywhere
                        rows += [(q, i) for q in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], q_kind), pa.array([r[1] for r in rows], i_kind)], names=["qid", "id"])

        return docs.select("id", "body").mapInArrow(run, schema)

    found = in_blocks(stated, F.col("passage"), search, most)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def dense_search(chunks: DataFrame, queries: DataFrame, k: int = 3, block_rows: int = BLOCK) -> DataFrame:
    """(qid, rank, id, score): inner product, best chunk of each document, k best documents.

    chunks: id, vector; queries: qid, vector.  Queries come in blocks; a task keeps the k best documents of each query
    by its own chunks, among which every document of the k best is by its best chunk, so no pair is shuffled.
    """
    q_kind, i_kind = _kind(queries, "qid"), _kind(chunks, "id")
    schema = f"qid {q_kind[1]}, id {i_kind[1]}, s double"
    rows = chunks.select("id", F.col("vector").cast("array<double>").alias("v")).filter("v is not null")

    def search(block: list) -> DataFrame:
        asked = np.array([v for _, v in block], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(block), k, lambda i: [i])
            for batch in parts(batches, max(1, CELLS // max(1, len(block)))):
                ids = batch.column("id").to_pylist()
                if ids:
                    scores = asked @ batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).T
                    scores = np.where(np.isnan(scores), -np.inf, scores)
                    number = {i: n for n, i in enumerate(dict.fromkeys(ids))}
                    if len(number) < len(ids):  # the best chunk of each document
                        own = np.array([number[i] for i in ids])
                        at = np.argsort(own, kind="stable")
                        scores = np.maximum.reduceat(scores[:, at], np.flatnonzero(np.diff(own[at], prepend=-1)), axis=1)
                    least = best.floor if len(number) <= k else np.maximum(best.floor, np.partition(scores, -k, axis=1)[:, -k] - NEAR)
                    names = list(number)
                    for q, n in zip(*np.nonzero((scores >= least[:, None]) & (scores > -np.inf)), strict=True):
                        if scores[q, n] >= best.floor[q]:
                            best.offer(int(q), float(scores[q, n]), names[n], names[n])
            out = list(best)
            yield pa.RecordBatch.from_arrays([pa.array([block[q][0] for q, _, _ in out], q_kind[0]), pa.array([i for _, _, i in out], i_kind[0]), pa.array([x for _, x, _ in out], pa.float64())], names=["qid", "id", "s"])

        found = rows.mapInArrow(run, schema).groupBy("qid", "id").agg(F.max("s").alias("score"))
        return top(found, k, F.desc(F.round("score", 9)), F.col("id")).select("qid", "rank", "id", F.round("score", 6).alias("score"))

    found = in_blocks(queries.filter(F.col("vector").isNotNull()), F.col("vector").cast("array<double>"), search, block_rows)
    return chunks.sparkSession.createDataFrame([], f"qid {q_kind[1]}, rank long, id {i_kind[1]}, score double") if found is None else found


def fuse(lists: DataFrame, k: int = 3, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (source, qid, rank, id): a document counts once a list, at its first position."""
    first = lists.groupBy("source", "qid", "id").agg(F.min("rank").alias("rank"))
    sums = first.groupBy("qid", "id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"))
    return top(sums, k, F.desc(F.round("score", 12)), F.col("id")).select("qid", "rank", "id", F.round("score", 8).alias("score"))


def recall(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (3, 10)) -> DataFrame:
    """One row for each query with relevant documents: recall at each k, and whether all are there."""
    hits = relevant.join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("n_relevant"), *[F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in ks])
    return hits.select("qid", "n_relevant", *[F.round(F.col(f"hit_{k}") / F.col("n_relevant"), 6).alias(f"recall_{k}") for k in ks], *[(F.col(f"hit_{k}") == F.col("n_relevant")).alias(f"all_{k}") for k in ks])


def window_starts(length: Column, width: int, stride: int, most: int) -> Column:
    """Starts of windows over a length: every stride, at most so many, the last one moved to the end."""
    every = F.sequence(F.lit(0).cast("long"), F.greatest(length - width, F.lit(0)).cast("long"), F.lit(stride).cast("long"))
    aligned = F.array_distinct(F.concat(every, F.array(F.greatest(length - width, F.lit(0)).cast("long"))))
    return F.when(F.size(aligned) <= most, aligned).otherwise(F.concat(F.slice(aligned, 1, most - 1), F.slice(aligned, -1, 1)))


def rerank(candidates: DataFrame, bodies: DataFrame, questions: DataFrame, width: int = 256, stride: int = 256, most: int = 8) -> DataFrame:
    """Candidates (qid, rank, id) by their best window, ties in the old order; the score of a window is its distinct query terms.

    A model's score takes that place through a pandas UDF over (question, window).
    """
    words = bodies.select("id", T.tokens(F.col("text")).alias("t"))
    asked = questions.select("qid", F.array_distinct(T.tokens(F.col("question"))).alias("q"))
    listed = written(candidates.select("qid", "rank", "id"))
    joined = words.join(few(listed), "id").join(few(asked), "qid")
    # over an array of one token array, so that tokens are made once and not for each window
    score = lambda t: F.array_max(F.transform(window_starts(F.size(t), width, stride, most), lambda s: F.size(F.array_intersect(F.slice(t, (s + 1).cast("int"), width), F.col("q")))))
    scored = joined.select("qid", "id", F.col("rank").alias("old_rank"), F.get(F.transform(F.array("t"), score), F.lit(0)).cast("long").alias("score"))
    return top(scored, 10**6, F.desc("score"), F.col("old_rank")).select("qid", "rank", "id", "old_rank", "score")


def linked_hop(first: DataFrame, corpus: DataFrame) -> DataFrame:
    """Second hop: documents whose normalised title of at least two tokens is the start of a line of a document found first, and that are new."""
    first = written(first.select("qid", "id"))
    titles = corpus.select(F.col("id").alias("linked_id"), T.token_norm(F.array_join(F.slice(F.split("title", " "), 1, 3), " ")).alias("key")).filter("key like '% %'")
    lines = corpus.join(few(first.select("qid", "id")), "id").select("qid", "id", F.explode(F.split("text", "\n")).alias("line"))
    keys = lines.select("qid", "id", T.token_norm(F.array_join(F.slice(F.split("line", " "), 1, 3), " ")).alias("key")).filter("key <> ''").distinct()
    found = titles.join(few(written(keys), 200_000), "key").filter("linked_id <> id").select("qid", "linked_id", "key").distinct()
    new = found.join(few(first.select("qid", F.col("id").alias("linked_id"))), ["qid", "linked_id"], "left_anti")
    return top(new, 1, F.col("key"), F.col("linked_id")).select("qid", "linked_id", "key")
