"""Operator 1: toxicity by a lexicon trie intersected with Levenshtein automata, scored in context.

The lexicon is learned from labelled rows: whole words, and stems that many different words begin with, whose rate in
toxic texts is many times that in clean ones and which stand in many different contexts.  The trie of the lexicon and
the Levenshtein automata of its words are intersected and made deterministic lazily: a state is a set of (trie node,
edits so far), and a token runs through a few dictionary lookups until it dies or ends.  Each hit gets the weight of
its term, less for each edit; a hit between quotation marks or beside a reporting verb, with no second person and no
other hit near it, counts as quotation.  The score is a noisy-or of the hits.

The model is fitted on at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled rows, the first by hash; scoring is one pass
over all whole texts without a shuffle.

Defined cases: null and empty texts get the base score; labels that are null are not learned from; a doc_id labelled
twice counts as toxic if either label says so; with no labels the lexicon is empty; rows that repeat a doc_id are
scored each by itself; labels, lang, source and doc_id are no inputs of a score; other columns pass through ``reject``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Labelled rows that the lexicon is learned from, at most.
MAX_TOXIC, MAX_CLEAN = 10_000, 30_000
#: A word stands in at least so many toxic texts, a stem in so many; either in such a share of them, and so much more frequently than in clean ones.
MIN_WORD_TEXTS, MIN_STEM_TEXTS, MIN_SHARE, MIN_ODDS = 5, 3, 0.01, 50.0
#: Different words before a word (up to 63 are told apart): a share of its texts, within these bounds.  Different words that begin with a stem: at least so many.
MIN_CONTEXTS, CONTEXTS_SHARE, MOST_CONTEXTS, STEM_WORDS = 5, 0.4, 20, 8
#: A stem is taken if no single word makes up more than this share of its texts.
STEM_SHARE = 0.6
STEMS = range(4, 8)
#: Edits that a word of at least so many letters may have.
EDITS = {5: 1, 9: 2}
BASE_SCORE, PER_EDIT, QUOTED, PERSONAL = 0.02, 0.85, 0.4, 1.25
WINDOW = 8
#: Cues of quotation and of address.
REPORTING = frozenset("said says wrote called calls quote quoted quoting dit sagte schrieb dijo".split())
SECOND_PERSON = frozenset("you your yours youre u du dich dein deine ihr euch tu toi ton vous votre usted tus te".split())
QUOTES = '"“”„«»‘’`'
TOKEN = re.compile(r"\w+")


def allowed(word: str) -> int:
    return max((k for least, k in EDITS.items() if len(word) >= least), default=0)


@dataclass
class Lexicon:
    """words and stems -> weight (probability that a text with it is toxic); excepted: misspellings known to be clean words."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    excepted: frozenset = frozenset()


class Matcher:
    """The lexicon's trie intersected with the Levenshtein automata of its words, made deterministic on demand."""

    def __init__(self, lexicon: Lexicon, most: int = 500_000):
        self.lexicon, self.known, self.most = lexicon, {}, most
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.room = [0]  # most edits that a word below the node may have
        for w in lexicon.words:
            node = self._node(w, allowed(w))
            self.word[node] = w
        for s in lexicon.stems:
            self.stem[self._node(s, 0)] = s
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[float, str, int] | None] = []
        self.stops: list[tuple[float, str, int] | None] = []
        self.start = self._state({0: 0})

    def _node(self, word: str, room: int) -> int:
        node = 0
        self.room[0] = max(self.room[0], room)
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.word.append(None)
                self.stem.append(None)
                self.room.append(0)
            node = self.children[node][c]
            self.room[node] = max(self.room[node], room)
        return node

    def _state(self, reached: dict[int, int]) -> int:
        """The state of these (node, least edits), closed under letters that the token leaves out."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            if e < self.room[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.room[child] and e + 1 < reached.get(child, 99):
                        reached[child] = e + 1
                        todo.append((child, e + 1))
        key = frozenset(reached.items())
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(self.lexicon.words[w] * PER_EDIT**e, w, e) for n, e in key if (w := self.word[n]) is not None and e <= allowed(w)]
            self.ends.append(max(ends, default=None))
            stops = [(self.lexicon.stems[s], s, 0) for n, e in key if e == 0 and (s := self.stem[n]) is not None]
            self.stops.append(max(stops, default=None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def put(node, e):
            if e <= self.room[node] and e < reached.get(node, 99):
                reached[node] = e

        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
            put(node, e + 1)
        for node, e in self.sets[state]:  # a stem's own path has no room for edits
            child = self.children[node].get(c)
            if child is not None and e == 0:
                reached[child] = 0
        to = self._state(reached)
        self.moves[state][c] = to
        return to

    def run(self, token: str) -> tuple[float, str, int] | None:
        """(weight, term, edits) of the best match of a lower-case token."""
        state, stem = self.start, None
        for c in token:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return stem
            stem = self.stops[state] or stem
        end = self.ends[state]
        if end and end[2] and token in self.lexicon.excepted:
            end = None
        return max(end or (0.0, "", 0), stem or (0.0, "", 0)) if end or stem else None

    def hits(self, tokens: set[str]) -> dict[str, tuple[float, str, int]]:
        if len(self.known) > self.most:
            self.known.clear()
        found = {}
        for t in tokens:
            try:
                hit = self.known[t]
            except KeyError:
                hit = self.known[t] = self.run(t)
            if hit:
                found[t] = hit
        return found


def score(text: str | None, matcher: Matcher) -> tuple[float, int, int]:
    """(score, hits, quoted hits) of one whole text."""
    if not text:
        return BASE_SCORE, 0, 0
    lower = text.lower()
    words = TOKEN.findall(lower)
    hits = matcher.hits(set(words))
    if not hits:
        return BASE_SCORE, 0, 0
    at = [i for i, w in enumerate(words) if w in hits]
    spans = [m.span() for m in TOKEN.finditer(lower)]
    clean, quoted = 1 - BASE_SCORE, 0
    for k, i in enumerate(at):
        a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        near = words[a:i] + words[i + 1 : b]
        before, after = lower[spans[a][0] : spans[i][0]], lower[spans[i][1] : spans[b - 1][1] + 1]
        alone = not (k and at[k - 1] >= a) and not (k + 1 < len(at) and at[k + 1] < b)
        personal = any(w in SECOND_PERSON for w in near)
        marks = sum(map(before.count, QUOTES)) % 2 == 1 and any(q in after for q in QUOTES)
        weight = hits[words[i]][0]
        if (marks or any(w in REPORTING for w in near)) and alone and not personal:
            weight *= QUOTED
            quoted += 1
        elif personal:
            weight = min(1.0, weight * PERSONAL)
        clean *= 1 - min(weight, 0.999)
    return 1 - clean, len(at), quoted


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches):
    """(feature, stem?, toxic texts, clean texts, bits of the words before a word or with a stem), summed for each task."""
    counts: dict[tuple[str, bool], list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = TOKEN.findall((text or "").lower())
            seen: dict[tuple[str, bool], int] = {}
            before = ""
            for w in words:
                if 3 <= len(w) <= 40 and not w.isdigit():
                    bit = 1 << zlib.crc32(before.encode()) % 63 if toxic else 0
                    own = 1 << zlib.crc32(w.encode()) % 63 if toxic else 0
                    seen[w, False] = seen.get((w, False), 0) | bit
                    for n in STEMS:
                        if len(w) > n:
                            s = w[:n]
                            seen[s, True] = seen.get((s, True), 0) | own
                before = w
            for key, bits in seen.items():
                own = counts.setdefault(key, [0, 0, 0])
                own[0 if toxic else 1] += 1
                own[2] |= bits
    items = list(counts.items())
    for i in range(0, len(items), 50_000):
        part = items[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k, _ in part]), pa.array([k[1] for k, _ in part]), *[pa.array([v[j] for _, v in part], pa.int64()) for j in range(3)],
        ], names=["feature", "stem", "toxic", "clean", "bits"])


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Lexicon:
    """A lexicon from labelled rows that are not held out, at most so many of either label."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda toxic, n: own.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(1, max_toxic).unionByName(first(0, max_clean)).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", F.col("toxic").cast("long").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic:
        return Lexicon()
    counts = arrow_map(texts, _features, "feature string, stem boolean, toxic long, clean long, bits long").groupBy("feature", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("bits")).alias("contexts"))
    counts = counts.persist()
    try:
        rate, base = (F.col("toxic") + 0.5) / (n_toxic + 1.0), (F.col("clean") + 0.5) / (n_clean + 1.0)
        texts_least = F.greatest(F.when(F.col("stem"), MIN_STEM_TEXTS).otherwise(MIN_WORD_TEXTS), F.lit(MIN_SHARE * n_toxic))
        contexts_least = F.when(F.col("stem"), STEM_WORDS).otherwise(F.greatest(F.lit(MIN_CONTEXTS), F.least(F.lit(MOST_CONTEXTS), CONTEXTS_SHARE * F.col("toxic"))))
        good = counts.filter((F.col("toxic") >= texts_least) & (F.col("contexts") >= contexts_least) & (rate / base >= MIN_ODDS))
        lexicon = chosen([(r["feature"], r["stem"], r["toxic"], r["clean"]) for r in good.collect()], n_toxic, n_clean)
        excepted = arrow_map(counts.filter("not stem and clean > toxic").select("feature"), _near(lexicon), "feature string").collect()
        lexicon.excepted = frozenset(r["feature"] for r in excepted)
    finally:
        counts.unpersist()
    return lexicon


def _near(lexicon: Lexicon):
    def run(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([(hit := matcher.run(w)) is not None and hit[2] > 0 for w in batch.column("feature").to_pylist()], pa.bool_()))

    return run


def chosen(terms: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int) -> Lexicon:
    """Stems shared by many words, shortest first but grown while nearly all their texts stay; then the words that no stem covers."""
    weight = lambda t, c: (r := (t + 0.5) / (n_toxic + 1)) * 0.1 / (r * 0.1 + (c + 0.5) / (n_clean + 1) * 0.9)  # noqa: E731  the prior: one text in ten
    words = {f: (t, c) for f, stem, t, c in terms if not stem}
    most: dict[str, int] = {}
    for w, (t, _) in words.items():
        for n in STEMS:
            if len(w) >= n:
                most[w[:n]] = max(most.get(w[:n], 0), t)
    lexicon = Lexicon()
    stems = {f: (t, c) for f, stem, t, c in terms if stem and most.get(f, 0) <= STEM_SHARE * t}
    for f in sorted(stems, key=lambda f: (len(f), f)):
        if any(f[:n] in lexicon.stems for n in STEMS):
            continue
        while longer := [g for g, (t, _) in stems.items() if len(g) == len(f) + 1 and g.startswith(f) and t >= 0.9 * stems[f][0]]:
            f = longer[0]
        lexicon.stems[f] = weight(*stems[f])
    for w, (t, c) in words.items():
        if not any(w[:n] in lexicon.stems for n in STEMS):
            lexicon.words[w] = weight(t, c)
    return lexicon


def _score_all(lexicon: Lexicon, least: float | None = None):
    def run(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [score(t.as_py(), matcher) for t in batch.column("text")]
            if least is not None:
                yield batch.filter(pa.array([s < least for s, _, _ in found], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=["doc_id", "score", "n_hits", "n_quoted"])

    return run


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_hits, n_quoted of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(texts, _score_all(lexicon), "doc_id long, score double, n_hits long, n_quoted long")


def reject(docs: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """The rows whose score is below ``least``, unchanged."""
    return arrow_map(docs, _score_all(lexicon, least), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted")
