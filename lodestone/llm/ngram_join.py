"""Operator 3: exact Jaccard join of word n-gram sets by prefix trees, and its components.

A document's set holds 64-bit hashes of its distinct n-grams.  Two sets link when ``den * |A & B| >= num * |A | B|``.

1. One pass over the texts.  A task packs its sets into bundles of a bounded number of grams; equal sets of a bundle
   (128-bit digests) are one.  A bundle sends each range of grams the pairs (gram, set) that it has there, as one binary
   row of six bytes a pair; a gram of many sets is counted for them in the bundle and sent once.
2. A range counts its grams and answers each bundle with the pairs whose gram others have too, and with the logarithm of
   the count.  A bundle so learns the order of its sets' grams, rarest first; a gram of one set only can't be shared,
   which settles most sets.  Of the others the rarest few grams (the prefix of the order) name the groups to join.
3. Equal sets of several bundles form a class; one member stands for it, so copies never meet as pairs.
4. Each group is a prefix tree of its sets, most frequent gram first, so near copies share long paths.  A set runs
   through the tree carrying its overlap so far; a subtree is left when the overlap that its lengths still allow is too
   small, or when all of it is in the set's component already.
   First, sets meet in groups of their two smallest hashes, which settles most components.  Then the groups of rare
   grams are cut by size: linked sets lie in one class of sizes or in two beside each other.  Such a group is joined if
   it still holds several components and isn't part of another one, in pairs of chunks if it is large, so no link
   between components is lost and no task holds more than two chunks.
5. Components of the links come from alternating star steps on a distributed edge table.

Grams are compared by the first 48 bits of their hashes: a false candidate is harmless, and a wrong overlap needs a
collision within one pair of sets, whose overlap it may raise by one.  The texts are read in one job, so their plan
must give the same rows when a task is run again, as a stored table does.

Defined cases: null and empty texts, and such without words, have an empty set and link with nothing; fewer words than
n make one gram of the whole sequence; rows of one doc_id are one node, with the links of all their texts; a null doc_id
gets the component of its class, or null if that has none; texts are read whole; an empty table gives no rows; no other
column is read by ``components_of``, and ``keep_one`` passes the others through.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, components, space_words, written

#: Sets of one chunk of a group, and sets of a bundle whose gram is counted there.
CHUNK, HOT = 512, 4
#: Grams of a bundle, after which it ends, and its sets, which a short number tells apart.
BUNDLE, BUNDLE_SETS = 1 << 20, 60_000
#: Bytes of text for each range of grams.
RANGE_BYTES = 4_000_000
#: Bits of a gram's hash that are compared.
BITS = 48


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def grams(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    n_here = min(n, len(h))
    length = len(h) - n_here + 1
    out = np.full(length, n_here, np.uint64)
    for i in range(n_here):  # a polynomial of the words' hashes, mixed after each step
        out = (out ^ h[i : i + length]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def least_overlap(n: int, num: int, den: int) -> int:
    """Grams that a set of n has at least in common with any set that it links with."""
    return -(-num * n // den)


def width(ranges: int) -> int:
    """Grams of a range."""
    return -(-(1 << BITS) // ranges)


def _pack(t: np.ndarray, start: int, wide: int) -> list[bytes]:
    """Sorted grams of the range from ``start``: how many lie in each span of 32 bits, and their places there."""
    own = t - np.uint64(start)
    return [np.bincount((own >> np.uint64(32)).astype(np.int64), minlength=((wide - 1) >> 32) + 1).astype("<u4").tobytes(), own.astype("<u4").tobytes()]


def _unpack(spans: bytes, places: bytes, start: int) -> np.ndarray:
    count = np.frombuffer(spans, "<u4")
    high = np.repeat(np.arange(len(count), dtype=np.uint64), count) << np.uint64(32)
    return (high | np.frombuffer(places, "<u4").astype(np.uint64)) + np.uint64(start)


PACKED = "slot long, bundle long, parts array<binary>"


def _packed(slots: list[int], bundles: list[int], parts: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(bundles, pa.int64()), pa.array(parts, pa.list_(pa.binary()))], names=["slot", "bundle", "parts"])


def _spread(grams_of: list[np.ndarray], bundle: int, ranges: int, own: list[bytes]) -> pa.RecordBatch:
    """The rows of a bundle: one for each range, and one (of a negative slot) for itself with its grams of many sets."""
    t = np.concatenate([np.empty(0, np.uint64), *grams_of]) >> np.uint64(64 - BITS)
    i = np.repeat(np.arange(len(grams_of), dtype=np.uint16), [len(g) for g in grams_of])
    order = np.argsort(t, kind="stable")
    t, i = t[order], i[order]
    many, start, count = np.unique(t, return_index=True, return_counts=True)
    hot = np.repeat(count >= HOT, count)
    own = [*own, many[count >= HOT].tobytes(), count[count >= HOT].astype("<u4").tobytes(), i[hot].tobytes()]
    t, i, count, many = t[~hot], i[~hot], count[count >= HOT], many[count >= HOT]
    wide = width(ranges)
    slots = np.union1d(t // np.uint64(wide), many // np.uint64(wide)).astype(np.int64)
    edges = lambda x: np.searchsorted(x // np.uint64(wide), np.append(slots, ranges + 1))
    cold, warm = edges(t), edges(many)
    parts = []
    for n, slot in enumerate(slots.tolist()):
        a, b = slice(cold[n], cold[n + 1]), slice(warm[n], warm[n + 1])
        parts.append([*_pack(t[a], slot * wide, wide), i[a].tobytes(), *_pack(many[b], slot * wide, wide), count[b].astype("<u4").tobytes()])
    return _packed([*slots.tolist(), -1 - bundle], [bundle] * (len(slots) + 1), [*parts, own])


def _bundles(size: int, ranges: int):
    def run(batches):
        hashes, made = WordHashes(), 0
        first = TaskContext.get().partitionId() << 20

        def flush():
            ns, ids = [len(g) for g in sets], [x for own in members for x in own]
            own = [np.array(ns, "<i8").tobytes(), b"".join(digests), np.array([len(x) for x in members], "<u4").tobytes(), np.array([x or 0 for x in ids], "<i8").tobytes(), np.array([x is None for x in ids], np.uint8).tobytes()]
            return _spread(sets, first | made, ranges, own)

        sets, members, digests, known, total = [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                g = grams(text.as_py(), size, hashes)
                digest = hashlib.blake2b(g.tobytes(), digest_size=16).digest()
                if len(g) and digest in known:
                    members[known[digest]].append(doc_id)
                    continue
                known[digest] = len(sets)
                sets.append(g)
                members.append([doc_id])
                digests.append(digest)
                total += len(g)
                if total >= BUNDLE or len(sets) >= BUNDLE_SETS:
                    yield flush()
                    made += 1
                    sets, members, digests, known, total = [], [], [], {}, 0
        if sets:
            yield flush()

    return run


def _answers(ranges: int):
    """A range's answers: of each bundle's pairs those whose gram others have, with the logarithms of the counts."""
    wide = width(ranges)

    def run(table):
        slot, bundles, parts = table.column("slot")[0].as_py(), table.column("bundle").to_pylist(), table.column("parts").to_pylist()
        if slot < 0:
            return table
        cold = [_unpack(p[0], p[1], slot * wide) for p in parts]
        warm = [_unpack(p[3], p[4], slot * wide) for p in parts]
        t = np.concatenate([*cold, *warm])
        weight = np.concatenate([np.ones(sum(map(len, cold)), np.int64), *[np.frombuffer(p[5], "<u4").astype(np.int64) for p in parts]])
        order = np.argsort(t, kind="stable")
        ordered = t[order]
        start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        code = np.empty(len(t), np.uint8)
        code[order] = np.repeat(logarithm(np.add.reduceat(weight[order], start)), np.diff(np.append(start, len(t))))
        out, at, hot = [], 0, sum(map(len, cold))
        for own, many, p in zip(cold, warm, parts, strict=True):
            c, h = code[at : at + len(own)], code[hot : hot + len(many)]
            at, hot, shared = at + len(own), hot + len(many), c > 0
            out.append([*_pack(own[shared], slot * wide, wide), np.frombuffer(p[2], np.uint16)[shared].tobytes(), c[shared].tobytes(), h.tobytes()])
        told = [n for n, p in enumerate(out) if p[1] or p[4]]
        return pa.Table.from_batches([_packed([slot] * len(told), [bundles[n] for n in told], [out[n] for n in told])])

    return run


def logarithm(f: np.ndarray) -> np.ndarray:
    """Of how many sets have a gram: 0 for one set, which nothing shares."""
    return np.minimum(np.log2(np.maximum(f, 1)).astype(np.uint8), 31)


def placed(f: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Grams as numbers whose order is that of the trees: by the logarithm of the frequency, frequent first, then by hash."""
    return (np.uint64(31) - logarithm(f).astype(np.uint64)) << np.uint64(BITS) | t.astype(np.uint64)


STORED = "id long, docs array<long>, n long, k1 long, k2 long, path binary, first array<long>, groups array<long>"


def _stored(ranges: int, num: int, den: int):
    """A bundle's sets: the path of those that may link, in the trees' order, and the groups that they belong to."""
    wide = width(ranges)

    def run(table):
        bundle, rows = table.column("bundle")[0].as_py(), sorted(zip(table.column("slot").to_pylist(), table.column("parts").to_pylist(), strict=True))
        ns, digests, counts, ids, nulls, hot, times, members = rows[0][1]
        n, keys, docs = np.frombuffer(ns, "<i8"), np.frombuffer(digests, "<i8"), [None if x else i for i, x in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(nulls, np.uint8).tolist(), strict=True)]
        times = np.frombuffer(times, "<u4")
        codes = np.frombuffer(b"".join(p[4] for _, p in rows[1:]), np.uint8)
        t = np.concatenate([np.repeat(np.frombuffer(hot, "<u8"), times), *[_unpack(p[0], p[1], slot * wide) for slot, p in rows[1:]]])
        i = np.concatenate([np.frombuffer(members, np.uint16), *[np.frombuffer(p[2], np.uint16) for _, p in rows[1:]]])
        code = np.concatenate([np.repeat(codes, times), *[np.frombuffer(p[3], np.uint8) for _, p in rows[1:]]])
        path = (np.uint64(31) - code.astype(np.uint64)) << np.uint64(BITS) | t
        order = np.lexsort((path, i))
        path, edges = path[order], np.searchsorted(i[order], np.arange(len(n) + 1))
        out = {"path": [], "first": [], "groups": []}
        for s in range(len(n)):
            own, size = path[edges[s] : edges[s + 1]], int(n[s])
            rest = len(own) - least_overlap(size, num, den) + 1  # of the rarest-first prefix, grams that others have
            if not size or rest <= 0:
                for kept in out.values():
                    kept.append(None)
                continue
            g = own & np.uint64((1 << BITS) - 1)
            out["path"].append(own.tobytes())
            out["first"].append([int(g.min()), int(g[np.argmin(g * np.uint64(0xD6E8FEB86659FD93))])])
            out["groups"].append(g[-rest:].astype(np.int64))
        at = np.concatenate(([0], np.cumsum(np.frombuffer(counts, "<u4"), dtype=np.int64)))
        columns = {"id": (bundle << 16) + np.arange(len(n)), "docs": [docs[at[s] : at[s + 1]] for s in range(len(n))], "n": n, "k1": pa.array(keys[::2], mask=n == 0), "k2": pa.array(keys[1::2], mask=n == 0), **out}
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({c: v if isinstance(v, pa.Array) else pa.array(v, k) for (c, v), k in zip(columns.items(), kinds, strict=True)})

    return run


class Tree:
    """A prefix tree with compressed paths over sorted rank arrays; each node knows its sets' least and greatest size."""

    __slots__ = ("segment", "last", "depth", "ends", "children", "low", "high", "deep", "label")

    def __init__(self, sets: list[np.ndarray], sizes: list[int], order: list[int], depth: int):
        a, b = sets[order[0]], sets[order[-1]]  # in lexicographic order, all share what these two share
        n = min(len(a), len(b))
        differ = np.nonzero(a[depth:n] != b[depth:n])[0]
        end = depth + int(differ[0]) if len(differ) else n
        self.segment, self.depth = a[depth:end], end
        self.last = int(a[end - 1]) if end else -1
        self.ends = [i for i in order if len(sets[i]) == end]
        rest, self.children = order[len(self.ends) :], []
        at = 0
        while at < len(rest):
            token, to = sets[rest[at]][end], at + 1
            while to < len(rest) and sets[rest[to]][end] == token:
                to += 1
            self.children.append(Tree(sets, sizes, rest[at:to], end))
            at = to
        own = [sizes[i] for i in order]
        self.low, self.high = min(own), max(own)
        self.deep = max(len(sets[i]) for i in order)  # longest path below
        self.label = -1  # a set of the subtree, if all of it is known to be one component


def tree_links(ids: list[int], sizes: list[int], labels: list[int], paths: list[bytes], sides: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect the components (``labels``) of a group's sets: those of side 1 with the others, and those of side 2 with each other; all 0: within."""
    grams_of = [np.frombuffer(p, "<u8") for p in paths]
    _, rank = np.unique(np.concatenate(grams_of), return_inverse=True)
    sets = np.split(rank, np.cumsum([len(p) for p in grams_of])[:-1])  # sorted, as the paths are
    stored = [i for i, s in enumerate(sides) if s != 1]
    asking = [i for i, s in enumerate(sides) if s] or (stored if len(stored) > 1 else [])
    if not stored or not asking:  # a chunk that the hash left empty
        return []
    tree = Tree(sets, sizes, sorted(stored, key=lambda i: sets[i].astype(">u4").tobytes()), 0)
    parent: dict[int, int] = {x: x for x in labels}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    has = np.zeros(int(rank.max(initial=0)) + 1, bool)
    ratio = num + den

    def visit(node: Tree, q: int, overlap: int):
        own = find(labels[q])
        if node.label >= 0 and find(labels[node.label]) == own:
            return
        overlap += int(np.count_nonzero(has[node.segment]))
        here = sets[q]
        left = len(here) - int(np.searchsorted(here, node.last, "right")) if node.last >= 0 else len(here)
        best = overlap + min(left, node.deep - node.depth)
        # overlap >= num / (num + den) * (sizes' sum), for the smallest set below
        if ratio * best < num * (sizes[q] + node.low):
            return
        for x in node.ends:
            if find(labels[x]) != own and ratio * overlap >= num * (sizes[q] + sizes[x]):
                found.append((ids[q], ids[x]))
                parent[find(labels[x])] = own
                own = find(own)
        for child in node.children:
            visit(child, q, overlap)
        known = {find(labels[x]) for x in node.ends} | {find(labels[c.label]) if c.label >= 0 else None for c in node.children}
        if len(known) == 1 and None not in known:
            node.label = node.ends[0] if node.ends else node.children[0].label

    for q in asking:
        has[sets[q]] = True
        visit(tree, q, 0)
        has[sets[q]] = False
    return found


def _join_groups(num: int, den: int):
    def run(table):
        sys.setrecursionlimit(20_000)  # a path of the tree branches at most once for each set
        cols = {c: table.column(c).to_pylist() for c in ("id", "n", "label", "path", "side")}
        links = tree_links(cols["id"], cols["n"], cols["label"], cols["path"], cols["side"], num, den) if table.num_rows > 1 else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _joined(members: DataFrame, sets: DataFrame, num: int, den: int, keys: list[str]) -> DataFrame:
    """Links of the groups of ``members`` (keys, id, label, side)."""
    full = members.join(sets.select("id", "n", "path"), "id")
    return full.groupBy(*keys).applyInArrow(_join_groups(num, den), "a long, b long")


def linked(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets of the bundles, with the class's id; classes of several sets or documents; components: id, component) of the documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # 1., 2. sets and the order of their grams
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES + 1), 1 << 24)
    pairs = arrow_map(texts, _bundles(size, ranges), PACKED)
    answers = pairs.groupBy("slot").applyInArrow(_answers(ranges), PACKED)
    sets = written(answers.groupBy("bundle").applyInArrow(_stored(ranges, num, den), STORED))
    # 3. classes of equal sets
    classes = sets.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("class"), F.count("*").alias("sets")).filter("sets > 1")
    classes = checkpointed(sets.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "class"))
    others = classes.filter("id <> class").select("id")
    # 4a. groups of the smallest hashes, in chunks
    first = sets.filter("path is not null").select("id", F.explode(F.array_distinct("first")).alias("token")).join(others, "id", "left_anti")
    sizes = first.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    members = first.join(sizes, "token").select("id", "token", F.pmod(F.xxhash64("id"), F.ceil(F.col("f") / chunk)).alias("part"), F.col("id").alias("label"), F.lit(0).alias("side"))
    links = checkpointed(_joined(members, sets, num, den, ["token", "part"]))
    found = checkpointed(components(links))
    # 4b. rarest-first groups by size that hold several components, all pairs of chunks
    step = max(math.log(den / num), 1e-3) * (1 + 1e-9)  # of linked sets, the larger is in the class of the smaller or in the next one
    labelled = sets.filter("path is not null").select("id", F.floor(F.log("n") / step).cast("int").alias("level"), "groups").join(others, "id", "left_anti")
    labelled = labelled.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"), "level", "groups")
    sided = F.inline(F.array(*[F.struct((F.col("level") - below).cast("int").alias("level"), F.lit(side).alias("side")) for below, side in ((0, 2), (1, 1))]))
    places = labelled.select("id", "label", "level", F.explode("groups").alias("token")).select("id", "label", "token", sided)
    who = lambda seed: F.bit_xor(F.xxhash64("id", "side", F.lit(seed)))
    mixed = places.groupBy("token", "level").agg(F.count_if(F.col("side") == 2).alias("own"), F.count_if(F.col("side") == 1).alias("next"), F.min("label").alias("l"), F.max("label").alias("m"), who(0).alias("who"), who(1).alias("whose")).filter("l <> m and own > 0")
    mixed = mixed.groupBy("level", "own", "next", "who", "whose").agg(F.min("token").alias("token"))  # groups of the same sets once
    inside = places.join(mixed.select("token", "level", "own", "next"), ["token", "level"])
    # a group whose sets all have the same larger group is part of that
    largest = inside.groupBy("id", "level").agg(F.max(F.struct(F.col("own") + F.col("next"), "token"))["token"].alias("largest"))
    whole = inside.join(largest, ["id", "level"]).groupBy("token", "level").agg(F.min("largest").alias("a"), F.max("largest").alias("b")).filter("a <> b or a = token").select("token", "level")
    inside = checkpointed(inside.join(whole, ["token", "level"], "left_semi"))
    rest = checkpointed(_joined(_chunks(inside, chunk), sets, num, den, ["token", "level", "kind", "i", "j"]))
    # 5. rows of one doc_id are one node
    rows = sets.select("id", F.explode("docs").alias("doc_id")).join(classes, "id", "left").select(F.coalesce("class", "id").alias("id"), "doc_id")
    same = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("m")).filter("a <> m")
    same = rows.join(same, "doc_id").filter("id <> a").select("a", F.col("id").alias("b"))
    rest = checkpointed(rest.unionByName(same))
    if not rest.isEmpty():
        found = checkpointed(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest)))
    return sets, classes, found


def _chunks(inside: DataFrame, chunk: int) -> DataFrame:
    """Members of the groups' chunks: a small group is one, of a large one each pair of chunks whose sets may link is one."""
    own, others = (F.greatest(F.lit(1), F.ceil(F.col(c) / chunk)).cast("int") for c in ("own", "next"))
    inside = inside.select("id", "label", "token", "level", "side", (F.col("own") + F.col("next") <= chunk).alias("small"), own.alias("own"), others.alias("others"))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 2, F.col("own")).otherwise(F.col("others"))).cast("int")
    inside = inside.withColumn("mine", mine)
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    me, none = F.col("mine"), F.lit(0)
    within = F.transform(to("own"), lambda x: place(0, F.least(me, x), F.greatest(me, x), F.when(me == x, 2).otherwise((me > x).cast("int"))))
    across = F.transform(to("others"), lambda x: place(1, me, x, none))
    asked = F.transform(to("own"), lambda x: place(1, x, me, F.lit(1)))
    where = F.when(F.col("small"), F.array(place(0, none, none, F.col("side")))).when(F.col("side") == 2, F.concat(within, across)).otherwise(asked)
    return inside.select("id", "label", "token", "level", F.inline(where))


def components_of(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    sets, classes, found = linked(docs, size, num, den)
    named = sets.select("id", F.array_min("docs").alias("least"), (F.size("docs") > 1).alias("several")).join(classes, "id", "left")
    found = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
    named = named.join(found.withColumnRenamed("id", "class_id"), F.coalesce("class", "id") == F.col("class_id"), "left").filter("several or class is not null or component is not null")
    named = named.select("id", "least", F.coalesce("component", "class", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(F.col("id").alias("named"), "component_id")
    return sets.select("id", "n", F.explode("docs").alias("doc_id")).join(named, F.col("id") == F.col("named"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents but those with a smaller doc_id in their component; the ids that go are joined, never the texts sorted.

    Rows of one doc_id are one document and stay or go together; a row without a doc_id stays, as nothing names it.
    """
    gone = components_of(docs, size, num, den).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("_gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute(rows: list[tuple[int | None, str | None]], size: int = 4, num: int = 85, den: int = 100) -> list[tuple]:
    """For tests: the query's rows from all pairs of sets of word tuples."""
    sets = []
    for _, t in rows:
        w = space_words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)]


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.y FROM r JOIN l ON r.c = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = d.doc_id
"""
