"""Selections by hash order: samples, label minima, disjoint entities, quotas, risk subsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import checkpointed
from .datasets import hash_order


def uniform_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows without replacement, the first by hash: any n are equally likely, and reruns agree."""
    return df.withColumn("_h", hash_order(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def balanced(df: DataFrame, key: str, labels: str, seed: str, count: int, minima: dict[str, int]) -> DataFrame:
    """(place, key): rows in hash order, each label's minimum first (a row counts for all its labels), then the rest up to ``count``.

    A choice never looks beyond the first ``count`` rows of a label, so those of each label and of all rows are enough:
    what meets in one task is bounded by the labels and the count, not by the table.
    """
    rows = df.select(key, labels, hash_order(seed, F.col(key)).alias("h"))
    first = lambda part, by: part.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("h", key))).filter(F.col("_r") <= count).select(key, labels, "h")
    per = first(rows.select("*", F.explode(labels).alias("_l")).filter(F.col("_l").isin(*minima)), "_l") if minima else rows.limit(0)
    near = per.unionByName(rows.orderBy("h", key).limit(count)).dropDuplicates([key])

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", key])
        ordered = [(k, set(v)) for k, v in zip(part[key], part[labels], strict=True)]
        taken: dict = {}
        have = dict.fromkeys(minima, 0)

        def take(k, own):
            taken[k] = len(taken) + 1
            for x in own & have.keys():
                have[x] += 1

        for label, least in minima.items():
            for k, own in ordered:
                if have[label] >= least or len(taken) >= count:
                    break
                if label in own and k not in taken:
                    take(k, own)
        for k, own in ordered:
            if len(taken) >= count:
                break
            if k not in taken:
                take(k, own)
        return pd.DataFrame([(place, k) for k, place in taken.items()], columns=["place", key])

    return near.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda part: choose(part), f"place long, {key} {dict(df.dtypes)[key]}")


def smallest_cohort(df: DataFrame, key: str, labels: str, seed: str, gates: dict[str, int], sizes: range) -> DataFrame | None:
    """The balanced choice of the least size whose rows reach every gate (rows of each label); None if no size does.  Each try is a bounded choice."""
    for size in sizes:
        chosen = checkpointed(balanced(df, key, labels, seed, size, gates))
        have = {r["l"]: r["c"] for r in chosen.join(df.select(key, F.explode(labels).alias("l")), key).filter(F.col("l").isin(*gates)).groupBy("l").agg(F.count_distinct(key).alias("c")).collect()}
        if chosen.count() == size and all(have.get(label, 0) >= n for label, n in gates.items()):
            return chosen
    return None


def deficit_cohort(df: DataFrame, key: str, source: str, kind: str, labels: str, seed: str, sizes: range, n_sources: int, least_share: dict[str, int], most_share: dict[str, int], least_labels: dict[str, int]) -> DataFrame:
    """(place, key): the smallest cohort, of the sizes tried in order, that meets every gate; no rows if none does.

    The first sources by hash each give one row, then rows fill the size; each time the row is taken whose kind and labels
    are lacking most, ties by hash.  Gates: ``least_share`` and ``most_share`` of kinds in percent, ``least_labels`` rows
    of a label.  A row's lack depends on its kind and its gated labels alone, so of a source and such a signature only the
    first row by hash can be taken for the source, and of a signature only as many as the largest cohort fill it: these
    rows meet in one task, bounded by signatures, sources and sizes whatever the table."""
    gated = F.array_sort(F.array_intersect(F.coalesce(labels, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in least_labels])))
    rows = df.filter(F.col(source).isNotNull()).select(F.col(key).alias("k"), F.col(source).alias("s"), F.coalesce(F.col(kind), F.lit("")).alias("c"), gated.alias("l"), hash_order(f"{seed}-pick", F.col(key)).alias("pick"), hash_order(f"{seed}-fill", F.col(key)).alias("fill"))
    firsts = rows.groupBy("s").count().select("s", hash_order(f"{seed}-source", F.col("s")).alias("h")).orderBy("h", "s").limit(n_sources)
    most = max(sizes, default=0)
    of_sources = rows.join(F.broadcast(firsts), "s").withColumn("n", F.row_number().over(Window.partitionBy("s", "c", "l").orderBy(F.desc("pick"), F.desc("k")))).filter("n = 1").withColumn("part", F.lit(0))
    filling = rows.withColumn("n", F.row_number().over(Window.partitionBy("c", "l").orderBy(F.desc("fill"), F.desc("k")))).filter(F.col("n") <= most + n_sources).withColumn("h", F.lit("")).withColumn("part", F.lit(1))
    bounded = of_sources.select("part", "h", "s", "k", "c", "l", "pick", "fill").unionByName(filling.select("part", "h", "s", "k", "c", "l", "pick", "fill"))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part["l"] = [tuple(x) for x in part["l"]]
        heads = part[part["part"] == 0].sort_values(["h", "s"])
        wanted = [list(g[["pick", "k", "c", "l", "s"]].itertuples(index=False)) for _, g in heads.groupby(["h", "s"], sort=True)]
        pools = {(c, l): list(g.sort_values(["fill", "k"], ascending=False)[["fill", "k", "s"]].itertuples(index=False)) for (c, l), g in part[part["part"] == 1].groupby(["c", "l"])}
        if len(wanted) < n_sources:
            return pd.DataFrame({"place": [], "k": []})
        for size in sizes:
            floor = {c: -(-size * p // 100) for c, p in least_share.items()}
            kinds, have, taken = dict.fromkeys(floor, 0), dict.fromkeys(least_labels, 0), {}
            every: dict = {}

            def lack(c, l, kinds=kinds, have=have, floor=floor):
                return (c in floor and kinds[c] < floor[c]) + sum(have[x] < least_labels[x] for x in l)

            def take(k, c, l, kinds=kinds, have=have, taken=taken, every=every):
                taken[k] = len(taken) + 1
                every[c] = every.get(c, 0) + 1
                if c in kinds:
                    kinds[c] += 1
                for x in l:
                    have[x] += 1

            for options in wanted:
                best = max(options, key=lambda r: (lack(r.c, r.l), r.pick, r.k))
                take(best.k, best.c, best.l)
            if len(taken) > size:
                continue
            at = dict.fromkeys(pools, 0)
            while len(taken) < size:
                for s, rows_ in pools.items():
                    while at[s] < len(rows_) and rows_[at[s]].k in taken:
                        at[s] += 1
                ready = [(lack(*s), pools[s][at[s]].fill, pools[s][at[s]].k, s) for s in pools if at[s] < len(pools[s])]
                if not ready:
                    break
                _, _, k, s = max(ready)
                take(k, *s)
            met = len(taken) == size and all(100 * every.get(c, 0) >= p * size for c, p in least_share.items()) and all(100 * every.get(c, 0) <= p * size for c, p in most_share.items()) and all(have[x] >= n for x, n in least_labels.items())
            if met:
                return pd.DataFrame([(n, k) for k, n in taken.items()], columns=["place", "k"])
        return pd.DataFrame({"place": [], "k": []})

    kind_of_key = dict(df.dtypes)[key]
    return bounded.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda part: choose(part), f"place long, k {kind_of_key}").withColumnRenamed("k", key)


def bounded_scan(df: DataFrame, accepted, want: int, most: int) -> DataFrame:
    """The first ``want`` rows that are accepted among the first ``most`` in the source's order; Spark stops reading when it has them."""
    return df.limit(most).filter(accepted).limit(want)


def review_pool(reviews: DataFrame, keys: tuple[str, ...] = ("id", "reviewer")) -> DataFrame:
    """(id, approved, labels): of reviews (id, reviewer, attempt, verdict, labels) the last attempt of each reviewer, approval by both of two, the labels that both gave."""
    last = reviews.groupBy(*keys).agg(F.max_by(F.struct("verdict", "labels"), "attempt").alias("r"))
    g = last.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("r.verdict") == "approve").alias("yes"), F.min_by("r.labels", "reviewer").alias("a"), F.max_by("r.labels", "reviewer").alias("b"))
    both = (F.col("n") == 2) & (F.col("yes") == 2)
    return g.select("id", both.alias("approved"), F.when(both, F.array_sort(F.array_intersect("a", "b"))).alias("labels"))


def disjoint_rounds(df: DataFrame, key: str, order: str, elements: str, most_rounds: int = 200) -> DataFrame:
    """Keys accepted in (order, key) if they share no element with an accepted one, as a walk in that order accepts them.

    In a round every row that comes first for all of its elements is accepted, and rows that share an element with one
    go; the walk's answer is the only one that this leads to.  Nothing is folded in one task.
    """
    left = checkpointed(df.filter(F.size(elements) > 0).select(key, F.struct(order, key).alias("o"), F.explode(F.array_distinct(elements)).alias("e")))
    taken = None
    for _ in range(most_rounds):
        if left.isEmpty():
            return taken if taken is not None else df.select(key).limit(0)
        first = left.groupBy("e").agg(F.min("o").alias("m"))
        won = left.join(first, "e").groupBy(key).agg(F.min((F.col("o") == F.col("m")).cast("int")).alias("w")).filter("w = 1").select(key)
        won = checkpointed(won)
        taken = won if taken is None else taken.unionByName(won)
        used = left.join(won, key, "left_semi").select("e").distinct()
        lost = left.join(used, "e", "left_semi").select(key).distinct()
        left = checkpointed(left.join(lost, key, "left_anti"))
    raise RuntimeError("the selection did not end")


def quota_disjoint(df: DataFrame, shard: str, order: str, key: str, category: str, elements: str, quotas: dict[str, int], banned: frozenset = frozenset(), most_rounds: int = 1000) -> DataFrame:
    """(shard, place, key): rows in order whose category still has room and whose elements are new to the shard and not banned.

    The walk's answer by rounds.  A row is sure of its room if it is among the first of its category's open and accepted
    rows, as many as the quota is; it is accepted once it is also the first open row for each of its elements.  Rows that
    share an element with an accepted one go, and so do a category's rows when its first ones are all accepted.  The
    first open row of a shard is decided in every round, most rounds decide many; of a group of any size only the first
    rows of a quota meet in a task.  Keys are unique; a category without a quota has none."""
    room = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    usable = ~F.arrays_overlap("e", F.array(*[F.lit(x) for x in banned])) if banned else F.lit(True)
    rows = df.filter(F.col(category).isin([c for c, n in quotas.items() if n > 0])).select(F.col(shard).alias("s"), F.struct(F.col(order).alias("by"), F.col(key).alias("key")).alias("o"), F.col(category).alias("c"), F.array_distinct(elements).alias("e")).filter(usable)
    left, taken = checkpointed(rows.withColumn("room", room[F.col("c")])), None
    place = F.row_number().over(Window.partitionBy("s", "c").orderBy("o"))
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        pool = left.select("s", "c", "o", "room", F.lit(0).alias("in"))
        pool = pool if taken is None else pool.unionByName(taken.select("s", "c", "o", "room", F.lit(1).alias("in")))
        head = checkpointed(pool.withColumn("n", place).filter(F.col("n") <= max(quotas.values())).filter(F.col("n") <= F.col("room")))
        closed = head.groupBy("s", "c").agg(F.sum("in").alias("in"), F.first("room").alias("room")).filter(F.col("in") == F.col("room")).select("s", "c")
        open_ = left.join(F.broadcast(closed), ["s", "c"], "left_anti") if taken is not None else left
        rivals = open_.select("s", "o", F.explode("e").alias("x")).groupBy("s", "x").agg(F.min("o").alias("m"))
        sure = open_.join(head.filter(F.col("in") == 0).select("s", "o"), ["s", "o"], "left_semi")
        beaten = sure.select("s", "o", F.explode("e").alias("x")).join(rivals, ["s", "x"]).filter("m <> o").select("s", "o")
        won = checkpointed(sure.join(beaten, ["s", "o"], "left_anti"))
        taken = won if taken is None else taken.unionByName(won)
        used = won.select("s", F.explode("e").alias("x")).distinct()
        lost = open_.select("s", "o", F.explode("e").alias("x")).join(used, ["s", "x"], "left_semi").select("s", "o").unionByName(won.select("s", "o")).distinct()
        left = checkpointed(open_.join(lost, ["s", "o"], "left_anti"))
    else:
        raise RuntimeError("the selection did not end")
    taken = left if taken is None else taken
    return taken.select(F.col("s").alias(shard), F.row_number().over(Window.partitionBy("s").orderBy("o")).cast("long").alias("place"), F.col("o.key").alias(key))


def replayed(df: DataFrame, key: str, order: str, elements: str, want: int, most: int, digest: str | None = None) -> DataFrame:
    """(place, key): a sealed set made again by its own walk: of the first ``most`` rows in order those of at least two
    elements that share none with an accepted row, up to ``want``.

    An error if there are fewer, or if the SHA-256 of the keys, one a line, is not the given one."""
    scanned = df.orderBy(order, key).limit(most)
    fit = disjoint_rounds(checkpointed(scanned.filter(F.size(F.array_distinct(elements)) >= 2).select(key, order, elements)), key, order, elements)
    first = checkpointed(df.join(fit, key, "left_semi").select(order, key).orderBy(order, key).limit(want).withColumn("place", F.row_number().over(Window.orderBy(order, key)).cast("long")))  # want rows
    count, own = first.agg(F.count("*"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(key).cast("string").alias("k")))), lambda x: x["k"]), "\n"), 256)).first()
    if count != want:
        raise ValueError(f"sealed_set_has_{count}_rows_of_{want}")
    if digest is not None and own != digest:
        raise ValueError("sealed_set_digest_mismatch")
    return first.select("place", key, F.lit(own).alias("digest"))


def _reachable(groups: dict[tuple[int, ...], int], count: int, need: tuple[int, ...]) -> bool:
    """Whether ``count`` rows of signature groups (signature: rows) reach the need: the least rows for each open need, group by group."""
    if sum(groups.values()) < count:
        return False
    least = {need: 0}
    for signature, rows in groups.items():
        if not any(signature):
            continue
        for open_, used in list(least.items()):
            for n in range(1, min(rows, count - used) + 1):
                open_ = tuple(max(0, a - b) for a, b in zip(open_, signature, strict=True))
                if used + n < least.get(open_, count + 1):
                    least[open_] = used + n
    return least.get((0,) * len(need), count + 1) <= count


def first_feasible(risks: list[dict[str, int]], count: int, need: dict[str, int]) -> list[int] | None:
    """The first ``count`` places, in the order of their places, whose risk counts together reach what is needed; None if none do.

    A place is taken as soon as what lies behind it can still reach the rest.  That depends on how many rows of each
    signature are left, and not on which: no recursion, and after a refusal the signature is passed over until a row
    is taken, as what lies behind only shrinks."""
    names = tuple(need)
    signatures = [tuple(min(r.get(n, 0), need[n]) for n in names) for r in risks]
    behind: dict[tuple[int, ...], int] = {}
    for s in signatures:
        behind[s] = behind.get(s, 0) + 1
    open_, found, refused = tuple(need.values()), [], set()
    if not _reachable(behind, count, open_):
        return None
    for at, s in enumerate(signatures):
        if len(found) == count:
            break
        behind[s] -= 1
        if s in refused:
            continue
        rest = tuple(max(0, a - b) for a, b in zip(open_, s, strict=True))
        if _reachable(behind, count - len(found) - 1, rest):
            found.append(at)
            open_, refused = rest, set()
        else:
            refused.add(s)
    return found


def risk_subsets(df: DataFrame, shard: str, order: str, key: str, labels: str, count: int, need: dict[str, int]) -> DataFrame:
    """(shard, key) of each shard's first feasible set of ``count`` rows; a shard without one gives no rows.

    Of rows with one signature (how often they have each needed label) a first set takes the first ones, so only
    ``count`` of each signature meet in a shard's task, whatever the shard's size."""
    per = F.array(*[F.least(F.size(F.filter(labels, _is(name))), F.lit(n)) for name, n in need.items()])
    rows = df.select(F.col(shard), F.col(order).alias("_o"), F.col(key).alias("_k"), F.coalesce(per, F.array_repeat(F.lit(0), len(need))).alias("_s"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(shard, "_s").orderBy("_o", "_k"))).filter(F.col("_n") <= count)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_o", "_k"])
        found = first_feasible([dict(zip(need, x, strict=True)) for x in part["_s"]], count, need)
        return part.iloc[found or []][[shard, "_k"]].rename(columns={"_k": key})

    kinds = dict(df.dtypes)
    return rows.groupBy(shard).applyInPandas(choose, f"{shard} {kinds[shard]}, {key} {kinds[key]}")


def _is(name: str):
    return lambda x: x == name
