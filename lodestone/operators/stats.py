"""Evaluation statistics: distributions, percentile conventions, paired differences, bootstrap, policy-gradient columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import md5_mod
from ..scratch import written

QUANTILES = (0.5, 0.9, 0.95, 0.99)


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, or null where whole is 0."""
    return F.when(whole != 0, part / whole)


def prefix_sums(df: DataFrame, name: str, value: Column, order: str, *by: str) -> DataFrame:
    """The rows with ``name``, the sum of ``value`` over the rows of the same ``by`` that come before in a total order.

    Rows are dealt out by ranges of (by, order) and stored; a range adds up its own rows, and what stands before a range
    is a sum over ranges, so no key's rows meet in one task.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")).alias(f"_by{n}") for n, c in enumerate(by)]
    names = [f"_by{n}" for n in range(len(by))]
    rows = df.select("*", *keys, value.alias("_v")).repartitionByRange(*names, order)
    rows = written(rows.withColumn("_p", F.spark_partition_id()))
    parts = rows.groupBy(*names, "_p").agg(F.sum("_v").alias("_t"))  # as many as there are ranges and keys
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*names, "_p", before.alias("_before"))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy(*names, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(parts, [*names, "_p"]).withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)


def running_counts(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, column, c, upto, n): each value of a group with its rows, the rows up to it, and the group's rows; nulls are left out."""
    c = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    sums = prefix_sums(c, "upto", F.col("c"), column, *by).withColumn("upto", F.col("upto") + F.col("c"))
    return _beside(sums, sums.groupBy(*by).agg(F.max("upto").alias("n")), by).select(*by, column, "c", "upto", "n")


def _beside(df: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The rows with the columns of their group, null keys being keys too."""
    groups = groups.withColumnsRenamed({x: f"_of_{x}" for x in by})
    same = reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(f"_of_{x}")) for x in by], F.lit(True))
    return df.join(groups, same, "left")


def _at(column: str, place: Column) -> Column:
    """The value at a place (from 0) of the group's sorted rows, over running counts."""
    return F.min(F.when(F.col("upto") > place, F.col(column)))


def _linear(column: str, q: float) -> Column:
    place = (F.col("n") - 1) * q
    part = F.max(place - F.floor(place))
    return _at(column, F.floor(place)) * (1 - part) + _at(column, F.ceil(place)) * part


def distribution(df: DataFrame, column: str, *by: str) -> DataFrame:
    """count, missing, sum, mean, least, greatest and exact linear percentiles of the finite values of each group."""
    rows = df.select(*by, finite(F.col(column).cast("double")).alias("x"))
    found = rows.groupBy(*by).agg(F.count("x").alias("count"), (F.count("*") - F.count("x")).alias("missing"), F.round(F.sum("x"), 4).alias("sum"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    p = running_counts(rows, "x", *by).groupBy(*by).agg(*[F.round(_linear("x", q), 6).alias(f"p{int(q * 100)}") for q in QUANTILES])
    names = ["count", "missing", "sum", "mean", "min", "max", *[f"p{int(q * 100)}" for q in QUANTILES]]
    return _beside(found, p, by).select(*by, *names)


def percentile_conventions(df: DataFrame, column: str, by: str, q: float = 0.95) -> DataFrame:
    """One percentile three ways: linear, by floor index of (n - 1) q, by nearest rank ceil(q n).

    Equal values are counted first and the rest is found by running counts, so a group's rows never meet in one row or task.
    """
    place = (F.col("n") - 1) * q
    g = running_counts(df, column, by).groupBy(by)
    return g.agg(F.round(_linear(column, q), 6).alias("linear"), _at(column, F.floor(place)).alias("floor_index"), _at(column, F.ceil(F.col("n") * q) - 1).alias("nearest_rank"))


def order_statistics(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, p50, p95): the value at (n - 1) div 2 and by nearest rank, over running counts of equal values."""
    return running_counts(df, column, by).groupBy(by).agg(_at(column, F.floor((F.col("n") - 1) / 2)).alias("p50"), _at(column, F.ceil(F.col("n") * 0.95) - 1).alias("p95"))


def compared_probes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs of frozen cases (case_id, task_id, condition, signature, em, f1) by condition; same_cases is false if a case lacks its partner."""
    b = right.select("case_id", F.col("signature").alias("signature_b"), F.col("em").alias("em_b"), F.col("f1").alias("f1_b"), F.col("condition").alias("condition_b"))
    j = left.join(b, "case_id", "full_outer").withColumn("condition", F.coalesce("condition", "condition_b"))
    moved = F.col("signature") != F.col("signature_b")
    return j.groupBy("condition").agg(
        F.count("*").alias("cases"), F.count_distinct("task_id").alias("questions"), F.count_if(moved).alias("changed"), F.count_if(moved & F.startswith("signature", F.lit("search:"))).alias("queries_changed"),
        F.round(F.avg(F.col("em_b") - F.col("em")), 6).alias("em_delta"), F.round(F.avg(F.col("f1_b") - F.col("f1")), 6).alias("f1_delta"), (F.count_if(F.col("signature").isNull() | F.col("signature_b").isNull()) == 0).alias("same_cases"),
    )


def paired(before: DataFrame, after: DataFrame, key: str, *columns: str) -> DataFrame:
    """Full pairing: key, side flags, and before_/after_ columns; a case of one side only keeps nulls."""
    a = before.select(key, F.lit(True).alias("has_before"), *[F.col(c).alias(f"before_{c}") for c in columns])
    b = after.select(key, F.lit(True).alias("has_after"), *[F.col(c).alias(f"after_{c}") for c in columns])
    j = a.join(b, key, "full_outer")
    return j.withColumns({"has_before": F.coalesce("has_before", F.lit(False)), "has_after": F.coalesce("has_after", F.lit(False))})


def paired_report(pairs: DataFrame, metric: str) -> DataFrame:
    """One row: sets, gains, losses, ties and the mean difference over cases that both sides have."""
    both = F.col("has_before") & F.col("has_after")
    d = F.when(both, F.col(f"after_{metric}") - F.col(f"before_{metric}"))
    return pairs.agg(
        F.count_if(both).alias("pairs"), F.count_if(~F.col("has_after")).alias("before_only"), F.count_if(~F.col("has_before")).alias("after_only"), (F.count_if(~both) == 0).alias("identical_case_sets"),
        F.count_if(d > 0).alias("gains"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("unchanged"), F.round(F.avg(d), 6).alias("mean_delta"),
    )


#: How much of 2^16 a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON = tuple(int(2**16 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8))


def resampled(units: DataFrame, draws: int = 200, seed: str = "42", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, r, m): the mean of ``delta`` in each resample r of units (key, delta).

    A unit comes into resample r as often as a Poisson variable of mean 1 says that a part of md5(seed:r div 8:key)
    draws: weights are made where the unit is and summed in place, so no unit is numbered or joined, and only the units
    are dealt out.
    """
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # evenly: each row makes as many as there are draws
    blocks = units.repartition(tasks).select(*by, "key", F.col("delta").cast("double").alias("delta"), F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 8))).alias("block"))
    h = blocks.select(*by, "block", "delta", F.md5(F.concat_ws(":", F.lit(seed), F.col("block").cast("string"), F.col("key").cast("string"))).alias("h"))
    u = h.select(*by, "block", "delta", *[F.conv(F.substring("h", 1 + 4 * j, 4), 16, 10).cast("int").alias(f"u{j}") for j in range(8)])
    w = u.select(*by, "block", "delta", *[sum(((F.col(f"u{j}") >= t).cast("int") for t in POISSON), F.lit(0)).alias(f"w{j}") for j in range(8)])
    sums = w.groupBy(*by, "block").agg(*[x for j in range(8) for x in (F.sum(F.col(f"w{j}") * F.col("delta")).alias(f"s{j}"), F.sum(f"w{j}").alias(f"n{j}"))])
    means = F.inline(F.array(*[F.struct((F.col("block") * 8 + j).alias("r"), (F.col(f"s{j}") / F.nullif(F.col(f"n{j}"), F.lit(0))).alias("m")) for j in range(8)]))
    return sums.select(*by, means).filter((F.col("r") < draws) & F.col("m").isNotNull())  # a resample of no unit has no mean


def bootstrap(units: DataFrame, draws: int = 200, seed: str = "42", confidence: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean, low, high, draws) of the mean of ``delta`` by resampling units (key, delta); interval ends by linear percentiles."""
    tail = (1 - confidence) / 2
    return resampled(units, draws, seed, by).groupBy(*by).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", tail), 6).alias("low"), F.round(F.percentile("m", 1 - tail), 6).alias("high"), F.count("*").alias("draws"))


def interval_conventions(units: DataFrame, draws: int = 200, seed: str = "42", confidence: float = 0.95) -> DataFrame:
    """The interval's ends by four conventions over the sorted resamples, which are as many as ``draws``: before the index, held to the last, the index, linear."""
    tail = (1 - confidence) / 2
    s = resampled(units, draws, seed).agg(F.array_sort(F.collect_list("m")).alias("s"), F.percentile("m", tail).alias("linear_low"), F.percentile("m", 1 - tail).alias("linear_high"))
    n = F.size("s")
    low, high = F.floor(n * tail + 1e-9).cast("int"), F.floor(n * (1 - tail) + 1e-9).cast("int")
    at = lambda i: F.round(F.get("s", i), 6)
    ends = {"before_low": at(low), "before_high": at(high - 1), "held_low": at(low), "held_high": at(F.least(n - 1, high)), "index_low": at(low), "index_high": at(high)}
    return s.select(*[v.alias(k) for k, v in ends.items()], F.round("linear_low", 6).alias("linear_low"), F.round("linear_high", 6).alias("linear_high"))


def clustered_units(df: DataFrame, cluster: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Units of a clustered bootstrap: the mean of each cluster."""
    return df.groupBy(*by, F.col(cluster).alias("key")).agg(F.avg(value).alias("delta"))


def varied_forecast(df: DataFrame, group: str, value: str, sizes: tuple[int, ...] = (2, 4, 8), simulations: int = 100, seed: str = "f") -> DataFrame:
    """Per size: the expected number of groups whose draws of a value vary, and the 5 %, middle and 95 % count of simulations.

    A group is its values with running counts, so a draw is one hash and one search, whatever the group's rows.
    """
    c = df.groupBy(group, value).agg(F.count("*").alias("c"))
    g = c.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "c"))).alias("v"), F.sum("c").alias("n"))
    sums = F.transform("v", lambda x, i: F.aggregate(F.slice("v", 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y["c"]))
    g = g.select(group, "n", "v", sums.alias("sums"))
    trials = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim"), F.lit(0).alias("_")).select("*", F.explode(F.array(*[F.lit(x) for x in sizes])).alias("size"))
    draw = lambda i: md5_mod(F.concat_ws(":", F.lit(seed), F.col(group).cast("string"), F.col("sim").cast("string"), F.col("size").cast("string"), i.cast("string")), F.col("n"))
    picked = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.size(F.filter("sums", lambda s: s <= draw(i))))
    varied = trials.withColumn("varied", (F.size(F.array_distinct(picked)) > 1).cast("long"))
    counts = varied.groupBy("size", "sim").agg(F.sum("varied").alias("k")).groupBy("size").agg(F.array_sort(F.collect_list("k")).alias("k"))
    same = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x["c"] / F.col("n"), F.col("size").cast("double")))
    expected = g.select("*", F.explode(F.array(*[F.lit(x) for x in sizes])).alias("size")).groupBy("size").agg(F.round(F.sum(1 - same), 6).alias("expected"))
    at = lambda i: F.get("k", F.lit(i))
    return counts.join(expected, "size").select(F.col("size").cast("long").alias("size"), "expected", at(int(0.05 * simulations)).alias("p05"), at(simulations // 2).alias("median"), at(int(0.95 * simulations)).alias("p95"))


def efficiency(df: DataFrame, wall: str, tokens_in: str, tokens_out: str, *by: str) -> DataFrame:
    """Questions a minute and tokens a second of each group; null where no time passed."""
    t = F.sum(wall)
    return df.groupBy(*by).agg(F.count("*").alias("questions"), F.round(rate(60 * F.count("*"), t), 6).alias("per_minute"), F.round(rate(F.sum(tokens_in), t), 6).alias("in_per_second"), F.round(rate(F.sum(tokens_out), t), 6).alias("out_per_second"))


def clustered(df: DataFrame, cluster: str, *values: str) -> DataFrame:
    """Mean within each cluster, then over clusters."""
    return df.groupBy(cluster).agg(*[F.avg(v).alias(v) for v in values]).agg(F.count("*").alias("clusters"), *[F.round(F.avg(v), 6).alias(v) for v in values])


def entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """Entropy in bits of the values of each group."""
    c = df.groupBy(group, value).agg(F.count("*").alias("c"))
    t = c.groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return t.select(group, "n", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


def pearson(x: str, y: str) -> Column:
    """Correlation, or null where a side does not vary."""
    return F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.round(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), 6))


def variance_probability(df: DataFrame, group: str, value: str, sizes: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """Chance that so many draws of a group's values are not all equal."""
    c = df.groupBy(group, value).agg(F.count("*").alias("c"))
    n = c.groupBy(group).agg(F.sum("c").alias("n"))
    j = c.join(n, group)
    return j.groupBy(group).agg(*[F.round(1 - F.sum(F.pow(F.col("c") / F.col("n"), F.lit(g))), 6).alias(f"p_{g}") for g in sizes])


def clipped_loss(current: Column, old: Column, reference: Column, advantage: Column, clip: float = 0.2, kl: float = 0.02) -> dict[str, Column]:
    """Per trajectory, over arrays of token log-probabilities: clipped policy loss, reference KL, share of clipped ratios.

    Ratios are exp of the difference held to +-30; the KL term is exp(-d) + d - 1 with d = current - reference.
    """
    hold = lambda x: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))
    ratio = F.zip_with(current, old, lambda c, o: F.exp(hold(c - o)))
    policy = F.transform(ratio, lambda r: -F.least(r * advantage, F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), r)) * advantage))
    diff = F.zip_with(current, reference, lambda c, r: hold(c - r))
    kls = F.transform(diff, lambda d: F.exp(-d) + d - 1)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return {"loss": mean(policy) + kl * mean(kls), "kl": mean(kls), "clip_fraction": F.size(F.filter(ratio, lambda r: (r < 1 - clip) | (r > 1 + clip))) / F.size(ratio), "ratio_max": F.array_max(ratio)}
