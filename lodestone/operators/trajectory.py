"""Trajectories: group-relative advantages, repeats, over-search, behaviour, rewards, movements, diversity.

Windows are partitioned by rollout or group and ordered by step; each is one shuffle on that key, and expressions over
the same window share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 1e-8


def up_to(last: int):
    """The frame from a rollout's first step up to this one (0) or the one before (-1)."""
    return Window.partitionBy("rollout_id").orderBy("step").rowsBetween(Window.unboundedPreceding, last)


def group_stats(rollouts: DataFrame) -> DataFrame:
    """Per group: count, mean, population deviation (0 for one rollout), zero_variance, success rate."""
    std = F.coalesce(F.stddev_pop("reward"), F.lit(0.0))
    return rollouts.groupBy("group_id").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"), std.alias("std"), (std < EPSILON).alias("zero_variance"), F.avg(F.col("correct").cast("int")).alias("success_rate"))


def advantages(rollouts: DataFrame, eligible: Column | None = None) -> DataFrame:
    """(reward - mean) / (std + 1e-8) within the group; 0 where the group does not vary or the rollout is not eligible."""
    w = Window.partitionBy("group_id")
    mean, std = F.avg("reward").over(w), F.coalesce(F.stddev_pop("reward").over(w), F.lit(0.0))
    ok = (std >= EPSILON) & (F.lit(True) if eligible is None else eligible)
    return rollouts.withColumn("advantage", F.when(ok, (F.col("reward") - mean) / (std + EPSILON)).otherwise(0.0))


def signal_class(stats: DataFrame) -> DataFrame:
    """Six exclusive classes of a group's signal."""
    c = (
        F.when(F.col("n") < 2, "single").when(F.col("zero_variance") & (F.col("success_rate") == 1), "all_correct").when(F.col("zero_variance") & (F.col("success_rate") == 0), "all_wrong_equal")
        .when(F.col("zero_variance"), "equal_mixed").when(F.col("success_rate").isin(0.0, 1.0), "cost_only").otherwise("mixed_outcome")
    )
    return stats.withColumn("signal", c)


def repeats(steps: DataFrame) -> DataFrame:
    """Each search step: whether its query came before in the rollout, and the distinct queries so far."""
    s = steps.filter("action = 'search'")
    again = F.row_number().over(Window.partitionBy("rollout_id", "query").orderBy("step")) > 1
    return s.withColumn("repeated", again).withColumn("queries_so_far", F.size(F.collect_set("query").over(up_to(0))).cast("long"))


def over_search(steps: DataFrame, wanted: Column) -> DataFrame:
    """Search steps taken after all wanted documents had been found (none wanted: never)."""
    had = F.collect_set("found").over(up_to(-1))
    complete = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, had)) == 0)
    return steps.withColumn("evidence_before", complete).withColumn("over_search", complete & (F.col("action") == "search"))


def coverage(found: Column, wanted: Column) -> Column:
    hit = F.size(F.array_intersect(wanted, found))
    return F.when(F.size(wanted) == 0, None).when(hit == 0, "none").when(hit < F.size(wanted), "partial").otherwise("complete")


def reward_parts(r: DataFrame, exact: float = 1.0, repeated: float = -0.5, over: float = -0.2, stop: float = 0.3, incomplete: float = -0.15, empty: float = -0.1) -> DataFrame:
    """The reward components of a rollout row (correct, reason, searches, answered, wanted, found, over_steps, empty_searches) and their sum."""
    support = F.size(F.array_intersect("wanted", "found")) / F.size("wanted")
    complete = (F.size("wanted") > 0) & (F.size(F.array_except("wanted", "found")) == 0)
    give = lambda condition, value: F.when(condition, F.lit(value)).otherwise(0.0)
    parts = {
        "exact_match": give(F.col("correct"), exact),
        "support_coverage": F.when(F.size("wanted") > 0, 0.2 * support).otherwise(0.0),
        "search_cost": -0.03 * F.col("searches"),
        "repeated_search": give(F.col("reason") == "repeated_action", repeated),
        "invalid_action": give(F.col("reason") == "invalid_action", -0.5),
        "max_steps": give(F.col("reason") == "max_steps", -0.25),
        "ungrounded_answer": give((F.col("searches") == 0) & ~F.col("correct"), -0.1),
        "over_search": over * F.col("over_steps"),
        "evidence_stop": give(F.col("correct") & complete, stop),
        "incomplete_evidence": give((F.col("searches") > 0) & F.col("answered") & ~complete, incomplete),
        "empty_evidence": give((F.col("searches") > 0) & F.col("answered") & (F.col("empty_searches") == F.col("searches")), empty),
    }
    r = r.select("*", *[v.alias(k) for k, v in parts.items()])
    total = sum((F.col(k) for k in list(parts)[1:]), F.col("exact_match"))
    return r.withColumn("total", total)


def movement(left: str, right: str) -> Column:
    """Outcome movement of a paired case: legal is a boolean ``<side>_legal``, right ``<side>_correct``."""
    a, b, x, y = F.col(f"{left}_legal"), F.col(f"{right}_legal"), F.col(f"{left}_correct"), F.col(f"{right}_correct")
    return (
        F.when(~a & b, F.when(y, "invalid_to_legal_correct").otherwise("invalid_to_legal_wrong"))
        .when(a & b, F.when(~x & y, "legal_wrong_to_correct").when(x & ~y, "legal_correct_to_wrong").when(x, "legal_stable_correct").otherwise("legal_stable_wrong"))
        .otherwise("other")
    )


def error_class() -> Column:
    """The first matching class of a wrong answer (columns correct, reason, f1, searches, gold_seen, complete, some)."""
    return (
        F.when(F.col("correct"), "correct").when(F.col("reason") != "answer", "protocol_or_termination").when(F.col("f1") >= 0.8, "answer_variant_candidate").when(F.col("searches") == 0, "ungrounded_direct_answer")
        .when(F.col("gold_seen"), "entity_or_relation_selection_error").when(F.col("complete"), "support_complete_but_inference_error").when(F.col("some"), "partial_support_then_answer").otherwise("retrieval_failure_or_wrong_query")
    )


def signatures(steps: DataFrame) -> DataFrame:
    """Per rollout: its actions and its queries in step order, as text."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "action", "query")))
    return steps.groupBy("group_id", "rollout_id").agg(ordered.alias("o")).select("group_id", "rollout_id", F.array_join(F.transform("o", lambda x: x["action"]), ">").alias("actions"), F.array_join(F.transform(F.filter("o", lambda x: x["action"] == "search"), lambda x: x["query"].cast("string")), ",").alias("queries"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in a total order: ``insert or replace`` over an append-only table."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def zero_variance_causes(rollouts: DataFrame, fewest: int = 2, most_invalid: float = 0.1) -> DataFrame:
    """(cause, groups, groups_flat, median_actions, invalid_rate, decision): why groups' rewards don't vary, and what follows.

    rollouts: group_id, reward, correct, invalid, signature (of its actions), coverage.  The decision is the same in all rows: larger groups, if
    the median flat group has at most ``fewest`` different signatures and at most ``most_invalid`` of all rollouts are invalid.  A group is
    one row of partial sums; the median is taken over counts of numbers of signatures.
    """
    g = rollouts.groupBy("group_id").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("right"), F.count_if("invalid").alias("bad"), F.count_distinct("signature").alias("kinds"),
        (F.min("coverage").eqNullSafe(F.max("coverage"))).alias("same_coverage"), (F.min("reward") == F.max("reward")).alias("flat"),
    )
    cause = (
        F.when(F.col("kinds") <= fewest, "low_action_diversity").when((F.col("right") == 0) & F.col("same_coverage"), "diverse_actions_all_wrong_same_support_reward")
        .when(F.col("right") == F.col("n"), "diverse_actions_all_correct").otherwise("diverse_actions_flat_composite_reward")
    )
    counts = g.groupBy("flat", F.when(F.col("flat"), cause).alias("cause"), "kinds").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = Window.partitionBy(F.lit(1))  # over counts by cause and number of signatures
    rows = counts.withColumn("invalid_rate", F.sum("bad").over(whole) / F.sum("n").over(whole)).filter("flat")
    total, upto = F.sum("c").over(whole), F.sum("c").over(whole.orderBy("kinds").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_t", total).withColumn("_u", upto)
    at = lambda place: F.min(F.when(F.col("_u") > place, F.col("kinds"))).over(whole)
    rows = rows.withColumn("median_actions", (at(F.floor((F.col("_t") - 1) / 2)) + at(F.ceil((F.col("_t") - 1) / 2))) / 2)
    decision = F.when((F.col("median_actions") <= fewest) & (F.col("invalid_rate") <= most_invalid), "group_size_8").otherwise("no_sampling_change")
    return rows.withColumn("decision", decision).groupBy("cause").agg(F.sum("c").alias("groups"), F.max("_t").alias("groups_flat"), F.max("median_actions").alias("median_actions"), F.round(F.max("invalid_rate"), 6).alias("invalid_rate"), F.max("decision").alias("decision"))


#: The gate's least tasks that the change touches, groups it changes, and groups that vary in each run; what it gives back for a tag.
LEAST_TASKS, LEAST_CHANGED, LEAST_VARIED, GIVEN_BACK = 3, 6, 15, 0.2


def over_search_gate(rollouts: DataFrame, bonus: float = GIVEN_BACK) -> DataFrame:
    """(run, groups_changed, groups_varied, inversions, tasks, tasks_correct, passed) of each run, and of all (run null), if each tag's cost is given back.

    rollouts: run, group_id, task_id, reward, correct, tags.  Centred advantages change where the tags of a group differ.  Inversions are pairs of
    a correct rollout below a wrong one of its group, counted by prefix sums over equal rewards, so no pairs are made.
    """
    from .stats import prefix_sums

    new = F.round(F.col("reward") + bonus * F.col("tags"), 9)
    r = rollouts.withColumn("new", new)
    own = r.groupBy("run", "group_id").agg((F.min("tags") != F.max("tags")).alias("changed"), (F.min("new") != F.max("new")).alias("varied"))
    levels = r.groupBy("run", "group_id", "new").agg(F.count_if("correct").alias("right"), F.count_if(~F.col("correct")).alias("wrong"))
    below = prefix_sums(levels, "below", F.col("wrong"), "new", "run", "group_id")
    wrong = levels.groupBy("run", "group_id").agg(F.sum("wrong").alias("all_wrong"))
    inversions = below.join(wrong, ["run", "group_id"]).groupBy("run", "group_id").agg(F.sum(F.col("right") * (F.col("all_wrong") - F.col("below") - F.col("wrong"))).alias("inversions"))
    groups = own.join(inversions, ["run", "group_id"]).groupBy("run").agg(F.count_if("changed").alias("groups_changed"), F.count_if("varied").alias("groups_varied"), F.sum("inversions").alias("inversions"))
    touched = r.filter("tags > 0").groupBy("run", "task_id").agg(F.max(F.col("correct").cast("int")).alias("right"))
    tasks = touched.groupBy("run").agg(F.count("*").alias("tasks"), F.sum("right").alias("tasks_correct"))
    runs = groups.join(tasks, "run", "left").fillna(0, ["tasks", "tasks_correct"])
    each = runs.withColumn("passed", F.col("groups_varied") >= LEAST_VARIED)
    every = touched.groupBy("task_id").agg(F.max("right").alias("right")).agg(F.lit(None).cast(r.schema["run"].dataType).alias("run"), F.count("*").alias("tasks"), F.coalesce(F.sum("right"), F.lit(0)).alias("tasks_correct"))
    sums = each.agg(F.lit(None).cast(r.schema["run"].dataType).alias("run"), F.sum("groups_changed").alias("groups_changed"), F.sum("groups_varied").alias("groups_varied"), F.sum("inversions").alias("inversions"), F.min("passed").alias("passed"))
    total = sums.join(every, sums["run"].eqNullSafe(every["run"])).drop(every["run"])
    gate = F.col("passed") & (F.col("tasks") >= LEAST_TASKS) & (F.col("tasks_correct") >= LEAST_TASKS) & (F.col("groups_changed") >= LEAST_CHANGED) & (F.col("inversions") == 0)
    return each.unionByName(total.withColumn("passed", gate))
