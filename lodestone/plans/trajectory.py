"""Queries of the trajectory family, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import trajectory as J
from ..scratch import written
from ..session import table
from ..tables import ROLLOUTS, STEPS, rollouts, steps



def wanted():
    """The documents that every task asks for."""
    return F.array(F.lit(1).cast("long"), F.lit(4).cast("long"))


def group_advantage(spark, sf):
    return J.advantages(rollouts(spark, sf), F.col("reason") != "invalid_action").select("group_id", "rollout_id", F.round("reward", 6).alias("reward"), F.round("advantage", 6).alias("advantage"))


def zero_variance_groups(spark, sf):
    r = rollouts(spark, sf).withColumn("group_id", F.concat_ws("-", F.col("group_id").cast("string"), F.expr("substring_index(rollout_id, '-', -1)").cast("int").cast("string")))
    return J.signal_class(J.group_stats(r)).groupBy("signal").agg(F.count("*").alias("groups"), F.round(F.avg("std"), 6).alias("mean_std"))


def _monthly(spark, sf):
    """Rollouts with their group (a user's days of one number in the month), actions in order, wanted documents found, and over-search tags."""
    tagged = J.over_search(steps(spark, sf), F.array(F.lit(1), F.lit(4)))
    own = tagged.groupBy("rollout_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))), lambda x: x["action"]), ">").alias("signature"), F.count_distinct(F.when(F.col("found").isin(1, 4), F.col("found"))).alias("coverage"), F.count_if("over_search").alias("tags"))
    day = F.expr("substring_index(rollout_id, '-', -1)").cast("int").cast("string")
    return rollouts(spark, sf).join(own, "rollout_id").withColumn("task_id", F.col("group_id")).withColumn("group_id", F.concat_ws("-", F.col("group_id").cast("string"), day))


def zero_variance_causes(spark, sf):
    """Groups (a user's rollouts of equally many searches) whose rewards don't vary, by cause, and the decision on the group's size."""
    r = _monthly(spark, sf).withColumn("group_id", F.concat_ws("-", F.col("task_id").cast("string"), F.col("searches").cast("string")))
    return J.zero_variance_causes(r.select("group_id", F.round("reward", 9).alias("reward"), "correct", (F.col("reason") == "invalid_action").alias("invalid"), "signature", "coverage"))


def over_search_gate(spark, sf):
    """What giving back the cost of searches behind complete evidence would change, in three runs."""
    return J.over_search_gate(_monthly(spark, sf).withColumn("run", F.col("task_id") % 3))


def repeat_actions(spark, sf):
    return J.repeats(steps(spark, sf)).select("rollout_id", "step", "query", "repeated", "queries_so_far")


def oversearch_tags(spark, sf):
    return J.over_search(steps(spark, sf), wanted()).groupBy("group_id").agg(F.count_if("evidence_before").alias("evidence_steps"), F.count_if("over_search").alias("over_search_steps"))


def termination_grouping_sets(spark, sf):
    rollouts(spark, sf).withColumn("difficulty", F.when(F.col("n_steps") <= 1, "easy").when(F.col("n_steps") <= 3, "medium").otherwise("hard")).createOrReplaceTempView("lodestone_rollouts")
    return spark.sql("""SELECT reason, difficulty, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(avg(searches), 6) AS mean_searches
FROM lodestone_rollouts GROUP BY GROUPING SETS ((reason), (difficulty), ())""")


def _facts(spark, sf):
    """Rollouts with what the reward components need."""
    s = J.over_search(steps(spark, sf), wanted())
    per = s.groupBy("rollout_id").agg(
        F.collect_set("found").alias("found"), F.count_if("over_search").alias("over_steps"), F.count_if((F.col("action") == "search") & F.col("found").isNull()).alias("empty_searches"),
    )
    return rollouts(spark, sf).join(per, "rollout_id").withColumn("wanted", wanted()).withColumn("answered", F.col("reason") == "answer")


PARTS = ["exact_match", "support_coverage", "search_cost", "repeated_search", "invalid_action", "max_steps", "ungrounded_answer", "over_search", "evidence_stop", "incomplete_evidence", "empty_evidence"]


def reward_components(spark, sf):
    return J.reward_parts(_facts(spark, sf)).select("rollout_id", *[F.round(c, 6).alias(c) for c in PARTS], F.round("total", 6).alias("total"))


def reward_component_counts(spark, sf):
    """How many rollouts each component touches."""
    r = J.reward_parts(_facts(spark, sf))
    return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in PARTS])).alias("p")).groupBy("p.component").agg(F.count_if(F.round("p.value", 9) != 0).alias("nonzero"), F.round(F.sum("p.value"), 4).alias("total"))


def reward_counterfactual(spark, sf):
    """Two reward versions over the same rollouts: order inversions within groups between wrong and right answers, and margins."""
    # both totals are columns of one row, stored once for the three sums below
    old = J.reward_parts(_facts(spark, sf)).withColumn("old", F.round("total", 6)).drop(*PARTS, "total")
    both = written(J.reward_parts(old, over=0.0).select("group_id", "rollout_id", "correct", "old", F.round("total", 6).alias("new")))

    def inversions(total: str, name: str):
        """Pairs of a right answer and a wrong one above it, by running counts of equal totals: no pair is made."""
        c = both.groupBy("group_id", total).agg(F.count_if("correct").alias("good"), F.count_if(~F.col("correct")).alias("bad"))
        above = F.coalesce(F.sum("bad").over(Window.partitionBy("group_id").orderBy(F.desc(total)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return c.withColumn("above", above).groupBy("group_id").agg(F.sum(F.col("good") * F.col("above")).alias(name))

    g = both.groupBy("group_id").agg((F.count_if("correct") * F.count_if(~F.col("correct"))).alias("pairs"), F.round(F.min(F.when(F.col("correct"), F.col("new"))) - F.max(F.when(~F.col("correct"), F.col("new"))), 6).alias("least_margin")).filter("pairs > 0")
    return g.join(inversions("old", "old_inversions"), "group_id").join(inversions("new", "new_inversions"), "group_id")


def coverage_buckets(spark, sf):
    f = _facts(spark, sf).withColumn("bucket", J.coverage(F.col("found"), F.col("wanted")))
    share = lambda b, x: F.round(F.avg(F.when(F.col("bucket") == b, x.cast("int"))), 6)
    return f.groupBy("group_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("bucket") == b).alias(b) for b in ("none", "partial", "complete")], share("complete", F.col("answered")).alias("complete_answer_rate"), share("complete", F.col("correct")).alias("complete_correct_rate"), share("partial", F.col("searches") > 1).alias("partial_continue_rate"))


def _halves(spark, sf):
    """Each user's rollouts of the same day number in two halves of the month: a paired before and after."""
    day = F.substring("rollout_id", -2, 2).cast("int")
    r = rollouts(spark, sf).withColumn("case_id", F.concat_ws(":", F.col("group_id").cast("string"), (day % 15).cast("string"))).withColumn("half", (day > 15).cast("int"))
    r = J.latest(r, ["case_id", "half"], F.desc("rollout_id"))
    side = lambda h, n: r.filter(F.col("half") == h).select("case_id", (F.col("reason") == "answer").alias(f"{n}_legal"), F.col("correct").alias(f"{n}_correct"), F.col("reward").alias(f"{n}_reward"), F.col("searches").alias(f"{n}_searches"))
    return side(0, "base"), side(1, "cand")


def movement_matrix(spark, sf):
    base, cand = _halves(spark, sf)
    return base.join(cand, "case_id").groupBy(J.movement("base", "cand").alias("movement")).agg(F.count("*").alias("n"))


def error_taxonomy(spark, sf):
    f = _facts(spark, sf)
    seen, complete = F.array_contains("found", F.lit(6).cast("long")), F.size(F.array_except("wanted", "found")) == 0
    f = f.select("correct", "reason", "searches", ((F.col("cents") % 100) / 100.0).alias("f1"), seen.alias("gold_seen"), complete.alias("complete"), (F.size(F.array_intersect("wanted", "found")) > 0).alias("some"))
    return f.groupBy(J.error_class().alias("category")).agg(F.count("*").alias("n"))


def action_signatures(spark, sf):
    return J.signatures(steps(spark, sf)).groupBy("group_id").agg(F.count("*").alias("rollouts"), F.count_distinct("actions").alias("action_sequences"), F.count_distinct("queries").alias("query_sequences"), F.min("actions").alias("first_sequence"))


def trajectory_export(spark, sf):
    """Rollout with its group's statistics and its transitions nested in step order, as one JSON text."""
    s = steps(spark, sf).groupBy("rollout_id").agg(F.array_sort(F.collect_list(F.struct("step", "action", "query"))).alias("transitions"))
    g = J.group_stats(rollouts(spark, sf)).select("group_id", "n")
    return rollouts(spark, sf).join(g, "group_id", "left").join(s, "rollout_id", "left").select("rollout_id", "group_id", "n", F.size("transitions").cast("long").alias("steps"), F.to_json(F.transform("transitions", lambda x: F.concat_ws("/", x["step"].cast("string"), x["action"], x["query"].cast("string")))).alias("transitions"))


def last_record_per_key(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return J.latest(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


def update_elapsed_lag(spark, sf):
    """Deltas of a counter between snapshots, restarting where it falls, and a clipped delta."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("value").over(w)
    return table(spark, sf, "events").select("user_id", "event_id", F.round(F.when(before.isNull() | (F.col("value") < before), F.col("value")).otherwise(F.col("value") - before), 4).alias("elapsed"), F.round(F.greatest(F.lit(0.0), F.col("value") - before), 4).alias("clipped"))


def diagnosis_rows(spark, sf):
    """One diagnosis row for each rollout: reason, coverage, first step with evidence, repeats."""
    s = steps(spark, sf)
    rep = J.repeats(s).groupBy("rollout_id").agg(F.count_if("repeated").alias("repeats"))
    first = s.filter(F.col("found").isin(1, 4)).groupBy("rollout_id").agg(F.min("step").alias("first_evidence"))
    f = _facts(spark, sf).select("rollout_id", "reason", J.coverage(F.col("found"), F.col("wanted")).alias("coverage"))
    return f.join(first, "rollout_id", "left").join(rep, "rollout_id", "left").select("rollout_id", "reason", "coverage", "first_evidence", F.coalesce("repeats", F.lit(0)).cast("long").alias("repeats"))


QUERIES = {f.__name__: f for f in (group_advantage, zero_variance_groups, zero_variance_causes, over_search_gate, repeat_actions, oversearch_tags, termination_grouping_sets, reward_components, reward_component_counts, reward_counterfactual, coverage_buckets, movement_matrix, error_taxonomy, action_signatures, trajectory_export, last_record_per_key, update_elapsed_lag, diagnosis_rows)}

_BASE = f"WITH {STEPS}, {ROLLOUTS}"
_OVER = """ov AS (SELECT *, coalesce(had_1 AND had_4, false) AS evidence_before, coalesce(had_1 AND had_4, false) AND action = 'search' AS over_search FROM
  (SELECT *, bool_or(found = 1) OVER b AS had_1, bool_or(found = 4) OVER b AS had_4 FROM steps WINDOW b AS (PARTITION BY rollout_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
_FACTS = f"""{_OVER}, facts AS (SELECT r.*, hits, found_6, over_steps, empty_searches, reason = 'answer' AS answered, CASE hits WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'complete' END AS bucket FROM rollouts r JOIN (
  SELECT rollout_id, count(DISTINCT found) FILTER (WHERE found IN (1, 4)) AS hits, coalesce(bool_or(found = 6), false) AS found_6, count(*) FILTER (WHERE over_search) AS over_steps, count(*) FILTER (WHERE action = 'search' AND found IS NULL) AS empty_searches FROM ov GROUP BY rollout_id) USING (rollout_id))"""


def _parts(over: str = "-0.2") -> str:
    return f"""SELECT *, exact_match + support_coverage + search_cost + repeated_search + invalid_action + max_steps + ungrounded_answer + over_search + evidence_stop + incomplete_evidence + empty_evidence AS total FROM (
  SELECT rollout_id, group_id, correct, CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END AS exact_match, 0.1::DOUBLE * hits AS support_coverage, -0.03::DOUBLE * searches AS search_cost,
  CASE WHEN reason = 'repeated_action' THEN -0.5::DOUBLE ELSE 0 END AS repeated_search, CASE WHEN reason = 'invalid_action' THEN -0.5::DOUBLE ELSE 0 END AS invalid_action, CASE WHEN reason = 'max_steps' THEN -0.25::DOUBLE ELSE 0 END AS max_steps,
  CASE WHEN searches = 0 AND NOT correct THEN -0.1::DOUBLE ELSE 0 END AS ungrounded_answer, {over}::DOUBLE * over_steps AS over_search, CASE WHEN correct AND hits = 2 THEN 0.3::DOUBLE ELSE 0 END AS evidence_stop,
  CASE WHEN searches > 0 AND answered AND hits < 2 THEN -0.15::DOUBLE ELSE 0 END AS incomplete_evidence, CASE WHEN searches > 0 AND answered AND empty_searches = searches THEN -0.1::DOUBLE ELSE 0 END AS empty_evidence FROM facts)"""


_ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in PARTS)
_HALVES = """h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, half ORDER BY rollout_id DESC) AS rn FROM (SELECT *, group_id::VARCHAR || ':' || (day % 15)::VARCHAR AS case_id, CASE WHEN day > 15 THEN 1 ELSE 0 END AS half FROM (SELECT *, right(rollout_id, 2)::INTEGER AS day FROM rollouts))) WHERE rn = 1),
base AS (SELECT case_id, reason = 'answer' AS legal, correct, reward, searches FROM h WHERE half = 0), cand AS (SELECT case_id, reason = 'answer' AS legal, correct, reward, searches FROM h WHERE half = 1)"""
_MONTHLY = f"""{_OVER}, mo AS (SELECT rollout_id, string_agg(action, '>' ORDER BY step) AS signature, count(DISTINCT found) FILTER (WHERE found IN (1, 4)) AS coverage, count(*) FILTER (WHERE over_search) AS tags FROM ov GROUP BY rollout_id),
m AS (SELECT r.*, signature, coverage, tags, r.group_id || '-' || split_part(r.rollout_id, '-', 3)::INTEGER AS gid FROM rollouts r JOIN mo USING (rollout_id))"""
ORACLES = {
    "group_advantage": f"""{_BASE}, g AS (SELECT *, avg(reward) OVER w AS m, coalesce(stddev_pop(reward) OVER w, 0) AS s FROM rollouts WINDOW w AS (PARTITION BY group_id))
SELECT group_id, rollout_id, round(reward, 6) AS reward, round(CASE WHEN s >= 1e-8 AND reason <> 'invalid_action' THEN (reward - m) / (s + 1e-8) ELSE 0 END, 6) AS advantage FROM g""",
    "zero_variance_groups": f"""{_BASE}, g AS (SELECT group_id || '-' || split_part(rollout_id, '-', 3)::INTEGER AS gid, count(*) AS n, coalesce(stddev_pop(reward), 0) AS s, avg(correct::INT) AS a FROM rollouts GROUP BY gid)
SELECT CASE WHEN n < 2 THEN 'single' WHEN s < 1e-8 AND a = 1 THEN 'all_correct' WHEN s < 1e-8 AND a = 0 THEN 'all_wrong_equal' WHEN s < 1e-8 THEN 'equal_mixed' WHEN a IN (0, 1) THEN 'cost_only' ELSE 'mixed_outcome' END AS signal, count(*) AS groups, round(avg(s), 6) AS mean_std FROM g GROUP BY 1""",
    "zero_variance_causes": f"""{_BASE}, {_MONTHLY}, g AS (SELECT gid, count(*) AS n, count(*) FILTER (WHERE correct) AS ok, count(*) FILTER (WHERE reason = 'invalid_action') AS bad, count(DISTINCT signature) AS kinds, count(DISTINCT coverage) AS cov, min(round(reward, 9)) = max(round(reward, 9)) AS flat FROM (SELECT * EXCLUDE (gid), group_id || '-' || searches AS gid FROM m) GROUP BY gid),
t AS (SELECT count(*) AS groups_flat, median(kinds) AS median_actions FROM g WHERE flat), i AS (SELECT sum(bad) / sum(n) AS invalid_rate FROM g)
SELECT CASE WHEN kinds <= 2 THEN 'low_action_diversity' WHEN ok = 0 AND cov = 1 THEN 'diverse_actions_all_wrong_same_support_reward' WHEN ok = n THEN 'diverse_actions_all_correct' ELSE 'diverse_actions_flat_composite_reward' END AS cause, count(*) AS groups, min(groups_flat) AS groups_flat, min(median_actions)::DOUBLE AS median_actions,
round(min(invalid_rate), 6) AS invalid_rate, CASE WHEN min(median_actions) <= 2 AND min(invalid_rate) <= 0.1 THEN 'group_size_8' ELSE 'no_sampling_change' END AS decision FROM g, t, i WHERE flat GROUP BY 1""",
    "over_search_gate": f"""{_BASE}, {_MONTHLY}, n AS (SELECT *, group_id % 3 AS run, round(reward + 0.2::DOUBLE * tags, 9) AS new FROM m),
g AS (SELECT run, gid, min(tags) <> max(tags) AS changed, min(new) <> max(new) AS varied FROM n GROUP BY run, gid), v AS (SELECT a.run, count(*) AS inversions FROM n a JOIN n b ON a.gid = b.gid AND a.correct AND NOT b.correct AND a.new < b.new GROUP BY a.run),
k AS (SELECT run, count(DISTINCT group_id) AS tasks, count(DISTINCT group_id) FILTER (WHERE correct) AS tasks_correct FROM n WHERE tags > 0 GROUP BY run),
e AS (SELECT run, groups_changed, groups_varied, coalesce(inversions, 0) AS inversions, coalesce(tasks, 0) AS tasks, coalesce(tasks_correct, 0) AS tasks_correct FROM (SELECT run, count(*) FILTER (WHERE changed) AS groups_changed, count(*) FILTER (WHERE varied) AS groups_varied FROM g GROUP BY run) LEFT JOIN v USING (run) LEFT JOIN k USING (run)),
a AS (SELECT count(DISTINCT group_id) AS tasks, count(DISTINCT group_id) FILTER (WHERE correct) AS tasks_correct FROM n WHERE tags > 0)
SELECT run, groups_changed, groups_varied, inversions, tasks, tasks_correct, groups_varied >= 15 AS passed FROM e UNION ALL
SELECT NULL, CAST(sum(groups_changed) AS BIGINT), CAST(sum(groups_varied) AS BIGINT), CAST(sum(inversions) AS BIGINT), min(a.tasks), min(a.tasks_correct), min(groups_varied) >= 15 AND min(a.tasks) >= 3 AND min(a.tasks_correct) >= 3 AND sum(groups_changed) >= 6 AND sum(inversions) = 0 FROM e, a""",
    "repeat_actions": f"""WITH {STEPS}, s AS (SELECT *, row_number() OVER (PARTITION BY rollout_id, query ORDER BY step) > 1 AS repeated FROM steps WHERE action = 'search')
SELECT rollout_id, step, query, repeated, CAST(sum(CASE WHEN repeated THEN 0 ELSE 1 END) OVER (PARTITION BY rollout_id ORDER BY step) AS BIGINT) AS queries_so_far FROM s""",
    "oversearch_tags": f"WITH {STEPS}, {_OVER} SELECT group_id, count(*) FILTER (WHERE evidence_before) AS evidence_steps, count(*) FILTER (WHERE over_search) AS over_search_steps FROM ov GROUP BY group_id",
    "termination_grouping_sets": f"""{_BASE}, r AS (SELECT *, CASE WHEN n_steps <= 1 THEN 'easy' WHEN n_steps <= 3 THEN 'medium' ELSE 'hard' END AS difficulty FROM rollouts)
SELECT reason, difficulty, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(searches), 6) AS mean_searches FROM r GROUP BY GROUPING SETS ((reason), (difficulty), ())""",
    "reward_components": f"{_BASE}, {_FACTS}, p AS ({_parts()}) SELECT rollout_id, {_ROUNDED}, round(total, 6) + 0.0 AS total FROM p",
    "reward_component_counts": f"{_BASE}, {_FACTS}, p AS ({_parts()}) " + " UNION ALL ".join(f"SELECT '{c}' AS component, count(*) FILTER (WHERE round({c}, 9) <> 0) AS nonzero, round(sum({c}), 4) AS total FROM p" for c in PARTS),
    "reward_counterfactual": f"""{_BASE}, {_FACTS}, a AS ({_parts()}), b AS ({_parts("0.0")}), j AS (SELECT a.group_id, a.correct, round(a.total, 6) AS old, round(b.total, 6) AS new FROM a JOIN b USING (rollout_id))
SELECT x.group_id, count(*) AS pairs, count(*) FILTER (WHERE x.old < y.old) AS old_inversions, count(*) FILTER (WHERE x.new < y.new) AS new_inversions, round(min(x.new - y.new), 6) AS least_margin FROM j x JOIN j y ON x.group_id = y.group_id AND x.correct AND NOT y.correct GROUP BY x.group_id""",
    "coverage_buckets": f"""{_BASE}, {_FACTS} SELECT group_id, count(*) AS n, count(*) FILTER (WHERE bucket = 'none') AS "none", count(*) FILTER (WHERE bucket = 'partial') AS partial, count(*) FILTER (WHERE bucket = 'complete') AS complete,
round(avg(answered::INT) FILTER (WHERE bucket = 'complete'), 6) AS complete_answer_rate, round(avg(correct::INT) FILTER (WHERE bucket = 'complete'), 6) AS complete_correct_rate, round(avg((searches > 1)::INT) FILTER (WHERE bucket = 'partial'), 6) AS partial_continue_rate FROM facts GROUP BY group_id""",
    "movement_matrix": f"""{_BASE}, {_HALVES} SELECT CASE WHEN NOT a.legal AND b.legal THEN CASE WHEN b.correct THEN 'invalid_to_legal_correct' ELSE 'invalid_to_legal_wrong' END
WHEN a.legal AND b.legal THEN CASE WHEN NOT a.correct AND b.correct THEN 'legal_wrong_to_correct' WHEN a.correct AND NOT b.correct THEN 'legal_correct_to_wrong' WHEN a.correct THEN 'legal_stable_correct' ELSE 'legal_stable_wrong' END ELSE 'other' END AS movement, count(*) AS n
FROM base a JOIN cand b USING (case_id) GROUP BY 1""",
    "error_taxonomy": f"""{_BASE}, {_FACTS} SELECT CASE WHEN correct THEN 'correct' WHEN reason <> 'answer' THEN 'protocol_or_termination' WHEN (cents % 100) / 100.0 >= 0.8 THEN 'answer_variant_candidate' WHEN searches = 0 THEN 'ungrounded_direct_answer'
WHEN found_6 THEN 'entity_or_relation_selection_error' WHEN hits = 2 THEN 'support_complete_but_inference_error' WHEN hits > 0 THEN 'partial_support_then_answer' ELSE 'retrieval_failure_or_wrong_query' END AS category, count(*) AS n FROM facts GROUP BY 1""",
    "action_signatures": f"""WITH {STEPS}, s AS (SELECT group_id, rollout_id, string_agg(action, '>' ORDER BY step) AS actions, coalesce(string_agg(query::VARCHAR, ',' ORDER BY step) FILTER (WHERE action = 'search'), '') AS queries FROM steps GROUP BY ALL)
SELECT group_id, count(*) AS rollouts, count(DISTINCT actions) AS action_sequences, count(DISTINCT queries) AS query_sequences, min(actions) AS first_sequence FROM s GROUP BY group_id""",
    "trajectory_export": f"""{_BASE}, s AS (SELECT rollout_id, count(*) AS steps, '[' || string_agg('"' || step || '/' || action || '/' || query || '"', ',' ORDER BY step) || ']' AS transitions FROM steps GROUP BY rollout_id),
g AS (SELECT group_id, count(*) AS n FROM rollouts GROUP BY group_id) SELECT rollout_id, group_id, g.n, steps, transitions FROM rollouts JOIN g USING (group_id) JOIN s USING (rollout_id)""",
    "last_record_per_key": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "update_elapsed_lag": """SELECT user_id, event_id, round(CASE WHEN b IS NULL OR value < b THEN value ELSE value - b END, 4) AS elapsed, round(CASE WHEN b IS NULL THEN 0.0 ELSE greatest(0.0, value - b) END, 4) AS clipped
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)""",
    "diagnosis_rows": f"""{_BASE}, {_FACTS}, s AS (SELECT rollout_id, count(*) FILTER (WHERE n > 1) AS repeats FROM (SELECT rollout_id, row_number() OVER (PARTITION BY rollout_id, query ORDER BY step) AS n FROM steps WHERE action = 'search') GROUP BY rollout_id),
e AS (SELECT rollout_id, min(step) AS first_evidence FROM steps WHERE found IN (1, 4) GROUP BY rollout_id)
SELECT rollout_id, reason, bucket AS coverage, first_evidence, coalesce(repeats, 0) AS repeats FROM facts LEFT JOIN s USING (rollout_id) LEFT JOIN e USING (rollout_id)""",
}
