"""Queries of whole evaluation reports over all rollouts and steps, beside their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports as P
from ..tables import ROLLOUTS, STEPS, rollouts, steps
from .evaluation import _F1, _common, _plain


def _texts(s):
    """(rollout_id, said, gold): a rollout's actions in order, and its distinct ones in reverse, in capitals behind an article."""
    listed = s.groupBy("rollout_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))), lambda x: x["action"]).alias("a"))
    return listed.select("rollout_id", F.array_join("a", " ").alias("said"), F.upper(F.concat(F.lit("the "), F.array_join(F.reverse(F.array_distinct("a")), "  "))).alias("gold"))


def evaluation_report(spark, sf):
    """The global row of all rates; tasks of every seventh user aren't known."""
    s = steps(spark, sf)
    r = rollouts(spark, sf).join(_texts(s), "rollout_id")
    r = r.select(
        "rollout_id", F.col("group_id").alias("task_id"), (F.col("reason") != "invalid_action").alias("succeeded"), (F.col("reason") == "invalid_action").alias("failed"), "reward", F.col("correct").cast("double").alias("exact_match"),
        (-P.SEARCH_COST * F.col("searches")).alias("search_cost"), (F.col("reason") == "invalid_action").alias("invalid"), (F.col("reason") == "repeated_action").alias("repeated"), F.col("said").alias("answer"), F.when(F.col("group_id") % 7 != 0, F.col("gold")).alias("gold"),
    )
    e = F.col("event_id")
    t = s.select(
        "rollout_id", "step", (F.col("action") == "search").alias("tool"), F.col("action").isin("answer", "other").alias("content"), F.col("found").isNotNull().alias("ok"), F.when(F.col("found").isNotNull(), 1).alias("results"), (e % 29 == 0).alias("truncated"),
        (e % 3 != 0).alias("message_end"), F.when(e % 11 != 0, e % 5 != 0).alias("eos"), (e % 97).alias("reasoning_tokens"), F.when(e % 8 != 0, e % 13).alias("action_tokens"),
    )
    return P.evaluation_row(r, t)


def _cases(spark, sf):
    """A case for each rollout: its counts from the steps, tokens and seconds from event numbers and values."""
    s = steps(spark, sf)
    search, found = F.col("action") == "search", F.col("found")
    own = s.groupBy("rollout_id").agg(
        F.count_if(F.col("action") == "invalid").alias("invalid_actions"), F.count_if(search).alias("query_count"), F.count_distinct(F.when(search, F.col("query"))).alias("queries"), F.count(F.when(search, found)).alias("identified_results"),
        F.count_distinct(F.when(search, found)).alias("unique_documents"), F.count_if(search & found.isNull()).alias("empty_results"), F.sum(F.col("event_id") % 97).alias("input_tokens"), F.sum(F.col("event_id") % 13).alias("output_tokens"),
        F.round(F.sum("value"), 2).alias("model_seconds"), F.round(F.sum(F.when(search, F.col("value"))), 2).alias("tool_seconds"), F.count_distinct(F.when(found.isin(1, 4), found)).alias("retrieved"), F.max_by(F.when(found.isin(1, 4), 1).otherwise(0), "step").alias("visible"),
        F.max("event_id").alias("last"),
    )
    a, b = T.official_words(F.col("said")), T.official_words(F.col("gold"))
    r = rollouts(spark, sf).join(own, "rollout_id").join(_texts(s), "rollout_id")
    common = T.overlap(a, b)
    known = F.col("last") % 4 != 0
    return r.select(
        F.col("rollout_id").alias("case_id"), "group_id", "reason", (F.col("reason") == "answer").alias("answered"), (F.col("reason") == "answer").alias("answer_action"), F.when(F.col("group_id") % 6 != 0, F.col("correct").cast("int")).alias("normal"),
        ((F.col("reason") == "answer") & ~F.col("correct")).alias("wrong"), "invalid_actions", (F.col("query_count") - F.col("queries")).alias("repeated_actions"), "query_count", (F.col("query_count") - F.col("queries")).alias("query_duplicates"),
        F.col("identified_results").alias("document_results"), "identified_results", (F.col("identified_results") - F.col("unique_documents")).alias("document_duplicates"), F.col("identified_results").alias("search_ok"), F.col("query_count").alias("search_measurable"), "empty_results",
        F.when(known, "annotated").otherwise(F.when(F.col("last") % 8 == 0, "missing")).alias("annotation"), known.alias("measurable"), F.lit(2).alias("required"), "retrieved", "visible", F.col("n_steps").alias("model_calls"), F.col("query_count").alias("searches"),
        "input_tokens", "output_tokens", "model_seconds", "tool_seconds", F.round(F.col("model_seconds") * 2, 2).alias("elapsed_seconds"), "unique_documents",
        F.round(common / F.size(a), 6).alias("precision"), F.round(common / F.size(b), 6).alias("recall"), F.round(T.token_f1(a, b), 6).alias("f1"), "said", "last",
    )


def case_report(spark, sf):
    return P.case_aggregate(_cases(spark, sf), 1000)


def branch_report(spark, sf):
    """Four branches of users; some reasons and seconds are missing."""
    c = _cases(spark, sf).withColumn("branch", F.col("group_id") % 4)
    rows = c.select("branch", F.col("normal").alias("strict"), F.coalesce("normal", F.lit(0)).alias("normal"), "f1", F.when(F.col("last") % 9 != 0, F.col("reason")).alias("reason"), F.when(F.col("last") % 10 == 0, F.col("said")).alias("answer"), "invalid_actions", "repeated_actions", "model_calls", "searches", "input_tokens", "output_tokens", F.when(F.col("last") % 17 != 0, F.col("elapsed_seconds")).alias("seconds"), (F.col("last") * 1_000_000).alias("allocated_bytes"), (F.col("last") * 1_500_000).alias("reserved_bytes"))
    return P.branch_rows(rows, "branch", expected=1000)


QUERIES = {f.__name__: f for f in (evaluation_report, case_report, branch_report)}

_TEXTS = """al AS (SELECT rollout_id, list(action ORDER BY step) AS a FROM steps GROUP BY rollout_id),
tx AS (SELECT rollout_id, array_to_string(a, ' ') AS said, upper('the ' || array_to_string(list_reverse(list_filter(a, lambda x, i: list_position(a, x) = i)), '  ')) AS gold FROM al)"""
_CASES = f"""WITH {STEPS}, {ROLLOUTS}, {_TEXTS}, ow AS (SELECT rollout_id, count(*) FILTER (WHERE action = 'invalid') AS invalid_actions, count(*) FILTER (WHERE action = 'search') AS query_count, count(DISTINCT query) FILTER (WHERE action = 'search') AS queries,
count(found) FILTER (WHERE action = 'search') AS identified, count(DISTINCT found) FILTER (WHERE action = 'search') AS unique_documents, count(*) FILTER (WHERE action = 'search' AND found IS NULL) AS empty_results, sum(event_id % 97) AS input_tokens, sum(event_id % 13) AS output_tokens,
round(sum(value), 2) AS model_seconds, round(sum(value) FILTER (WHERE action = 'search'), 2) AS tool_seconds, count(DISTINCT found) FILTER (WHERE found IN (1, 4)) AS retrieved, arg_max(CASE WHEN found IN (1, 4) THEN 1 ELSE 0 END, step) AS visible, max(event_id) AS last FROM steps GROUP BY rollout_id),
rw AS (SELECT *, {_plain('said')} AS a, {_plain('gold')} AS b FROM rollouts JOIN ow USING (rollout_id) JOIN tx USING (rollout_id)), cm AS (SELECT *, coalesce({_common('a', 'b')}, 0)::DOUBLE AS c FROM rw),
cs AS (SELECT *, CASE WHEN group_id % 6 <> 0 THEN correct::INT END AS normal, last % 4 <> 0 AS known, query_count - queries AS dup, round(model_seconds * 2, 2) AS elapsed_seconds, round(c / len(a), 6) AS precision, round(c / len(b), 6) AS recall, round({_F1}, 6) AS f1 FROM cm)"""
_ROW = {
    "completion": {
        "count": "count(*)", "complete": "CAST(count(*) = 1000 AS INT)", "answered": "count(*) FILTER (WHERE reason = 'answer')", "answer_action": "count(*) FILTER (WHERE reason = 'answer')", "coverage": "count(*) FILTER (WHERE reason = 'answer') / count(*)",
        "normalized_em_count": "sum(normal)", "normalized_em_rate": "avg(normal)", "normalized_em_missing": "count(*) FILTER (WHERE normal IS NULL)", "accuracy_among_answered": "avg(normal) FILTER (WHERE reason = 'answer')", "answered_accuracy_measurable": "count(normal) FILTER (WHERE reason = 'answer')",
        "wrong_answers": "count(*) FILTER (WHERE reason = 'answer' AND NOT correct)", "wrong_answer_rate_all": "count(*) FILTER (WHERE reason = 'answer' AND NOT correct) / count(*)", "invalid_action_cases": "count(*) FILTER (WHERE invalid_actions > 0)", "invalid_action_count": "sum(invalid_actions)",
        "repeated_action_cases": "count(*) FILTER (WHERE dup > 0)", "repeated_action_count": "sum(dup)", "budget_exhausted_cases": "count(*) FILTER (WHERE reason = 'max_steps')",
    },
    "search": {
        "query_count": "sum(query_count)", "duplicate_queries": "sum(dup)", "duplicate_query_fraction": "sum(dup) / sum(query_count)", "document_results": "sum(identified)", "identified_document_results": "sum(identified)", "duplicate_document_results": "sum(identified - unique_documents)",
        "duplicate_document_fraction": "sum(identified - unique_documents) / sum(identified)", "successful_searches": "sum(identified)", "search_success_rate": "sum(identified) / sum(query_count)", "empty_search_results": "sum(empty_results)",
    },
    "source": {
        "measurable_cases": "count(*) FILTER (WHERE known)", "unknown_cases": "count(*) FILTER (WHERE NOT known)", "required_document_instances": "2 * count(*) FILTER (WHERE known)", "micro_recall": "sum(retrieved) FILTER (WHERE known) / (2 * count(*) FILTER (WHERE known))",
        "macro_recall": "avg(retrieved / 2) FILTER (WHERE known)", "any_retrieved": "count(*) FILTER (WHERE known AND retrieved > 0)", "all_retrieved": "count(*) FILTER (WHERE known AND retrieved = 2)", "last_visible_recall": "avg(visible / 2) FILTER (WHERE known)", "all_last_visible": "count(*) FILTER (WHERE known AND visible = 2)",
    },
}
_METRIC = {"model_calls": "n_steps", "searches": "query_count"}
_STATS = {"count": "count({m})", "missing": "count(*) - count({m})", "sum": "round(sum({m}), 4)", "mean": "avg({m})", "min": "min({m})", "max": "max({m})"} | {f"p{int(q * 100)}": f"quantile_cont({{m}}, {q})" for q in (0.5, 0.9, 0.95, 0.99)}
_VALUES = [(s, n, x) for s, own in _ROW.items() for n, x in own.items()] + [(s, f"{m}.{k}", x.format(m=f"CAST({_METRIC.get(m, m)} AS DOUBLE)")) for s, ms in (("per_case", P.CASE_METRICS), ("best_alias", P.ALIAS_METRICS)) for m in ms for k, x in _STATS.items()]
_MEAN = lambda x: f"round(avg({x}), 6)"

ORACLES = {
    "evaluation_report": f"""WITH {STEPS}, {ROLLOUTS}, {_TEXTS}, rr AS (SELECT *, {_plain('said')} AS a, {_plain('gold')} AS b, group_id % 7 <> 0 AS known FROM rollouts JOIN tx USING (rollout_id)), rc AS (SELECT *, coalesce({_common('a', 'b')}, 0)::DOUBLE AS c FROM rr),
r AS (SELECT count(DISTINCT group_id) AS task_count, count(*) AS rollout_count, {_MEAN("(reason <> 'invalid_action')::INT")} AS execution_success_rate, {_MEAN('correct::INT')} AS exact_match_rate,
round(avg((trim(regexp_replace(lower(said), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(gold), '\\s+', ' ', 'g')))::INT) FILTER (WHERE known), 6) AS strict_exact_match_rate, round(avg((a = b)::INT) FILTER (WHERE known), 6) AS normalized_exact_match_rate, round(avg({_F1}) FILTER (WHERE known), 6) AS token_f1,
{_MEAN('reward')} AS mean_reward, {_MEAN('searches')} AS mean_search_count, count(*) FILTER (WHERE reason = 'invalid_action') AS failed_rollout_count, {_MEAN("(reason <> 'invalid_action')::INT")} AS valid_action_rate, {_MEAN("(reason = 'invalid_action')::INT")} AS invalid_action_rate,
{_MEAN("(reason = 'repeated_action')::INT")} AS repeated_search_rate, count(*) AS denominator_rollouts, count(*) FILTER (WHERE known) AS denominator_answers FROM rc),
w AS (SELECT *, bool_or(action = 'search' AND found IS NULL) OVER (PARTITION BY rollout_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM steps),
t AS (SELECT round(avg((found IS NOT NULL)::INT) FILTER (WHERE action = 'search'), 6) AS search_action_success_rate, round(count(*) / count(DISTINCT rollout_id), 6) AS average_steps, {_MEAN('(event_id % 29 = 0)::INT')} AS output_budget_exhaustion_rate, {_MEAN('event_id % 97')} AS mean_reasoning_tokens,
{_MEAN('CASE WHEN event_id % 8 <> 0 THEN event_id % 13 ELSE 0 END')} AS mean_json_action_tokens, {_MEAN('(event_id % 3 <> 0)::INT')} AS generated_message_end_rate, {_MEAN('(event_id % 11 <> 0 AND event_id % 5 <> 0)::INT')} AS generated_eos_rate,
count(*) FILTER (WHERE seen AND action IN ('answer', 'other')) AS empty_result_direct_answer_count, count(*) FILTER (WHERE action = 'search') AS denominator_searches FROM w)
SELECT * FROM r, t""",
    "case_report": f"""{_CASES}, v AS (SELECT [{', '.join(f"{{'section': '{s}', 'name': '{n}', 'value': round(CAST({x} AS DOUBLE), 6)}}" for s, n, x in _VALUES)}] AS v FROM cs)
SELECT x.section AS section, x.name AS name, x.value AS value FROM (SELECT unnest(v) AS x FROM v) UNION ALL SELECT 'reason_counts', reason, count(*)::DOUBLE FROM cs GROUP BY reason
UNION ALL SELECT 'annotation_counts', CASE WHEN known THEN 'annotated' WHEN last % 8 = 0 THEN 'missing' ELSE 'unknown' END, count(*)::DOUBLE FROM cs GROUP BY 2""",
    "branch_report": f"""{_CASES}, b AS (SELECT *, group_id % 4 AS branch, CASE WHEN last % 9 <> 0 THEN reason END AS own, CASE WHEN last % 17 <> 0 THEN elapsed_seconds ELSE 0 END AS s FROM cs),
e AS (SELECT branch, string_agg(k || ':' || c, ',' ORDER BY k) AS end_reasons FROM (SELECT branch, coalesce(own, 'unknown') AS k, count(*) AS c FROM b GROUP BY ALL) GROUP BY branch)
SELECT branch, count(*) AS count, count(*) = 1000 AS complete, CAST(coalesce(sum(normal), 0) AS BIGINT) AS strict_em_count, CAST(coalesce(sum(normal), 0) AS BIGINT) AS normalized_em_count, round(coalesce(sum(normal), 0) / count(*), 6) AS strict_em_rate, round(coalesce(sum(normal), 0) / count(*), 6) AS normalized_em_rate,
round(avg(f1), 6) AS mean_f1, count(*) FILTER (WHERE own = 'answer' OR (last % 10 = 0 AND said <> '')) AS answered, round(count(*) FILTER (WHERE own = 'answer' OR (last % 10 = 0 AND said <> '')) / count(*), 6) AS answer_completion_rate,
CAST(sum(invalid_actions) AS BIGINT) AS invalid_actions, CAST(sum(dup) AS BIGINT) AS repeated_actions, CAST(sum(n_steps) AS BIGINT) AS model_calls, CAST(sum(query_count) AS BIGINT) AS searches, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
round(sum(s), 4) AS sum_question_seconds, round(avg(s), 6) AS mean_question_seconds, round(max(last) * 1000000 / 1073741824, 6) AS peak_allocated_gib, round(max(last) * 1500000 / 1073741824, 6) AS peak_reserved_gib, round(quantile_cont(s, 0.95), 6) AS p95_question_seconds, min(end_reasons) AS end_reasons FROM b JOIN e USING (branch) GROUP BY branch""",
}
