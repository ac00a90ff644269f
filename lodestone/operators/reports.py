"""Whole reports of evaluation runs: the global row with its denominators, the case aggregate, and a branch's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..scratch import written
from .stats import _beside, distribution, rate, running_counts

#: Reasons by which a budget ended a case.
BUDGETS = ("max_steps", "context_budget_error", "max_model_calls", "max_searches")
#: Costs of one search in a rollout's reward components.
SEARCH_COST = 0.03
CASE_METRICS = ("model_calls", "searches", "input_tokens", "output_tokens", "model_seconds", "tool_seconds", "elapsed_seconds", "unique_documents")
ALIAS_METRICS = ("precision", "recall", "f1")


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("long")


def evaluation_row(rollouts: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row of rates over all rollouts; an empty denominator counts as 1, so that rates of nothing are 0.

    rollouts: rollout_id, task_id, succeeded, failed, reward, exact_match, search_cost, invalid, repeated, answer, gold (null where the
    task isn't known: no answer metrics).  transitions: rollout_id, step, tool, content, ok, results, truncated,
    message_end, eos, reasoning_tokens, action_tokens.  Transitions are summed by rollout before they meet their rollout.
    """
    before = Window.partitionBy("rollout_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    empty = F.col("tool") & (F.coalesce("results", F.lit(0)) == 0)
    t = transitions.withColumn("_seen", F.coalesce(F.max(empty).over(before), F.lit(False)))
    counts = {
        "n_steps": F.lit(1), "tools": _flag(F.col("tool")), "oks": _flag(F.col("tool") & F.col("ok")), "cut": _flag(F.col("truncated")), "ends": _flag(F.col("message_end")), "eoses": _flag(F.col("eos")),
        "thought": F.coalesce("reasoning_tokens", F.lit(0)), "acted": F.coalesce("action_tokens", F.lit(0)), "direct": _flag(F.col("_seen") & F.col("content") & ~F.col("tool")),
    }
    own = t.groupBy("rollout_id").agg(*[F.sum(c.cast("long")).alias(name) for name, c in counts.items()])
    known = F.col("gold").isNotNull()
    r = rollouts.join(own, "rollout_id", "left").select(
        "*", known.alias("known"), F.when(known, _flag(T.norm(F.col("answer")) == T.norm(F.col("gold")))).alias("strict"),
        F.when(known, _flag(T.normalize_answer(F.col("answer")) == T.normalize_answer(F.col("gold")))).alias("normal"), F.when(known, T.token_f1(T.answer_words(F.col("answer")), T.answer_words(F.col("gold")))).alias("f1"),
    )
    n, answers = F.greatest(F.count("*"), F.lit(1)), F.greatest(F.count_if("known"), F.lit(1))
    replies, tools = F.greatest(_sum(F.col("n_steps")), F.lit(1)), F.greatest(_sum(F.col("tools")), F.lit(1))
    per = lambda c, of, name: F.round(_sum(c) / of, 6).alias(name)
    column = F.col
    return r.agg(
        F.count_distinct("task_id").alias("task_count"), F.count("*").alias("rollout_count"), per(_flag(column("succeeded")), n, "execution_success_rate"), per(column("exact_match"), n, "exact_match_rate"),
        per(column("strict"), answers, "strict_exact_match_rate"), per(column("normal"), answers, "normalized_exact_match_rate"), per(column("f1"), answers, "token_f1"), per(column("reward"), n, "mean_reward"),
        per(-column("search_cost") / SEARCH_COST, n, "mean_search_count"), _sum(_flag(column("failed"))).alias("failed_rollout_count"), F.round((n - _sum(_flag(column("invalid")))) / n, 6).alias("valid_action_rate"),
        per(column("oks"), tools, "search_action_success_rate"), per(_flag(column("invalid")), n, "invalid_action_rate"), per(_flag(column("repeated")), n, "repeated_search_rate"), per(column("n_steps"), n, "average_steps"),
        per(column("cut"), replies, "output_budget_exhaustion_rate"), per(column("thought"), replies, "mean_reasoning_tokens"), per(column("acted"), replies, "mean_json_action_tokens"), per(column("ends"), replies, "generated_message_end_rate"),
        per(column("eoses"), replies, "generated_eos_rate"), _sum(column("direct")).alias("empty_result_direct_answer_count"), n.alias("denominator_rollouts"), F.count_if("known").alias("denominator_answers"), _sum(column("tools")).alias("denominator_searches"),
    )


def case_aggregate(cases: DataFrame, expected: int | None = None) -> DataFrame:
    """(section, name, value): a run's counts and rates, its histograms of reasons and annotations, and its distributions.

    cases: case_id, reason, answered, answer_action, normal (0, 1 or null), wrong, invalid_actions, repeated_actions, query_count, query_duplicates,
    document_results, identified_results, document_duplicates, search_ok, search_measurable, empty_results, annotation, measurable, required, retrieved,
    visible, and the metrics of ``CASE_METRICS`` and ``ALIAS_METRICS``.  Rates of nothing are null.  All is one pass of partial sums, beside
    one pass over (metric, value) rows for exact percentiles.
    """
    column = F.col
    known = column("measurable")
    n, answered, right = F.count("*"), F.count_if("answered"), _sum(column("normal"))
    judged = column("answered") & column("normal").isNotNull()
    counts = {
        "completion": {
            "count": n, "complete": (n == expected).cast("long") if expected is not None else F.lit(None).cast("long"), "answered": answered, "answer_action": F.count_if("answer_action"), "coverage": rate(answered, n), "normalized_em_count": right,
            "normalized_em_rate": rate(right, F.count("normal")), "normalized_em_missing": n - F.count("normal"), "accuracy_among_answered": rate(_sum(F.when(column("answered"), column("normal"))), F.count_if(judged)),
            "answered_accuracy_measurable": F.count_if(judged), "wrong_answers": F.count_if("wrong"), "wrong_answer_rate_all": rate(F.count_if("wrong"), n), "invalid_action_cases": F.count_if(column("invalid_actions") > 0),
            "invalid_action_count": _sum(column("invalid_actions")), "repeated_action_cases": F.count_if(column("repeated_actions") > 0), "repeated_action_count": _sum(column("repeated_actions")), "budget_exhausted_cases": F.count_if(column("reason").isin(*BUDGETS)),
        },
        "search": {
            "query_count": _sum(column("query_count")), "duplicate_queries": _sum(column("query_duplicates")), "duplicate_query_fraction": rate(_sum(column("query_duplicates")), _sum(column("query_count"))), "document_results": _sum(column("document_results")),
            "identified_document_results": _sum(column("identified_results")), "duplicate_document_results": _sum(column("document_duplicates")), "duplicate_document_fraction": rate(_sum(column("document_duplicates")), _sum(column("identified_results"))),
            "successful_searches": _sum(column("search_ok")), "search_success_rate": rate(_sum(column("search_ok")), _sum(column("search_measurable"))), "empty_search_results": _sum(column("empty_results")),
        },
        "source": {
            "measurable_cases": F.count_if(known), "unknown_cases": n - F.count_if(known), "required_document_instances": _sum(F.when(known, column("required"))),
            "micro_recall": rate(_sum(F.when(known, column("retrieved"))), _sum(F.when(known, column("required")))), "macro_recall": F.avg(F.when(known, rate(column("retrieved"), column("required")))),
            "any_retrieved": _sum(_flag(known & (column("retrieved") > 0))), "all_retrieved": _sum(_flag(known & (column("retrieved") == column("required")))), "last_visible_recall": F.avg(F.when(known, rate(column("visible"), column("required")))),
            "all_last_visible": _sum(_flag(known & (column("visible") == column("required")))),
        },
    }
    stored = written(cases)
    long = [(s, name, c) for s, own in counts.items() for name, c in own.items()]
    row = stored.agg(*[c.cast("double").alias(f"{s}.{name}") for s, name, c in long])
    entry = lambda s, name, value: F.struct(F.lit(s).alias("section"), F.lit(name).alias("name"), F.round(value, 6).alias("value"))
    flat = row.select(F.inline(F.array(*[entry(s, name, F.col(f"`{s}.{name}`")) for s, name, _ in long])))
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.coalesce(F.col(c), F.lit("unknown")).alias("name")) for s, c in (("reason_counts", "reason"), ("annotation_counts", "annotation"))]))
    histograms = stored.select(kinds.alias("k")).groupBy("k.section", "k.name").agg(F.count("*").cast("double").alias("value"))
    metrics = [("per_case", m) for m in CASE_METRICS] + [("best_alias", m) for m in ALIAS_METRICS]
    values = stored.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for s, m in metrics])))
    spread = distribution(values, "x", "section", "metric")
    parts = [c for c in spread.columns if c not in ("section", "metric")]
    distributions = spread.select("section", F.inline(F.array(*[F.struct(F.concat("metric", F.lit(f".{c}")).alias("name"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in parts])))
    return flat.unionByName(histograms).unionByName(distributions)


def branch_rows(rows: DataFrame, *by: str, expected: int | None = None) -> DataFrame:
    """A row for each branch: exact matches, F1, tokens, seconds with the linear 95th percentile, peak memory in GiB, counts of end reasons.

    rows: strict, normal, f1, reason, answer, invalid_actions, repeated_actions, model_calls, searches, input_tokens, output_tokens,
    seconds, allocated_bytes, reserved_bytes.  The percentile is taken from running counts, so a hot branch's rows never meet in one task.
    """
    column = F.col
    stored = written(rows.withColumn("seconds", F.coalesce("seconds", F.lit(0.0)).cast("double")))
    n = F.count("*")
    answered = F.count_if((column("reason") == "answer") | (F.coalesce("answer", F.lit("")) != ""))
    sums = [F.round(_sum(column(c)), 6).alias(c) for c in ("invalid_actions", "repeated_actions", "model_calls", "searches", "input_tokens", "output_tokens")]
    peak = lambda c: F.round(F.coalesce(F.max(column(c)), F.lit(0)) / 2**30, 6)
    reasons = stored.groupBy(*by, F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("c")).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reason", "c"))), lambda x: F.concat(x["reason"], F.lit(":"), x["c"].cast("string"))), ",").alias("end_reasons"))
    place = (column("n") - 1) * 0.95
    at = lambda p: F.min(F.when(column("upto") > p, column("seconds")))
    part = F.max(place - F.floor(place))
    p95 = running_counts(stored, "seconds", *by).groupBy(*by).agg(F.round(at(F.floor(place)) * (1 - part) + at(F.ceil(place)) * part, 6).alias("p95_question_seconds"))
    own = stored.groupBy(*by).agg(
        n.alias("count"), (n == expected if expected is not None else F.lit(None).cast("boolean")).alias("complete"), _sum(column("strict")).cast("long").alias("strict_em_count"), _sum(column("normal")).cast("long").alias("normalized_em_count"),
        F.round(rate(_sum(column("strict")), n), 6).alias("strict_em_rate"), F.round(rate(_sum(column("normal")), n), 6).alias("normalized_em_rate"), F.round(rate(_sum(column("f1")), n), 6).alias("mean_f1"), answered.alias("answered"),
        F.round(rate(answered, n), 6).alias("answer_completion_rate"), *sums, F.round(F.sum("seconds"), 4).alias("sum_question_seconds"), F.round(rate(F.sum("seconds"), n), 6).alias("mean_question_seconds"), peak("allocated_bytes").alias("peak_allocated_gib"), peak("reserved_bytes").alias("peak_reserved_gib"),
    )
    return _beside(_beside(own, p95, by).select(*own.columns, "p95_question_seconds"), reasons, by).select(*own.columns, "p95_question_seconds", "end_reasons")
