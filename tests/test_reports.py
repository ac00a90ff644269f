"""Whole reports by hand: rates of nothing, missing values, searches without results before an answer."""

from lodestone.operators import reports as P

ROLLOUT = "rollout_id string, task_id string, succeeded boolean, failed boolean, reward double, exact_match double, search_cost double, invalid boolean, repeated boolean, answer string, gold string"
TRANSITION = "rollout_id string, step int, tool boolean, content boolean, ok boolean, results int, truncated boolean, message_end boolean, eos boolean, reasoning_tokens int, action_tokens int"


def test_evaluation_row(spark):
    rollouts = spark.createDataFrame([
        ("a", "t", True, False, 1.0, 1.0, -0.06, False, False, "The  Red fox", "the red fox"), ("b", "t", True, False, 0.0, 0.0, -0.03, False, True, "red fox!", "the fox"),
        ("c", "u", False, True, None, None, None, True, None, None, None), ("d", "v", None, None, 0.5, 0.0, 0.0, None, None, "x", None),
    ], ROLLOUT)
    transitions = spark.createDataFrame([
        ("a", 1, True, False, True, 3, False, True, None, 10, 4), ("a", 2, True, False, False, 0, None, True, True, None, 4), ("a", 3, False, True, None, None, True, False, True, 6, None),
        ("b", 1, False, True, None, None, False, True, True, 4, 4), ("b", 2, True, False, None, None, False, True, True, 0, 0), ("stray", 1, True, True, True, 0, True, True, True, 99, 99),
    ], TRANSITION)
    r = P.evaluation_row(rollouts, transitions).first()
    assert (r.task_count, r.rollout_count, r.failed_rollout_count) == (3, 4, 1)
    assert (r.execution_success_rate, r.exact_match_rate, r.mean_reward, r.mean_search_count) == (0.5, 0.25, 0.375, 0.75)
    assert (r.denominator_answers, r.strict_exact_match_rate, r.normalized_exact_match_rate, r.token_f1) == (2, 0.5, 0.5, round((1 + 2 / 3) / 2, 6))
    assert (r.valid_action_rate, r.invalid_action_rate, r.repeated_search_rate) == (0.75, 0.25, 0.25)
    assert (r.denominator_searches, r.search_action_success_rate, r.average_steps) == (3, 0.333333, 1.25)
    assert (r.output_budget_exhaustion_rate, r.mean_reasoning_tokens, r.mean_json_action_tokens, r.generated_message_end_rate, r.generated_eos_rate) == (0.2, 4.0, 2.4, 0.8, 0.8)
    assert r.empty_result_direct_answer_count == 1


def test_rates_of_nothing(spark):
    r = P.evaluation_row(spark.createDataFrame([], ROLLOUT), spark.createDataFrame([], TRANSITION)).first().asDict()
    assert r.pop("denominator_rollouts") == 1 and r.pop("valid_action_rate") == 1.0 and set(r.values()) == {0}


def test_case_aggregate_and_branches(spark):
    case = {"case_id": "a", "reason": "answer", "answered": True, "answer_action": True, "normal": 1, "wrong": False, "invalid_actions": 0, "repeated_actions": 1, "query_count": 3, "query_duplicates": 1, "document_results": 4, "identified_results": 4, "document_duplicates": 2, "search_ok": 2, "search_measurable": 3, "empty_results": 1, "annotation": "annotated", "measurable": True, "required": 2, "retrieved": 1, "visible": 1} | dict.fromkeys(P.CASE_METRICS, 2.0) | dict.fromkeys(P.ALIAS_METRICS, 0.5)
    other = case | {"case_id": "b", "reason": "max_steps", "answered": False, "answer_action": False, "normal": None, "measurable": False, "required": 9, "retrieved": 9, "f1": None, "annotation": None, "searches": 5.0}
    schema = ", ".join(f"{k} {'string' if k in ('case_id', 'reason', 'annotation') else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int'}" for k, v in case.items())
    frame = spark.createDataFrame([tuple(case.values()), tuple(other.values())], schema)
    got = {(r.section, r.name): r.value for r in P.case_aggregate(frame, 3).collect()}
    assert got["completion", "complete"] == 0 and got["completion", "coverage"] == 0.5 and got["completion", "normalized_em_rate"] == 1 and got["completion", "normalized_em_missing"] == 1
    assert got["completion", "budget_exhausted_cases"] == 1 and got["source", "micro_recall"] == 0.5 and got["source", "unknown_cases"] == 1 and got["source", "required_document_instances"] == 2
    assert got["per_case", "searches.p50"] == 3.5 and got["best_alias", "f1.missing"] == 1 and got["reason_counts", "max_steps"] == 1 and got["annotation_counts", "unknown"] == 1
    assert got["search", "duplicate_query_fraction"] == round(1 / 3, 6)
    empty = {(r.section, r.name): r.value for r in P.case_aggregate(frame.limit(0)).collect()}
    assert empty["completion", "count"] == 0 and empty["completion", "coverage"] is None and empty["source", "micro_recall"] is None
    kinds = "g string, strict int, normal int, f1 double, reason string, answer string, invalid_actions int, repeated_actions int, model_calls int, searches int, input_tokens long, output_tokens long, seconds double, allocated_bytes long, reserved_bytes long"
    rows = spark.createDataFrame([("x", 1, 1, 1.0, "answer", None, 0, 0, 2, 1, 10, 5, 1.0, 2**30, 2**31), ("x", 0, 1, 0.5, None, "said", 1, 0, 2, 1, 10, 5, 3.0, None, None), (None, 0, 0, 0.0, "max_steps", "", 0, 2, 2, 1, None, 5, None, None, None)], kinds)
    by = {r.g: r for r in P.branch_rows(rows, "g", expected=2).collect()}
    assert by["x"].complete and by["x"].answered == 2 and by["x"].p95_question_seconds == 2.9 and by["x"].peak_reserved_gib == 2 and by["x"].end_reasons == "answer:1,unknown:1"
    assert by[None].answered == 0 and by[None].input_tokens == 0 and by[None].p95_question_seconds == 0 and not by[None].complete
