"""Protocol checks as arrays of error codes: references, candidates, selections, reviews, training rows, frozen sets.

The codes, field names and bounds are fixed values of the protocol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import field_errors

#: The protocol's bounds.
MOST_REFS, MOST_TEXT, MOST_CANDIDATES, MOST_QUERIES = 64, 4000, 4, 2
STATUSES = ("supported", "contradicted", "insufficient")
CONDITIONS = ("one_hop", "two_hop", "empty_result", "repeated_history")
FORBIDDEN = ("final-test", "final_test", "independent", "holdout")
ROLES = ("system", "user", "assistant", "tool", "assistant")


def _codes(*codes: Column) -> Column:
    return F.array_compact(F.array(*codes))


def _given(raw: Column, key: str, kind: str) -> Column:
    """A field parsed as a type; null if it isn't there or isn't of that type."""
    return F.from_json(raw, f"`{key}` {kind}")[key]


def _is_list(raw: Column, key: str) -> Column:
    return F.coalesce(F.startswith(F.get_json_object(raw, f"$.{key}"), F.lit("[")), F.lit(False))


def _text_ok(raw: Column, key: str, empty: bool = False) -> Column:
    """A JSON string of bounded length, not blank; numbers, lists and objects aren't strings."""
    typed = F.schema_of_variant(F.variant_get(F.try_parse_json(raw), f"$.{key}", "variant"))
    value = F.get_json_object(raw, f"$.{key}")
    return F.coalesce((typed == "STRING") & (F.length(value) <= MOST_TEXT) & (F.lit(empty) | (F.trim(value) != "")), F.lit(False))


def reference_errors(ids: Column, registry: Column) -> Column:
    """Of a list of references: too long or none, not a string (null), named twice, or not of the registry."""
    one = lambda x, i: F.concat(F.lit("evidence_"), i.cast("string"), F.when(x.isNull(), ":string_required").when(F.array_position(ids, x) <= i, ":duplicate").when(~F.array_contains(registry, x), ":unknown_or_stale"))
    return F.when(ids.isNull() | (F.size(ids) > MOST_REFS), F.array(F.lit("evidence_ids_list_required_or_too_long"))).otherwise(F.array_compact(F.transform(ids, one)))


def _refs(raw: Column, registry: Column) -> Column:
    ids = F.when(_is_list(raw, "evidence_ids"), _given(raw, "evidence_ids", "array<string>"))
    return reference_errors(ids, registry)


def _none_given(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(raw, "$.evidence_ids") == "[]", F.lit(False))


def candidate_errors(raw: Column, registry: Column) -> Column:
    """Of ``{"candidates": [{"answer", "evidence_ids"}]}``: codes of the whole and ``candidate_i:<code>``."""
    values = F.when(_is_list(raw, "candidates"), _given(raw, "candidates", "array<string>"))
    one = lambda c: F.concat(field_errors(c, ("answer", "evidence_ids")), _codes(F.when(~_text_ok(c, "answer"), "answer_invalid")), _refs(c, registry), _codes(F.when(_none_given(c), "missing_evidence")))
    local = F.flatten(F.transform(values, lambda c, i: F.transform(one(c), lambda e: F.concat(F.lit("candidate_"), i.cast("string"), F.lit(":"), e))))
    return F.concat(field_errors(raw, ("candidates",)), F.when(values.isNull() | (F.size(values) > MOST_CANDIDATES), F.array(F.lit("candidates_list_required_or_too_long"))).otherwise(local))


def selection_errors(raw: Column, candidates: Column, registry: Column) -> Column:
    """Of ``{"decision", "candidate_id", "evidence_ids"}`` against the candidates' ids."""
    decision, chosen = F.get_json_object(raw, "$.decision"), F.get_json_object(raw, "$.candidate_id")
    ids_bad = F.exists(candidates, lambda c: c.isNull()) | (F.size(F.array_distinct(candidates)) != F.size(candidates))
    select, abstain = F.coalesce(decision == "select", F.lit(False)), F.coalesce(decision == "abstain", F.lit(False))
    own = _codes(
        F.when(ids_bad, "candidate_ids_invalid"), F.when(select & ~F.coalesce(F.array_contains(candidates, chosen), F.lit(False)), "unknown_candidate"), F.when(select & _none_given(raw), "missing_evidence"),
        F.when(abstain & (chosen.isNotNull() | ~_none_given(raw)), "abstain_requires_null_id_empty_evidence"), F.when(~select & ~abstain, "decision_invalid"),
    )
    fields = field_errors(raw, ("decision", "candidate_id", "evidence_ids"))
    return F.when(F.array_contains(fields, "object_required"), fields).otherwise(F.concat(fields, _refs(raw, registry), own))


def assessment_errors(raw: Column, registry: Column) -> Column:
    """Of one assessment ``{"id", "status", "reason", "evidence_ids"}``."""
    status = F.get_json_object(raw, "$.status")
    own = _codes(F.when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "status_invalid"), F.when(~_text_ok(raw, "reason"), "reason_invalid"))
    return F.concat(field_errors(raw, ("id", "status", "reason", "evidence_ids")), own, _refs(raw, registry), _codes(F.when(status.isin("supported", "contradicted") & _none_given(raw), "missing_evidence")))


def _where(assessments: Column, answer: str) -> Column:
    return F.filter(assessments, lambda a: F.coalesce(F.get_json_object(a, "$.id") == answer, F.lit(False)))


def _under(errors: Column, answer: str) -> Column:
    return F.transform(errors, lambda e: F.concat(F.lit(f"{answer}:"), e))


def review(raw: Column, answers: tuple[str, ...], registry: Column) -> dict[str, Column]:
    """``errors`` of a whole review, and for each answer ``<id>_status`` where its own assessment is valid, else null; a broken one spoils no other."""
    values = F.coalesce(F.when(_is_list(raw, "assessments"), _given(raw, "assessments", "array<string>")), F.array().cast("array<string>"))
    long = ~_is_list(raw, "assessments") | (F.size(values) > MOST_CANDIDATES)
    values = F.when(long, F.array().cast("array<string>")).otherwise(values)
    named = lambda a: F.get_json_object(a, "$.id")
    queries = F.when(_is_list(raw, "queries"), _given(raw, "queries", "array<string>"))
    bad_queries = queries.isNull() | (F.size(queries) > MOST_QUERIES) | F.exists(queries, lambda q: q.isNull() | (F.trim(q) == "") | (F.length(q) > MOST_TEXT))
    errors = [field_errors(raw, ("assessments", "information_gap", "queries")), _codes(F.when(long, "assessments_list_required_or_too_long"), F.when(~_text_ok(raw, "information_gap", True), "information_gap_invalid"), F.when(F.coalesce(bad_queries, F.lit(True)), "queries_invalid"), F.when(F.exists(values, lambda a: ~F.coalesce(named(a).isin(*answers), F.lit(False))), "unexpected_assessment"))]
    out: dict[str, Column] = {}
    for answer in answers:
        own = _where(values, answer)
        found = F.when(F.size(own) != 1, F.array(F.lit("missing_or_duplicate_assessment"))).otherwise(assessment_errors(F.get(own, F.lit(0)), registry))
        errors.append(_under(found, answer))
        out[f"{answer}_status"] = F.when(F.size(found) == 0, F.get_json_object(F.get(own, F.lit(0)), "$.status"))
    return {"errors": F.concat(*errors), **out}


def decided(original: Column, selected: Column, checked: dict[str, Column], protect: bool = True) -> dict[str, Column]:
    """A valid supported original is kept first; a supported selection replaces it only under a valid review; else the original stays."""
    keep = F.lit(protect) & F.coalesce(checked["original_status"] == "supported", F.lit(False))
    take = (F.size(checked["errors"]) == 0) & F.coalesce(checked["selected_status"] == "supported", F.lit(False))
    return {"answer": F.when(~keep & take, selected).otherwise(original), "status": F.when(keep, "preserve_supported_original").when(take, "selected_supported").otherwise("fallback_original")}


def training_row_errors(messages: Column, gold: Column) -> Column:
    """Of a row's messages (array<struct<role, content>>) and gold answer: roles, actions that are no JSON or not legal, no gold."""
    roles = F.transform(messages, lambda m: m["role"])
    action = lambda i: F.get(messages, F.lit(i))["content"]
    json_ok = lambda i: F.coalesce(F.startswith(F.ltrim(action(i)), F.lit("{")) & F.get_json_object(action(i), "$").isNotNull(), F.lit(False))
    legal = lambda i: F.coalesce(F.get_json_object(action(i), "$.action").isin("search", "answer"), F.lit(False))
    per = [c for i in (2, 4) for c in (F.when(~json_ok(i), f"assistant_{i}:not_json"), F.when(json_ok(i) & ~legal(i), f"assistant_{i}:illegal_action"))]
    return F.concat(_codes(F.when(~F.coalesce(roles == F.array(*[F.lit(r) for r in ROLES]), F.lit(False)), "five_turns_required")), F.when(F.size(messages) > 0, _codes(*per)).otherwise(F.array().cast("array<string>")), _codes(F.when(F.coalesce(gold, F.lit("")) == "", "gold_answer_missing")))


def frozen_cases(cases: DataFrame, count: int = 120, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """One row of rule results of a frozen set (case_id, condition): its size, its conditions, unique ids."""
    wanted = F.array(*[F.lit(c) for c in sorted(conditions)])
    return cases.agg(F.count("*").alias("cases"), (F.count("*") == count).alias("size_right"), (F.array_sort(F.collect_set("condition")) == wanted).alias("conditions_right"), (F.count_distinct("case_id") == F.count("*")).alias("ids_unique"))


#: Risk labels that a review may give.
REVIEW_RISKS = ("relation", "time", "measurement", "scope")


def stage_review_errors(r: Column, packet: Column) -> Column:
    """Of a review (packet_sha256, approved, reason, risk_labels, missing_fact, citations: array<struct<stage, document_id, quote>>) of a packet (packet_sha256, action, docs: array<struct<stage, id, text>>).

    An approved answer cites what was visible and nothing else; an approved search cites a document that it newly found.
    """
    docs, blank = packet["docs"], lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    legal = lambda c: ~blank(c["quote"]) & F.exists(docs, lambda d: (d["stage"] == c["stage"]) & (d["id"] == c["document_id"]) & F.contains(d["text"], c["quote"]))
    good = F.filter(r["citations"], lambda c: F.coalesce(legal(c), F.lit(False)))
    bad = F.transform(F.filter(r["citations"], lambda c: ~F.coalesce(legal(c), F.lit(False))), lambda _: F.lit("illegal_verbatim_citation"))
    stages = F.array_distinct(F.transform(good, lambda c: c["stage"]))
    seen = F.transform(F.filter(docs, lambda d: d["stage"] == "visible"), lambda d: d["id"])
    new = F.exists(good, lambda c: (c["stage"] == "retrieved") & ~F.array_contains(seen, c["document_id"]))
    always = _codes(F.when(~F.coalesce(r["packet_sha256"] == packet["packet_sha256"], F.lit(False)), "packet_sha256_mismatch"), F.when(r["approved"].isNull(), "missing_boolean_approval"), F.when(blank(r["reason"]), "missing_reason"))
    risks = _codes(F.when(r["risk_labels"].isNull() | F.exists(r["risk_labels"], lambda x: ~F.coalesce(x.isin(*REVIEW_RISKS), F.lit(False))), "invalid_risk_labels"))
    answer, search = packet["action"] == "answer", packet["action"] == "search"
    last = _codes(
        F.when(answer & (F.coalesce(F.array_join(stages, ","), F.lit("")) != "visible"), "answer_requires_visible_only_citations"), F.when(search & ~F.coalesce(new, F.lit(False)), "search_requires_new_top3_citation"),
        F.when(search & blank(r["missing_fact"]), "search_requires_missing_fact"), F.when(~F.coalesce(answer | search, F.lit(False)), "unknown_action"),
    )
    none = r["citations"].isNull() | (F.size(r["citations"]) == 0)
    approved = F.concat(risks, F.when(none, F.array(F.lit("missing_citations"))).otherwise(F.concat(bad, last)))
    return F.when(F.coalesce(r["approved"], F.lit(False)), F.concat(always, approved)).otherwise(always)


def packet_faults(packets: DataFrame, records: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, fault) of packets against their records, field by field in order: ok, record_missing, record_twice, packet_missing or ``<field>_differs``."""
    r = records.groupBy(key).agg(F.count("*").alias("_n"), *[F.max(there).alias(f"_r{n}") for n, there in enumerate(fields.values())])
    j = packets.withColumn("_p", F.lit(True)).join(r, key, "full_outer")
    differs = [F.when(~F.col(here).eqNullSafe(F.col(f"_r{n}")), f"{here}_differs") for n, here in enumerate(fields)]
    return j.select(key, F.coalesce(F.when(F.col("_p").isNull(), "packet_missing"), F.when(F.col("_n").isNull(), "record_missing"), F.when(F.col("_n") > 1, "record_twice"), *differs, F.lit("ok")).alias("fault"))


def archive_errors(names: list[str], forbidden: tuple[str, ...] = FORBIDDEN) -> list[str]:
    """Of an archive's member names, before anything is unpacked: absolute or climbing paths, drives, sealed parts, names that meet without case."""
    errors, seen = [], set()
    for name in names:
        plain = name.replace("\\", "/")
        parts = plain.removesuffix("/").split("/")
        if plain.startswith("/") or ":" in plain or any(p in ("", ".", "..") or any(f in p.casefold() for f in forbidden) for p in parts):
            errors.append(f"forbidden_archive_member:{name}")
        elif plain.casefold() in seen:
            errors.append(f"duplicate_archive_member:{name}")
        seen.add(plain.casefold())
    return errors
