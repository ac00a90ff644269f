"""Acceptance of reviewed training rows: ordered rules, of which the first that fails gives the row's code.

Codes, field names and labels are fixed values of the protocol.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels, roles, kinds of reviewers, and fields that a row must have.
RISKS = ("relation", "measurement", "time", "scope")
ROLES = ("system", "user", "assistant", "tool")
REVIEWERS = ("api", "task_agent")
FIELDS = ("evidence", "evidence_hash", "messages", "question", "reviews", "risk_labels", "state_hash", "step", "target", "target_assistant_index", "task_id")
#: Fixed value: what would tell a model the answer.
GOLD = r"""(?i)["']?\b(?:gold(?:en)?[ _-]?(?:answer|label)?|ground[ _-]?truth|support(?:ing)?[ _-]?(?:label|facts)|answer[ _-]?key)["']?\s*[:=]"""
SCHEMA = (
    "question string, task_id string, messages array<struct<content:string,role:string>>, target struct<action:string,value:string>, step int, risk_labels array<string>, "
    "evidence array<struct<id:string,text:string,title:string>>, evidence_hash string, reviews array<struct<approved:boolean,candidate_hash:string,citations:array<struct<document_id:string,quote:string>>,"
    "kind:string,missing_fact:string,reason:string,reviewer:string,state_hash:string>>, state_hash string, target_assistant_index int, retrieval_results array<struct<id:string,text:string>>"
)
#: Results of a search of which a review may quote.
SEEN_RESULTS = 3


def question_key(x: Column) -> Column:
    """Lower case (``ß`` as ss), all but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(x, r"\s+", " ")) == "", F.lit(True))


def _any(xs: Column, f) -> Column:
    return F.coalesce(F.exists(xs, lambda x: F.coalesce(f(x), F.lit(False))), F.lit(False))


def evidence_hash(evidence: Column) -> Column:
    """SHA-256 of the documents as JSON with sorted keys; the struct's fields stand in that order."""
    return F.sha2(F.to_json(evidence), 256)


def state_hash(question: Column, messages: Column) -> Column:
    """SHA-256 of the question's key and all messages but the last, which is the target's."""
    seen = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.sha2(F.to_json(F.struct(seen.alias("messages"), question_key(question).alias("question"))), 256)


def candidate_hash(state: Column, target: Column, evidence: Column) -> Column:
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    return F.sha2(F.concat(F.lit("["), quoted(state), F.lit(","), F.to_json(target), F.lit(","), quoted(evidence), F.lit("]")), 256)


def _kind(x: Column, path: str = "$") -> Column:
    return F.schema_of_variant(F.variant_get(F.try_parse_json(x), path, "variant"))


def shown_documents(messages: Column) -> Column:
    """Documents of the tool messages: of an id shown more than once the last text, at the place of the first."""
    tools = F.filter(messages, lambda m: m["role"] == "tool")
    own = F.flatten(F.transform(tools, lambda m: F.coalesce(F.from_json(m["content"], "result array<struct<id:string,text:string,title:string>>")["result"], F.array().cast("array<struct<id:string,text:string,title:string>>"))))
    full = F.filter(own, lambda d: (F.coalesce(d["id"], F.lit("")) != "") & (F.coalesce(d["text"], F.lit("")) != ""))
    last = lambda i: F.try_element_at(F.filter(full, lambda d: d["id"] == i), F.lit(-1))
    return F.transform(F.array_distinct(F.transform(full, lambda d: d["id"])), lambda i: F.struct(i.alias("id"), last(i)["text"].alias("text"), F.coalesce(last(i)["title"], F.lit("")).alias("title")))


def first_failure(prefix: str = "") -> Column:
    """The code of the first rule that a row of ``SCHEMA`` fails; null if it passes all.  A null column is a missing field."""
    c = lambda name: F.col(prefix + name)
    messages, target, evidence, reviews = c("messages"), c("target"), c("evidence"), c("reviews")
    missing = F.array_compact(F.array(*[F.when(c(f).isNull(), f) for f in FIELDS]))
    before = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    final = F.try_element_at(messages, F.lit(-1))
    said, key = final["content"], F.when(target["action"] == "answer", "answer").otherwise("query")
    same = (F.array_sort(F.json_object_keys(said)) == F.array_sort(F.array(F.lit("action"), key))) & (F.get_json_object(said, "$.action") == target["action"]) & (F.when(target["action"] == "answer", F.get_json_object(said, "$.answer")).otherwise(F.get_json_object(said, "$.query")) == target["value"])
    ids = F.transform(evidence, lambda d: d["id"])
    search = target["action"] == "search"
    results = F.slice(F.coalesce(c("retrieval_results"), F.array().cast("array<struct<id:string,text:string>>")), 1, SEEN_RESULTS)
    pair = lambda docs: F.transform(docs, lambda d: F.struct(d["id"].alias("id"), d["text"].alias("text")))
    quotable = F.when(search, F.concat(pair(evidence), pair(results))).otherwise(pair(evidence))
    text_of = lambda docs, q: F.try_element_at(F.filter(docs, lambda d: d["id"] == q["document_id"]), F.lit(-1))["text"]
    quoted = lambda docs, q: F.coalesce((q["quote"] != "") & F.contains(text_of(docs, q), q["quote"]), F.lit(False))
    texts = F.transform(evidence, lambda d: d["text"])
    adds = lambda r: _any(r["citations"], lambda q: quoted(pair(results), q) & ~F.array_contains(texts, text_of(pair(results), q)))
    wrong_review = lambda r: ~F.coalesce(
        r["approved"] & r["kind"].isin(*REVIEWERS) & ~_blank(r["reason"]) & (r["state_hash"] == c("state_hash")) & (r["candidate_hash"] == candidate_hash(c("state_hash"), target, c("evidence_hash"))) & ~_blank(r["reviewer"]), F.lit(False)
    )
    names = F.array_distinct(F.transform(reviews, lambda r: F.lower(F.trim(r["reviewer"]))))
    kinds = F.array_distinct(F.transform(reviews, lambda r: r["kind"]))
    asked = F.filter(before, lambda m: (m["role"] == "assistant") & (F.get_json_object(m["content"], "$.action") == "search"))
    prior = F.transform(asked, lambda m: question_key(F.get_json_object(m["content"], "$.query")))
    object_ = lambda m: F.coalesce(_kind(m["content"]).startswith("OBJECT") & F.coalesce(_kind(m["content"], "$.result").startswith("ARRAY") | (_kind(m["content"], "$.result") == "VOID"), F.lit(True)), F.lit(True))
    # of one review all its rules come before the next one's
    review_rule = lambda r: (
        F.when((F.size(F.coalesce(r["citations"], F.array().cast("array<struct<document_id:string,quote:string>>"))) == 0) | _any(r["citations"], lambda q: ~quoted(quotable, q)), "review_citations_required")
        .when(search & (F.coalesce(r["missing_fact"], F.lit("")) == ""), "search_gap_required")
        .when(search & ~adds(r), "search_citation_must_add_evidence")
    )
    rules = [
        (F.size(missing) > 0, F.concat(F.lit("missing_fields:"), F.array_join(missing, ","))),
        (_blank(c("question")), "question_required"),
        (_blank(c("task_id")), "task_id_required"),
        (F.size(messages) == 0, "messages_required"),
        (_any(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)) | m["content"].isNull()), "invalid_visible_message"),
        ((c("target_assistant_index") != F.size(messages) - 1) | (final["role"] != "assistant"), "final_target_assistant_required"),
        (~F.coalesce(target["action"].isin("answer", "search"), F.lit(False)) | _blank(target["value"]), "invalid_target"),
        (~F.coalesce(same, F.lit(False)), "target_message_mismatch"),
        (c("step") < 0, "invalid_step"),
        (_any(c("risk_labels"), lambda x: ~F.coalesce(x.isin(*RISKS), F.lit(False))) | (F.size(F.array_distinct(c("risk_labels"))) != F.size(c("risk_labels"))), "invalid_risk_labels"),
        (_any(evidence, lambda d: _blank(d["id"]) | _blank(d["text"]) | d["title"].isNull()) | (F.size(F.array_distinct(ids)) != F.size(ids)), "evidence_required"),
        ((F.size(evidence) == 0) & (~search | (c("step") != 0)), "empty_evidence_only_initial_search"),
        (_any(F.filter(before, lambda m: m["role"] == "tool"), lambda m: ~object_(m)), "malformed_tool_evidence"),
        (~F.coalesce(evidence == shown_documents(before), F.lit(False)), "visible_evidence_mismatch"),
        (c("evidence_hash") != evidence_hash(evidence), "evidence_hash_mismatch"),
        (_any(messages, lambda m: F.regexp_like(m["content"], F.lit(GOLD))), "gold_metadata_in_messages"),
        ((F.size(reviews) != 2) | _any(reviews, wrong_review) | (F.size(kinds) != 2) | (F.size(names) != 2), "dual_approved_reviews_required"),
        (c("state_hash") != state_hash(c("question"), messages), "state_hash_mismatch"),
    ]
    code = None
    for failed, name in rules:
        value = F.lit(name) if isinstance(name, str) else name
        code = F.when(failed, value) if code is None else code.when(failed, value)
    by_review = F.get(F.array_compact(F.transform(reviews, review_rule)), F.lit(0))
    repeated = F.when(search & F.array_contains(prior, question_key(target["value"])), "repeated_search_target")
    return code.otherwise(F.coalesce(by_review, repeated))
