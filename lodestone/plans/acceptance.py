"""Acceptance of a reviewed training row made of every document, beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acceptance as A
from ..session import spread, table


def _rows(spark, sf):
    """A row for each document, which a first search has shown: every third searches on, in half of them for the same title in other
    marks; others answer.  Reviewers are named by the language and by the text's first letters, and quote its third to ninth word."""
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")))
    d = d.withColumn("w", F.split("text", "[ \n]")).withColumn("title", F.array_join(F.slice("w", 1, 6), " "))
    search, even = F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0
    again = F.when(even, F.upper(F.array_join(F.slice("w", 1, 6), " - "))).otherwise(F.concat(F.coalesce("lang", F.lit("")), F.lit(" of "), "title"))
    value = F.when(search, again).otherwise(F.array_join(F.slice("w", 2, 5), " "))
    evidence = F.array(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", "title"))
    d = d.select("doc_id", "lang", "text", "title", search.alias("search"), F.struct(F.when(search, "search").otherwise("answer").alias("action"), value.alias("value")).alias("target"), evidence.alias("evidence"), F.array_join(F.slice("w", 3, 7), " ").alias("quote"))
    message = lambda role, content: F.struct(content.alias("content"), F.lit(role).alias("role"))
    first = F.to_json(F.struct(F.lit("search").alias("action"), F.col("title").alias("query")))
    final = F.when(F.col("search"), F.to_json(F.struct(F.lit("search").alias("action"), F.col("target.value").alias("query")))).otherwise(F.to_json(F.struct(F.lit("answer").alias("action"), F.col("target.value").alias("answer"))))
    question = F.concat(F.lit("What of "), "title", F.lit("?"))
    d = d.withColumn("question", question).withColumn("messages", F.array(message("user", question), message("assistant", first), message("tool", F.to_json(F.struct(F.col("evidence").alias("result")))), message("assistant", final)))
    d = d.withColumn("evidence_hash", A.evidence_hash(F.col("evidence"))).withColumn("state_hash", A.state_hash(F.col("question"), F.col("messages")))
    found = F.struct(F.lit("found").alias("id"), F.concat("title", F.lit(" again")).alias("text"))
    quote = F.struct(F.when(F.col("search"), "found").otherwise(F.col("evidence")[0]["id"]).alias("document_id"), F.when(F.col("search"), F.col("title")).otherwise(F.col("quote")).alias("quote"))
    review = lambda kind, who: F.struct(
        F.lit(True).alias("approved"), A.candidate_hash(F.col("state_hash"), F.col("target"), F.col("evidence_hash")).alias("candidate_hash"), F.array(quote).alias("citations"), F.lit(kind).alias("kind"),
        F.when(F.col("doc_id") % 7 != 0, "what follows").alias("missing_fact"), F.lit("read").alias("reason"), who.alias("reviewer"), F.col("state_hash").alias("state_hash"),
    )
    return d.select(
        "doc_id", "question", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("task_id"), "messages", "target", F.lit(1).alias("step"), F.array(F.lit("scope")).alias("risk_labels"), "evidence", "evidence_hash",
        F.array(review("api", F.coalesce("lang", F.lit("none"))), review("task_agent", F.concat(F.lower(F.substring("text", 1, 2)), F.lit(" ")))).alias("reviews"), "state_hash", F.lit(3).alias("target_assistant_index"), F.array(found).alias("retrieval_results"),
    )


def reviewed_row_acceptance(spark, sf):
    """The code of the first failing rule of each document's row, or accepted."""
    return _rows(spark, sf).select("doc_id", F.coalesce(A.first_failure(), F.lit("accepted")).alias("code"))


QUERIES = {"reviewed_row_acceptance": reviewed_row_acceptance}

_KEY = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_BLANK = "trim(regexp_replace({}, '\\s+', ' ', 'g')) = ''"
ORACLES = {
    "reviewed_row_acceptance": f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '[ \\n]') AS w FROM documents),
r AS (SELECT *, doc_id % 3 = 0 AS search, array_to_string(w[1:6], ' ') AS title, array_to_string(w[2:6], ' ') AS answer, array_to_string(w[3:9], ' ') AS quote, CASE WHEN doc_id % 2 = 0 THEN upper(array_to_string(w[1:6], ' - ')) ELSE coalesce(lang, '') || ' of ' || array_to_string(w[1:6], ' ') END AS again FROM d),
v AS (SELECT *, CASE WHEN search THEN again ELSE answer END AS value, lower(trim(coalesce(lang, 'none'))) AS one, trim(lower(substr(text, 1, 2))) AS two FROM r)
SELECT doc_id, CASE WHEN {_BLANK.format('value')} THEN 'invalid_target' WHEN {_BLANK.format('text')} THEN 'evidence_required' WHEN two = '' OR one = two THEN 'dual_approved_reviews_required'
WHEN CASE WHEN search THEN title = '' ELSE quote = '' OR NOT contains(text, quote) END THEN 'review_citations_required' WHEN search AND doc_id % 7 = 0 THEN 'search_gap_required' WHEN search AND text = title || ' again' THEN 'search_citation_must_add_evidence'
WHEN search AND {_KEY.format('value')} = {_KEY.format('title')} THEN 'repeated_search_target' ELSE 'accepted' END AS code FROM v""",
}
