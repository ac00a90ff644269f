"""Adapters from the test tables to the data model of retrieval and trajectories, each beside its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators.retrieval import holding
from .session import spread, table


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents: id, title (the first six words), text."""
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))
    return docs.select("id", F.array_join(F.slice(F.split("text", "[ \n]", 7), 1, 6), " ").alias("title"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions: the whole text of each benchmark item, in one line."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("question"))


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an item's text verbatim: the items are the stated set of passages that every document is scanned for."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    return holding(spread(docs), items).distinct()


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of documents: id, title, paragraph_index, text; blank lines dropped."""
    return corpus(spark, sf).select("id", "title", F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text")).filter("text <> ''").withColumn("paragraph_index", F.col("paragraph_index").cast("long"))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectory steps from events: a rollout is a user's day, a group is a user.

    action: view and click search, purchase answers, error is invalid, signup is a tool's own step; query: the payload's
    k in fives; found: a document number or null.
    """
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    w = Window.partitionBy("rollout_id").orderBy("ts", "event_id")
    action = F.when(F.col("event_type").isin("view", "click"), "search").when(F.col("event_type") == "purchase", "answer").when(F.col("event_type") == "error", "invalid").otherwise("other")
    day = F.date_format("ts", "yyyy-MM-dd")
    return (
        e.withColumn("rollout_id", F.concat_ws(":", F.col("user_id").cast("string"), day))
        .withColumn("step", F.row_number().over(w).cast("long"))
        .select(F.col("user_id").alias("group_id"), "rollout_id", "step", "event_id", action.alias("action"), F.floor(F.col("k") / 5).cast("long").alias("query"), F.when(F.col("k") % 3 != 0, F.col("k") % 7).alias("found"), "value")
    )


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Rollouts: the last step's action is the termination reason, the rounded sum of values the reward, correct if it is even."""
    last = F.max_by("action", "step")
    reason = F.when(last == "answer", "answer").when(last == "invalid", "invalid_action").when(last == "search", "max_steps").otherwise("repeated_action")
    s = steps(spark, sf).groupBy("group_id", "rollout_id").agg(F.count("*").alias("n_steps"), reason.alias("reason"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.sum((F.col("action") == "search").cast("long")).alias("searches"))
    return s.withColumn("correct", (F.col("cents") % 2 == 0) & (F.col("reason") == "answer")).withColumn("reward", F.col("correct").cast("double") - 0.03 * F.col("searches"))


CORPUS = "corpus AS (SELECT doc_id::VARCHAR AS id, array_to_string(regexp_split_to_array(text, '[ \\n]')[1:6], ' ') AS title, text FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS qid, replace(text, chr(10), ' ') AS question FROM benchmark)"
QRELS = "qrels AS (SELECT DISTINCT item_id AS qid, doc_id::VARCHAR AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
PARAGRAPHS = "paragraphs AS (SELECT id, title, p - 1 AS paragraph_index, lines[p] AS text FROM (SELECT id, title, lines, unnest(range(1, len(lines) + 1)) AS p FROM (SELECT id, title, string_split(text, chr(10)) AS lines FROM corpus)) WHERE lines[p] <> '')"
STEPS = """steps AS (SELECT user_id AS group_id, rollout_id, row_number() OVER (PARTITION BY rollout_id ORDER BY ts, event_id) AS step, event_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'search' WHEN event_type = 'purchase' THEN 'answer' WHEN event_type = 'error' THEN 'invalid' ELSE 'other' END AS action,
  CAST(floor(k / 5.0) AS BIGINT) AS query, CASE WHEN k % 3 <> 0 THEN k % 7 END AS found, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS rollout_id FROM events))"""
ROLLOUTS = """rollouts AS (SELECT *, CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 0.03::DOUBLE * searches AS reward FROM (SELECT *, cents % 2 = 0 AND reason = 'answer' AS correct FROM (
  SELECT group_id, rollout_id, count(*) AS n_steps, CASE arg_max(action, step) WHEN 'answer' THEN 'answer' WHEN 'invalid' THEN 'invalid_action' WHEN 'search' THEN 'max_steps' ELSE 'repeated_action' END AS reason,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CASE WHEN action = 'search' THEN 1 ELSE 0 END) AS BIGINT) AS searches FROM steps GROUP BY group_id, rollout_id)))"""
