"""Queries of sources, the store, tools and streams, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tools
from ..sources import readers, sinks
from ..session import table
from ..streaming import events as E


def jsonl_torn_tail(spark, sf):
    """Event records as JSON lines by user, some files ending in half a record and some with one broken in the middle."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line_no"), F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    last = F.max("line_no").over(Window.partitionBy("file"))
    torn = F.when((F.col("line_no") == last) & (F.col("file").cast("int") % 3 == 0), F.expr("substring(value, 1, 20)")).when(F.col("line_no") % 101 == 0, F.lit("{broken")).when(F.col("line_no") % 97 == 0, F.lit("  ")).otherwise(F.col("value"))
    p = readers.parse_lines(e.withColumn("value", torn), "event_id long, event_type string, value double")
    return p.groupBy("status").agg(F.count("*").alias("n"), F.count("row.event_id").alias("parsed"), F.sum("row.event_id").alias("ids"))


def tool_messages_corpus(spark, sf):
    """Documents out of tool messages, the last version of each id winning."""
    c = table(spark, sf, "conversations")
    content = F.to_json(F.struct(F.array(F.struct((F.col("turn") * 7 + F.length("text") % 20).cast("string").alias("id"), F.substring("text", 1, 20).alias("title"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text"))).alias("result")))
    m = c.select("conv_id", "turn", F.struct(F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), content.alias("content")).alias("m"))
    r = m.groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]).alias("messages"))
    return readers.latest_documents(r)


def call_ledger_budget(spark, sf):
    """Orders of one status as calls against a budget: what each reservation meets."""
    o = table(spark, sf, "orders")
    calls = o.select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 60).cast("string").alias("key"), F.col("o_orderstatus").alias("stage"), F.round("o_totalprice").alias("reserved"), F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 2)).alias("charged"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return sinks.budget_states(calls, 2.0e7, {"F": 1.2e7, "O": 4.0e6, "P": 9.0e6})


def _words(argument: str):
    return argument.split()[:3]


def tool_table_function(spark, sf):
    """A registered tool joined laterally to the benchmark: the first three words of every text."""
    tools.register(spark, "lodestone_words", _words, replace=True)
    table(spark, sf, "benchmark").selectExpr("item_id", "CASE WHEN item_id % 10 = 3 THEN ' ' ELSE text END AS text").createOrReplaceTempView("lodestone_asked")
    return spark.sql("SELECT q.item_id, t.ok, CAST(t.rank AS BIGINT) AS rank, t.value, t.error FROM lodestone_asked q, LATERAL lodestone_words(q.text) t")


def stream_window_counts(spark, sf):
    return E.drained(E.window_counts(E.event_stream(spark, sf)), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


def session_counts(spark, sf):
    """Sessions of the event log, as a batch over the same operator as the stream's."""
    return E.sessions(table(spark, sf, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def resume_left_anti(spark, sf):
    """Events that a completed-id ledger (all but every ninth) lacks."""
    e = table(spark, sf, "events")
    return E.unseen(e, e.filter("event_id % 9 <> 0")).select("event_id", "user_id")


QUERIES = {f.__name__: f for f in (jsonl_torn_tail, tool_messages_corpus, call_ledger_budget, tool_table_function, stream_window_counts, session_counts, resume_left_anti)}
ORACLES = {
    "jsonl_torn_tail": """WITH s AS (SELECT event_id, CASE WHEN event_id = max(event_id) OVER (PARTITION BY user_id) AND user_id % 3 = 0 THEN 'torn' WHEN event_id % 101 = 0 THEN CASE WHEN event_id = max(event_id) OVER (PARTITION BY user_id) THEN 'torn' ELSE 'corrupt' END WHEN event_id % 97 = 0 THEN 'blank' ELSE 'ok' END AS status FROM events)
SELECT status, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS parsed, CAST(sum(event_id) FILTER (WHERE status = 'ok') AS BIGINT) AS ids FROM s GROUP BY status""",
    "tool_messages_corpus": """SELECT id, title, text FROM (SELECT (turn * 7 + length(text) % 20)::VARCHAR AS id, substr(text, 1, 20) AS title, conv_id || '/' || turn AS text, row_number() OVER (PARTITION BY turn * 7 + length(text) % 20 ORDER BY conv_id DESC, turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n = 1""",
    "call_ledger_budget": """WITH c AS (SELECT o_orderkey AS seq, (o_custkey % 60)::VARCHAR AS key, o_orderstatus AS stage, round(o_totalprice) AS reserved, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 2) END AS charged, o_orderstatus <> 'P' AS done FROM orders),
w AS (SELECT *, bool_or(done) OVER k AS seen_done, bool_or(NOT done) OVER k AS seen_open, coalesce(sum(coalesce(charged, reserved)) OVER s, 0) AS stage_spent, coalesce(sum(coalesce(charged, reserved)) OVER a, 0) AS spent FROM c
  WINDOW k AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY stage ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, key, stage, CASE WHEN seen_done THEN 'cached' WHEN seen_open THEN 'pending' WHEN stage_spent + reserved > CASE stage WHEN 'F' THEN 1.2e7 WHEN 'O' THEN 4.0e6 ELSE 9.0e6 END THEN 'over_stage' WHEN spent + reserved > 2.0e7 THEN 'over_total' ELSE 'accepted' END AS verdict FROM w""",
    "tool_table_function": """SELECT item_id, true AS ok, r AS rank, w[r] AS value, NULL::VARCHAR AS error FROM (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS w, unnest(range(1, 4)) AS r FROM benchmark WHERE item_id % 10 <> 3) WHERE r <= len(w)
UNION ALL SELECT item_id, false, 0, NULL, 'argument must be a non-empty string' FROM benchmark WHERE item_id % 10 = 3""",
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL",
    "session_counts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "resume_left_anti": "SELECT event_id, user_id FROM events WHERE event_id % 9 = 0",
}
