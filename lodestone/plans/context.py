"""Queries of context budgets, visible documents and JSON traversal over whole conversations, beside their DuckDB statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import context as C
from ..scratch import written
from ..session import table
from ..tables import STEPS, steps

MOST = 300


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def messages_and_documents(spark, sf):
    """Messages: each conversation's user and system turns, with a system text of its own unless 10 leaves 9.  Documents: an
    assistant turn shows itself, the turn before it and the first one; the last one's id is another's where 3 divides the turn."""
    t = _turns(spark, sf)
    texts = t.filter("role <> 'assistant'").select(F.col("conv_id").alias("case"), F.col("turn").alias("at"), "role", F.col("text").alias("content"))
    added = t.groupBy(F.col("conv_id").alias("case")).agg(F.count_if(F.col("role") == "system").alias("n")).filter("n = 0 AND case % 10 <> 9").select("case", F.lit(-1).cast(t.schema["turn"].dataType).alias("at"), F.lit("system").alias("role"), F.lit("Answer from the documents shown.").alias("content"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    around = t.withColumn("before", F.lag("text").over(w)).withColumn("first", F.first("text").over(w)).filter("role = 'assistant'")
    doc = lambda rank, id_, text: F.struct(F.lit(rank).alias("rank"), F.concat(F.lit("d"), id_.cast("string")).alias("id"), text.alias("text"))
    docs = F.array(doc(1, F.col("turn"), F.col("text")), doc(2, F.col("turn") - 1, F.coalesce("before", F.lit(""))), doc(3, F.when(F.col("turn") % 3 == 0, F.lit(1)).otherwise(F.lit(0)), F.col("first")))
    shown = around.select(F.col("conv_id").alias("case"), F.col("turn").alias("at"), F.explode(docs).alias("d")).select("case", "at", "d.rank", "d.id", F.array_join(F.slice(F.split("d.text", " "), 1, 3), " ").alias("title"), "d.text")
    return texts.unionByName(added), shown


def context_budgets(spark, sf):
    """Every encoding's first stage that fits, over whole conversations."""
    messages, shown = (written(x) for x in messages_and_documents(spark, sf))
    return reduce(lambda a, b: a.unionByName(b), [C.context_budget(messages, shown, MOST, e).withColumn("encoding", F.lit(e)) for e in C.LADDERS])


def traces(spark, sf):
    """A step for each turn, which returns the turn's text as a document; the last one's context is saved in one of seven ways, by conversation."""
    t = _turns(spark, sf)
    way = F.col("conv_id") % 7
    id_ = F.concat(F.lit("d"), (F.col("turn") % 2).cast("string"))
    n = F.length("text")
    pair = lambda a, b: F.array(a.cast("int"), b.cast("int"))
    segments = F.array(pair(F.lit(0), F.floor(n / 3)), pair(F.floor(n / 2), n))
    bad = F.when((way == 3) & (F.col("turn") == 1), F.array(F.array(F.lit(0)))).otherwise(segments)
    change = F.struct(id_.alias("document_id"), F.when((way != 2) | (F.col("turn") != 1), F.col("text")).alias("original_text"), (F.col("turn") % 4 != 3).alias("visible"), (F.col("turn") % 5 == 4).alias("deleted"), bad.alias("visible_segments"))
    listed = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", change.alias("c")))), lambda x: x["c"]).alias("changes"))
    flag = lambda name: F.when(way != 6, F.lit(False)).alias(name)
    empty = F.array().cast(listed.schema["changes"].dataType)
    context = F.struct(
        F.when(way == 1, "table").when(way == 0, "legacy-json").alias("presentation"), F.when(way.isin(4, 6), empty).when(way != 5, F.col("changes")).alias("document_changes"), F.lit("legacy").alias("observation_encoding"), F.lit("none").alias("truncation_stage"),
        F.lit(0).cast("long").alias("documents_deleted"), *[flag(x) for x in C.CERTIFIED],
    )
    return t.join(listed, "conv_id").select(F.col("conv_id").alias("case"), F.col("turn").cast("long").alias("step"), context.alias("context"), F.array(F.struct(id_.alias("id"), "text")).alias("result"))


def last_visible_documents(spark, sf):
    """The documents that each case's last input shows, as digests, or why that isn't known."""
    found = C.last_visible(written(traces(spark, sf)))
    digest = F.md5(F.array_join(F.transform("documents", lambda d: F.concat(d["id"], F.lit(":"), F.array_join(d["texts"], "\x1f"))), "\x1e"))
    return found.select("case", "reason", F.when(F.col("documents").isNotNull(), F.size("documents")).cast("long").alias("documents"), digest.alias("digest"))


def records(spark, sf):
    """(source, raw): each conversation as JSON, turns within pairs of turns, with ids at several depths; every eleventh is torn."""
    t = _turns(spark, sf)
    hex_ = lambda x: F.substring(F.md5(x), 1, 24)
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    own = F.struct(F.when(F.col("role") == "user", F.col("text")).alias("question"), F.concat(F.lit("case-"), hex_(name)).alias("qid"), F.col("turn").alias("id"), F.struct(F.array(F.struct(F.upper(hex_(F.col("role"))).alias("source_id"), F.col("text").alias("note"))).alias("refs")).alias("meta"))
    pairs = t.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", own.alias("o")))), lambda x: x["o"]).alias("turns"))
    whole = pairs.groupBy("conv_id").agg(F.to_json(F.struct(F.concat(F.lit("x"), hex_(F.col("conv_id").cast("string"))).alias("task_id"), F.array_sort(F.collect_list(F.struct("pair", "turns"))).alias("pairs"))).alias("raw"))
    return whole.select(F.col("conv_id").alias("source"), F.when(F.col("conv_id") % 11 == 10, F.substring("raw", F.lit(1), (F.length("raw") - 3))).otherwise(F.col("raw")).alias("raw"))


def exposed_anywhere(spark, sf):
    """Identifiers and questions at any depth of each record."""
    return C.exposed(records(spark, sf))


def document_token_spans(spark, sf, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.json"):
    """Tokens of each shown document's body in its whole input, and whether the body reads back as the document's text."""
    messages, shown = (written(x) for x in messages_and_documents(spark, sf))
    found = C.token_spans(C.rendered(messages, shown), C.byte_pairs(vocabulary))
    text = F.from_json(F.concat(F.lit('{"v":"'), "body", F.lit('"}')), "v string")["v"]
    return found.join(shown.withColumnRenamed("text", "own"), ["case", "at", "rank", "id"]).select("case", "at", "rank", "id", "tokens", "start", "end", "first", "last", (text == F.col("own")).alias("same"))


def user_rewards(spark, sf):
    """Two rewards as a user writes them, over every trajectory: a cost for each search, and a bonus for an answer behind a find."""
    cost = lambda t: -0.03 * int((t["action"] == "search").sum())
    bonus = lambda t: 0.5 if t["action"].iloc[-1] == "answer" and t["found"].iloc[:-1].notna().any() else None
    scored = C.user_rewards(steps(spark, sf).select("rollout_id", "step", "action", "found"), "rollout_id", "step", {"search_cost": cost, "found_answer": bonus})
    return scored.select("rollout_id", F.round("search_cost", 6).alias("search_cost"), "found_answer", F.round("total", 6).alias("total"))


QUERIES = {f.__name__: f for f in (document_token_spans, user_rewards, context_budgets, last_visible_documents, exposed_anywhere)}

_N = lambda x: f"coalesce(len(regexp_extract_all({x}, '[^ \t\n]+')), 0)"
_BODY = lambda cap: "text" if cap is None else f"CASE WHEN length(text) <= {cap} THEN text ELSE regexp_extract(substr(text, 1, {cap}), '^((?s:.*)[.!?])(?:\\s|$)', 1) END"


def _ladder(encoding: str) -> str:
    """Statement of one encoding over ``messages`` and ``docs``."""
    refers, ladder = C.LADDERS[encoding]
    again = "same > 1" if refers else "false"
    stages = []
    for n, step in enumerate(ladder):
        body = _BODY(step.caps[-1])
        for r in range(len(step.caps) - 1, 0, -1):
            body = f"CASE WHEN rank = {r} THEN {_BODY(step.caps[r - 1])} ELSE {body} END"
        beyond = "false" if step.ranks is None else f"rank > {step.ranks}"
        stages.append(f"SELECT \"case\", {n} AS step, rank, id, title, text, {again} AS again, named, {body} AS body, {beyond} AS beyond, {str(step.ranks is None).lower()} AS strict FROM docs")
    conflict = "NOT again AND named > 1" if encoding in ("compact-v2", "compact-v3") else "false"
    return f"""SELECT '{encoding}' AS encoding, * FROM (WITH s AS ({' UNION ALL '.join(stages)}), g AS (SELECT *, text <> '' AND body = '' AS gone FROM s),
per AS (SELECT "case", step, sum(CASE WHEN beyond THEN 0 WHEN again THEN {_N('id')} + {C.REFERENCE_MARKS} WHEN gone THEN 0 ELSE {_N('id')} + {_N('title')} + {_N('body')} + {C.DOCUMENT_MARKS} END) AS docs, sum({_N('id')} + {_N('title')} + {_N('text')} + {C.DOCUMENT_MARKS}) AS whole,
  count(*) FILTER (WHERE NOT again AND NOT gone AND NOT beyond AND length(body) < length(text)) AS trimmed, count(*) FILTER (WHERE again AND NOT beyond) AS refs, count(*) FILTER (WHERE {conflict}) AS conflicts,
  count(*) FILTER (WHERE NOT again AND (gone OR beyond)) AS deleted, count(*) FILTER (WHERE NOT again AND gone AND strict) AS unsatisfied FROM g GROUP BY ALL),
e AS (SELECT c."case", c.fixed, c.mandatory, c.complete, n.step, c.fixed + coalesce(p.docs, 0) AS tokens, coalesce(whole, 0) AS whole, coalesce(trimmed, 0) AS trimmed, coalesce(refs, 0) AS refs, coalesce(conflicts, 0) AS conflicts, coalesce(deleted, 0) AS deleted, coalesce(unsatisfied, 0) AS unsatisfied
  FROM cases c CROSS JOIN (SELECT unnest(range({len(ladder)})) AS step) n LEFT JOIN per p ON p."case" = c."case" AND p.step = n.step),
b AS (SELECT "case", min(step) AS step FROM e WHERE tokens <= {MOST} AND unsatisfied = 0 AND complete AND mandatory <= {MOST} GROUP BY "case")
SELECT e."case", CASE WHEN b.step = 0 THEN 'none' WHEN b.step > 0 THEN 'observation_compacted' END AS stage, CAST(b.step AS BIGINT) AS step, CASE WHEN b.step IS NOT NULL THEN CAST(tokens AS BIGINT) END AS tokens, CAST(fixed + whole AS BIGINT) AS original,
  CASE WHEN b.step IS NOT NULL THEN trimmed END AS trimmed, CASE WHEN b.step IS NOT NULL THEN refs END AS "references", CASE WHEN b.step IS NOT NULL THEN conflicts END AS conflicts, CASE WHEN b.step IS NOT NULL THEN deleted END AS deleted,
  CASE WHEN NOT complete THEN 'no_system_or_question' WHEN mandatory > {MOST} THEN 'mandatory_over_budget' WHEN b.step IS NULL THEN 'history_and_evidence_over_budget' END AS failure FROM e LEFT JOIN b ON b."case" = e."case" WHERE e.step = coalesce(b.step, 0))"""


_CHANGE = "turn % 4 <> 3 AND turn % 5 <> 4"
ORACLES = {
    "context_budgets": f"""WITH texts AS (SELECT conv_id AS "case", turn AS place, role, text AS content FROM conversations WHERE role <> 'assistant'
  UNION ALL SELECT conv_id, -1, 'system', 'Answer from the documents shown.' FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0 AND conv_id % 10 <> 9),
around AS (SELECT *, coalesce(lag(text) OVER w, '') AS before, first_value(text) OVER w AS start FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
shown AS (SELECT conv_id AS "case", turn AS place, unnest([{{'rank': 1, 'id': 'd' || turn, 'text': text}}, {{'rank': 2, 'id': 'd' || (turn - 1), 'text': before}}, {{'rank': 3, 'id': CASE WHEN turn % 3 = 0 THEN 'd1' ELSE 'd0' END, 'text': start}}], recursive := true) FROM around WHERE role = 'assistant'),
docs AS (SELECT *, row_number() OVER (PARTITION BY "case", id, title, text ORDER BY place, rank) AS same, row_number() OVER (PARTITION BY "case", id ORDER BY place, rank) AS named FROM (SELECT *, array_to_string(string_split(text, ' ')[1:3], ' ') AS title FROM shown)),
heads AS (SELECT "case", sum({_N('content')} + {C.MESSAGE_MARKS}) AS texts, arg_min({_N('content')} + {C.MESSAGE_MARKS}, place) FILTER (WHERE role = 'system') + arg_min({_N('content')} + {C.MESSAGE_MARKS}, place) FILTER (WHERE role = 'user') AS mandatory, count(*) FILTER (WHERE role = 'system') > 0 AND count(*) FILTER (WHERE role = 'user') > 0 AS complete FROM texts GROUP BY 1),
cases AS (SELECT h."case", mandatory, complete, texts + {C.MESSAGE_MARKS} * coalesce(t.n, 0) AS fixed FROM heads h LEFT JOIN (SELECT "case", count(DISTINCT place) AS n FROM shown GROUP BY 1) t ON t."case" = h."case")
{' UNION ALL '.join(_ladder(e) for e in C.LADDERS)}""",
    "last_visible_documents": f"""WITH t AS (SELECT conv_id AS "case", conv_id % 7 AS way, turn, text, 'd' || (turn % 2) AS id, max(turn) OVER (PARTITION BY conv_id) AS place FROM conversations),
r AS (SELECT DISTINCT "case", way, CASE way WHEN 1 THEN 'nonlegacy_presentation_not_reconstructed' WHEN 2 THEN CASE WHEN place >= 1 THEN 'visible_document_body_not_saved' ELSE 'saved_document_changes_visible_segments' END
  WHEN 3 THEN CASE WHEN place >= 1 THEN 'invalid_visible_segment_metadata' ELSE 'saved_document_changes_visible_segments' END WHEN 4 THEN 'explicit_legacy_no_truncation_all_prior_tools_retained' WHEN 0 THEN 'saved_document_changes_visible_segments' ELSE 'last_input_visibility_not_certified_by_saved_metadata' END AS reason FROM t),
p AS (SELECT t."case", id, turn, [text[1 : length(text) // 3], text[length(text) // 2 + 1 : length(text)]] AS x FROM t JOIN r USING ("case") WHERE reason LIKE 'saved%' AND {_CHANGE} UNION ALL SELECT t."case", id, turn, [text] FROM t JOIN r USING ("case") WHERE reason LIKE 'explicit%' AND turn < place),
d AS (SELECT "case", id, id || ':' || array_to_string(flatten(list(x ORDER BY turn)), chr(31)) AS s FROM p GROUP BY 1, 2), l AS (SELECT "case", count(*) AS n, md5(string_agg(s, chr(30) ORDER BY id)) AS digest FROM d GROUP BY 1)
SELECT r."case", reason, CASE WHEN reason LIKE 'saved%' OR reason LIKE 'explicit%' THEN coalesce(n, 0) END AS documents, CASE WHEN reason LIKE 'saved%' OR reason LIKE 'explicit%' THEN coalesce(digest, md5('')) END AS digest FROM r LEFT JOIN l ON l."case" = r."case\"""",
    "user_rewards": f"""WITH {STEPS}, r AS (SELECT rollout_id, round(-0.03 * count(*) FILTER (WHERE action = 'search'), 6)::DOUBLE AS search_cost, arg_max(action, step) = 'answer' AS answered, max(step) AS last, min(step) FILTER (WHERE found IS NOT NULL) AS first FROM steps GROUP BY 1)
SELECT rollout_id, search_cost, CASE WHEN answered AND first < last THEN 0.5::DOUBLE END AS found_answer, round(search_cost + CASE WHEN answered AND first < last THEN 0.5 ELSE 0 END, 6)::DOUBLE AS total FROM r""",
    "exposed_anywhere": """WITH p AS (SELECT conv_id, turn // 2 AS pair, list({'question': CASE WHEN role = 'user' THEN text END, 'qid': 'case-' || substr(md5(conv_id || ':' || turn), 1, 24), 'id': turn, 'meta': {'refs': [{'source_id': upper(substr(md5(role), 1, 24)), 'note': text}]}} ORDER BY turn) AS turns FROM conversations GROUP BY ALL),
j AS (SELECT conv_id, to_json({'task_id': 'x' || substr(md5(conv_id::VARCHAR), 1, 24), 'pairs': list({'pair': pair, 'turns': turns})}) AS raw FROM p WHERE conv_id % 11 <> 10 GROUP BY conv_id),
e AS (SELECT conv_id AS source, t.key, json_extract_string(t.value, '$') AS v FROM j, json_tree(j.raw) AS t WHERE t.type = 'VARCHAR')
SELECT DISTINCT source, CASE WHEN key = 'question' THEN 'question' ELSE 'id' END AS kind, CASE WHEN key = 'question' THEN trim(regexp_replace(lower(v), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) ELSE regexp_extract(lower(v), '^(?:[a-z]+[-:])?([0-9a-f]{24})$', 1) END AS value
FROM e WHERE key IN ('question', 'qid', 'source_id', 'task_id', 'id') AND value <> ''""",
}
