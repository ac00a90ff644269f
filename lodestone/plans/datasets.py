"""Queries of dataset engineering and audits, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.structure import with_offsets
from ..operators import datasets as D
from ..operators.retrieval import few
from ..operators.selection import disjoint_rounds
from ..session import table
from ..tables import CORPUS, QUESTIONS, corpus, questions
from .retrieval import tok

_HEX = "list_reduce(list_prepend(0, list_transform(string_split(sha256({x}), ''), lambda d: instr('0123456789abcdef', d) - 1)), lambda a, b: (a * 16 + b) % {n})"


def _mod(x: str, n: int) -> str:
    return _HEX.format(x=x, n=n)


def hash_split_70_15_15(spark, sf):
    return corpus(spark, sf).groupBy(D.split_of(F.col("title")).alias("split")).agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))


def agreed_splits(spark, sf):
    """Users by the split that all their event kinds agree on."""
    e = table(spark, sf, "events").select("user_id", F.concat_ws(":", F.col("event_type"), (F.col("user_id") % 2).cast("string"), F.hour("ts").cast("string")).alias("title"))
    return D.agreed_split(e, "user_id", "title")


def split_leakage_audit(spark, sf):
    """Splits by document against shared first lines."""
    d = table(spark, sf, "documents").select(D.split_of(F.col("doc_id").cast("string")).alias("split"), F.split("text", "\n")[0].alias("line"))
    return D.leakage(d, "line")


def exact_dedup(spark, sf):
    return D.first_by_content(table(spark, sf, "documents"), F.col("text"), "doc_id").select("doc_id", "digest", "copies")


def normalized_dedup(spark, sf):
    return D.first_by_content(table(spark, sf, "documents"), T.token_norm(F.col("text")), "doc_id").select("doc_id", "copies")


def nfkc_question_dedup(spark, sf):
    d = D.nfkc_key(questions(spark, sf).unionByName(questions(spark, sf).select((F.col("qid") + 1000).alias("qid"), F.upper("question").alias("question"))), "qid", "question")
    return d.groupBy("question_key").agg(F.min("qid").alias("qid"), F.count("*").alias("copies"))


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def lineage_join(spark, sf):
    """Every turn joined to its copies anywhere, by the canonical digest of what was said and by whom: copies are counted for
    each digest and named by their first, so a digest that many turns share makes one row, and no pairs."""
    t = _turns(spark, sf).select("conv_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), D.canonical(("role", F.col("role")), ("text", F.col("text"))).alias("digest"))
    own = t.groupBy("conv_id", "digest").agg(F.count("*").alias("c"))
    copies = t.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    repeated = F.col("n") > 1
    return own.join(copies, "digest").groupBy("conv_id").agg(F.sum(F.col("c") * (F.col("n") - 1)).alias("matches"), F.coalesce(F.sum(F.when(repeated, F.col("c"))), F.lit(0)).alias("repeated"), F.min(F.when(repeated, F.col("first"))).alias("first_copy"))


def prefix_link_pairs(spark, sf):
    """Message lists up to each assistant turn of a conversation; links from every list to its proper prefixes."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    lists = _turns(spark, sf).withColumn("messages", F.collect_list(F.struct("role", "text")).over(w)).filter("role = 'assistant'").select("conv_id", F.col("turn").alias("id"), "messages")
    return D.prefix_links(lists, "conv_id")


def manifest_left_join(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), "c_mktsegment")
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderstatus")
    return D.manifest_join(m, r, "task_id", F.col("o_orderstatus")).select("task_id", "c_mktsegment", "status", "answer")


def amendment_overlay(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    fixes = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return D.overlay(base, fixes, "k", "v", "seq")


def vote_reconciliation(spark, sf):
    """Two reviewers (ship status and return flag as votes) of each line: agreed, single-field difference, dispute, one missing."""
    line = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("f1"), F.max("l_linestatus").alias("s1"), F.min("l_returnflag").alias("f2"), F.min("l_linestatus").alias("s2"), F.count("*").alias("n"))
    diff = (F.col("f1") != F.col("f2")).cast("int") + (F.col("s1") != F.col("s2")).cast("int")
    status = F.when(F.col("n") == 1, "one_review").when(diff == 0, "agreed").when(diff == 1, "corrected").otherwise("dispute")
    return line.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


def constraint_report(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return D.constraints(d, id_present=F.col("doc_id").isNotNull(), text_not_blank=F.trim("text") != "", n_chars_right=F.col("n_chars") == F.length("text"), labelled=F.col("quality").isNotNull(), language_known=F.col("lang").isin("en", "fr", "de", "es"), not_toxic=F.coalesce(F.col("toxic"), F.lit(0)) == 0)


def citation_validation(spark, sf):
    """Quotes (an item's words 3 to 8) against the documents cited for them: unknown document, empty quote, not verbatim."""
    b = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 3, F.when(F.col("item_id") % 9 == 0, 0).otherwise(6)), " ").alias("quote"))
    cites = b.select("item_id", "quote", F.explode(F.array((F.col("item_id") * 17 % 1100).cast("long"), F.col("item_id"))).alias("doc_id"))
    docs = table(spark, sf, "documents").select("doc_id", "text").join(few(cites.select("doc_id").distinct()), "doc_id")
    code = F.when(F.col("text").isNull(), "unknown_document").when(F.col("quote") == "", "empty_quote").when(F.contains("text", "quote"), "ok").otherwise("not_verbatim")
    return cites.join(docs, "doc_id", "left").select("item_id", "doc_id", code.alias("code"))


def usage_daily_cost(spark, sf):
    line = table(spark, sf, "lineitem")
    cost = (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(38,4)")
    return line.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag").agg(F.count("*").alias("requests"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"), F.sum(cost).cast("double").alias("cost"))


def ledger_running_budget(spark, sf):
    """Reservations in order against a cap for each customer: running charge, and the first entry beyond it."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    run = F.sum("cents").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return o.select("o_custkey", "o_orderkey", run.alias("charged"), (run > 100_000_000).alias("over"))


def redirect_chain(spark, sf):
    """Redirects between suppliers (each to a smaller one by a rule, some in a cycle) followed to their ends."""
    return D.redirect_ends(table(spark, sf, "supplier").selectExpr("s_suppkey AS src", "CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 1 WHEN s_suppkey % 10 = 8 THEN s_suppkey + 1 WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey - 1 END AS dst").filter("dst IS NOT NULL"))


def chunk_windows(spark, sf):
    c = corpus(spark, sf).select("id", D.chunks(T.tokens(F.col("text"))).alias("c"))
    return c.select("id", F.posexplode("c").alias("chunk", "w")).select("id", F.col("chunk").cast("long").alias("chunk"), "w.start", "w.end")


def evidence_spans_800(spark, sf):
    c = corpus(spark, sf).select("id", "text", D.spans(F.col("text")).alias("s"))
    piece = F.transform("s", lambda x: F.substring(F.col("text"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    return c.select("id", F.size("s").cast("long").alias("spans"), F.array_max(F.transform("s", lambda x: x["end"] - x["start"])).alias("longest"), F.md5(F.array_join(piece, "|")).alias("pieces"))


def block_render_roundtrip(spark, sf):
    """Each hundred documents rendered as blocks behind a nonce that none of them holds, and read back."""
    docs = corpus(spark, sf).withColumn("g", F.floor(F.col("id").cast("long") / 100))
    g = docs.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "title", "text"))).alias("docs")).withColumn("nonce", D.fresh_nonce(F.col("docs")))
    r = g.withColumn("rendered", D.blocks(F.col("docs"), F.col("nonce")))
    return r.select("g", F.size("docs").cast("long").alias("n"), "nonce", F.length("rendered").cast("long").alias("length"), F.md5("rendered").alias("digest"), (D.parse_blocks(F.col("rendered"), F.col("nonce")) == F.col("docs")).alias("same"))


def context_budget_ladder(spark, sf):
    t = _turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.coalesce(F.sum(F.when(F.col("role") == "system", F.length("text"))), F.lit(0)).cast("long").alias("fixed"))
    return D.context_ladder(t.select(F.col("conv_id").alias("id"), F.transform("t", lambda x: x["text"]).alias("documents"), "fixed"), 1500)


def round_robin_balance(spark, sf):
    return D.round_robin(table(spark, sf, "documents"), "lang", "doc_id", "rr", 100)


def bottom_k_per_bucket(spark, sf):
    return D.bottom_k(table(spark, sf, "documents"), "source", "doc_id", "bk", 5)


def quota_cross_fill(spark, sf):
    return D.cross_filled(table(spark, sf, "documents"), F.col("lang") == "es", "doc_id", "q", 60, 40)


def greedy_disjoint_select(spark, sf):
    """Orders accepted in key order if no order of their priority accepted before has a supplier of theirs."""
    own = F.concat_ws("/", "o_orderpriority", F.col("l_suppkey").cast("string"))
    d = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority", "o_orderkey").agg(F.collect_set(own).alias("titles"))
    return disjoint_rounds(d.withColumn("at", F.col("o_orderkey")), "o_orderkey", "at", "titles")


def batch_packing(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("shard"), F.col("l_orderkey").alias("seq")).agg(F.count("*").alias("states"))
    return D.packed(d, "shard", "seq", "states", 20)


def question_ngrams(spark, sf):
    q = questions(spark, sf).select("qid", D.ngrams(T.tokens(F.col("question"))).alias("g"))
    return q.select("qid", F.explode("g").alias("ngram"))


#: Risk labels and the words that show them.
RISKS = {
    "relation": "who|whose|wrote|directed|founded|member|played|parent|spouse|married|born in|sister|brother",
    "time": "year|when|date|century|before|after|during|older|younger|first released|formed in",
    "measurement": "how many|how much|long|length|height|population|area|duration|kilomet|miles?|meters?|years old|percent",
    "scope": "both|among|between|only|all|same|largest|smallest|first|last|in which country|in what country|which state|which city|which county",
}
#: Words of a question that has to be looked at again, and words of a question's class.
PRONOUNS = "this|that|these|those|it|they|he|she|his|her|their"
NOW = "current|currently|now|today|latest|newest"
CATEGORIES = {
    "occupation": "occupation|profession|job|career|vocation",
    "entity_type": "type|kind|category|classification|genre|species|class",
    "affiliation": "member|membership|belong|party|affiliation|group",
    "origin": "nationality|country|origin|native|born|from",
}
_ASK = ["who is the oldest member of", "in which year was", "name both of", "what does he do now at", "tell me", "is the largest"]


def _asked(spark, sf):
    """Questions with an opening by number and a question mark by rule."""
    start = F.element_at(F.array(*[F.lit(x) for x in _ASK]), (F.col("qid") % len(_ASK) + 1).cast("int"))
    return questions(spark, sf).select("qid", F.concat(start, F.lit(" "), "question", F.when(F.col("qid") % 4 == 0, "??").when(F.col("qid") % 5 == 0, "").otherwise("?")).alias("question"))


_ASKED = f"asked AS (SELECT qid, ([{', '.join(repr(x) for x in _ASK)}])[qid % {len(_ASK)} + 1] || ' ' || question || CASE WHEN qid % 4 = 0 THEN '??' WHEN qid % 5 = 0 THEN '' ELSE '?' END AS question FROM questions)"


def risk_tags(spark, sf):
    q = F.lower("question")
    tags = F.array_compact(F.array(*[F.when(F.regexp_like(q, F.lit(rf"(^|[^a-z])({p})([^a-z]|$)")), F.lit(k)) for k, p in RISKS.items()]))
    tags = F.when(F.array_contains(tags, "relation"), tags).otherwise(F.array_append(tags, F.lit("relation")))
    return _asked(spark, sf).select("qid", F.array_join(tags, ",").alias("tags"))


def wording_screen(spark, sf):
    q = F.lower(F.trim("question"))
    word = lambda p: F.regexp_like(q, F.lit(rf"(^|[^a-z])({p})([^a-z]|$)"))
    issue = F.when((F.length(q) < 24) | ~q.endswith("?") | (F.length(F.regexp_replace(q, r"[^?]", "")) != 1), "malformed_question").when(word(PRONOUNS), "unresolved_pronoun_screen").when(word(NOW), "unanchored_time_screen")
    return _asked(spark, sf).select("qid", issue.alias("issue"))


def question_category(spark, sf):
    """The first matching class of a question."""
    q = F.lower("question")
    word = lambda p: F.regexp_like(q, F.lit(rf"(^|[^a-z])({p})([^a-z]|$)"))
    c = F.coalesce(*[F.when(word(p), k) for k, p in CATEGORIES.items()], F.lit("unclassified_common_attribute"))
    return _asked(spark, sf).groupBy(c.alias("category")).agg(F.count("*").alias("n"))


def repeated_reason_invalidates(spark, sf):
    """A reason (first three words) given for several conversations invalidates all turns that give it."""
    t = _turns(spark, sf).filter("role = 'assistant'").select("conv_id", "turn", F.lower(F.array_join(F.slice(F.split("text", " "), 1, 1), " ")).alias("reason"))
    bad = t.groupBy("reason").agg(F.count_distinct("conv_id").alias("questions")).filter("questions > 1")
    return t.join(bad, "reason", "left").select("conv_id", "turn", F.col("questions").isNotNull().alias("invalid"))


def facts_visible(spark, sf):
    """Whether all required facts (role, first word) of a conversation's first two turns show in its later turns' texts."""
    t = _turns(spark, sf).withColumn("w", F.lower(F.split("text", " ")[0]))
    need = t.filter("turn < 2").groupBy("conv_id").agg(F.collect_set("w").alias("need"))
    later = t.filter("turn >= 2").groupBy("conv_id").agg(F.collect_list(F.lower("text")).alias("docs"))
    j = need.join(later, "conv_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    return j.select("conv_id", F.forall("need", lambda n: F.exists("docs", lambda d: F.contains(d, n))).alias("visible"))


def quote_repair(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.regexp_replace(F.expr("substring(text, length(text) div 2 + 1)"), "th", "ht").alias("quote"), F.col("text").alias("body"))
    return D.quote_repairs(b)


def interval_classification(spark, sf):
    """Words of an item against the character span [40, 80): inside, outside or straddling."""
    w = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    e = w.select("item_id", F.posexplode(with_offsets(F.col("w"))).alias("i", "p"))  # a space stands behind each word before
    e = e.select("item_id", F.struct((F.col("p.start") + F.col("i")).alias("a"), (F.col("p.end") + F.col("i")).alias("b")).alias("x"))
    kind = F.when((F.col("x.a") >= 40) & (F.col("x.b") <= 80), "inside").when((F.col("x.b") <= 40) | (F.col("x.a") >= 80), "outside").otherwise("straddling")
    return e.groupBy("item_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def action_parse(spark, sf):
    """Model outputs of many shapes, made from the events, through the strict parser."""
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit('{"action": "search", "query": "k'), k, F.lit('"}'))).when(F.col("event_type") == "click", F.concat(F.lit('```json\n{"action":"answer","answer":" a'), k, F.lit(' "}\n```')))
    raw = raw.when(F.col("event_type") == "signup", F.concat(F.lit('{"action":"search","text":"t'), k, F.lit('"}'))).when(F.col("event_type") == "error", F.concat(F.lit('{"action":"answer","answer":""} '), k)).otherwise(F.lit("not json"))
    p = D.parsed_action(F.col("raw"))
    return table(spark, sf, "events").select("event_type", raw.alias("raw")).select("event_type", p["action"].alias("action"), p["argument"].alias("argument")).groupBy("event_type", "action").agg(F.count("*").alias("n"), F.min("argument").alias("first"), F.count_distinct("argument").alias("arguments"))


def membership_sets(spark, sf):
    """Document ids of labelled, toxic and English documents: intersection, differences and subset flags."""
    d, lab = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id", "full_outer").select(F.col("lang").isNotNull().alias("doc"), F.col("toxic").isNotNull().alias("labelled"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), (F.coalesce("lang", F.lit("")) == "en").alias("en"))
    return j.agg(F.count_if(F.col("doc") & F.col("labelled")).alias("both"), F.count_if(F.col("doc") & ~F.col("labelled")).alias("unlabelled"), F.count_if(~F.col("doc")).alias("unknown"), F.count_if(F.col("toxic") & F.col("en")).alias("toxic_en"), (F.count_if(F.col("labelled") & ~F.col("doc")) == 0).alias("labels_within"))


def longest_text_per_title(spark, sf):
    """The longest text of each normalised title; the first document on ties."""
    c = corpus(spark, sf).select(F.col("id").cast("long").alias("doc_id"), T.token_norm(F.array_join(F.slice(F.split("title", " "), 1, 2), " ")).alias("key"), F.length("text").cast("long").alias("size"))
    return c.groupBy("key").agg(F.max_by("doc_id", F.struct("size", -F.col("doc_id"))).alias("doc_id"), F.max("size").alias("size"), F.count("*").alias("texts"))


def consecutive_line_dedup(spark, sf):
    """Lines of documents without those that repeat the line before, compared where they are: no line is moved."""
    p = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("l"))
    same = F.filter("l", lambda x, j: x == F.get("l", j - 1))
    return p.select("doc_id", F.size("l").cast("long").alias("n"), F.size(same).cast("long").alias("same")).groupBy("doc_id").agg(F.sum("n").alias("lines"), F.sum("same").alias("dropped"))


def label_mask_spans(spark, sf):
    """Assistant-only mask over a conversation's words: how many are kept, and the first kept word's place."""
    t = _turns(spark, sf).select("conv_id", "turn", "role", F.size(F.split("text", " ")).cast("long").alias("n"))
    start = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("start", F.coalesce(start, F.lit(0))).groupBy("conv_id").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("n"))), F.lit(0)).alias("kept"), F.min(F.when(F.col("role") == "assistant", F.col("start"))).alias("first"))


QUERIES = {f.__name__: f for f in (hash_split_70_15_15, agreed_splits, split_leakage_audit, exact_dedup, normalized_dedup, nfkc_question_dedup, lineage_join, prefix_link_pairs, manifest_left_join, amendment_overlay, vote_reconciliation, constraint_report, citation_validation, usage_daily_cost, ledger_running_budget, redirect_chain, chunk_windows, evidence_spans_800, block_render_roundtrip, context_budget_ladder, round_robin_balance, bottom_k_per_bucket, quota_cross_fill, greedy_disjoint_select, batch_packing, question_ngrams, risk_tags, wording_screen, question_category, repeated_reason_invalidates, facts_visible, quote_repair, interval_classification, action_parse, membership_sets, longest_text_per_title, consecutive_line_dedup, label_mask_spans)}


def _split(x: str) -> str:
    return f"CASE WHEN {_mod(x, 100)} < 70 THEN 'train' WHEN {_mod(x, 100)} < 85 THEN 'validation' ELSE 'test' END"


def _word(p: str) -> str:
    return f"regexp_matches(q, '(^|[^a-z])({p})([^a-z]|$)')"


_TITLE2 = tok("array_to_string(string_split(title, ' ')[1:2], ' ')")
ORACLES = {
    "hash_split_70_15_15": f"WITH {CORPUS} SELECT {_split('title')} AS split, count(*) AS n, count(DISTINCT title) AS titles FROM corpus GROUP BY 1",
    "agreed_splits": f"WITH s AS (SELECT user_id, {_split('''event_type || ':' || (user_id % 2) || ':' || hour(ts)''')} AS split FROM events) SELECT user_id, min(split) AS split FROM s GROUP BY user_id HAVING min(split) = max(split)",
    "split_leakage_audit": f"""WITH s AS (SELECT DISTINCT {_split('doc_id::VARCHAR')} AS split, string_split(text, chr(10))[1] AS line FROM documents)
SELECT a.split AS "left", b.split AS "right", count(*) AS shared FROM s a JOIN s b ON a.line = b.line AND a.split < b.split GROUP BY ALL""",
    "exact_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY text",
    "normalized_dedup": f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY array_to_string({tok('text')}, ' ')",
    "lineage_join": """WITH t AS (SELECT conv_id, conv_id || '/' || turn AS id, role, text FROM conversations), c AS (SELECT role, text, count(*) AS n, min(id) AS first FROM t GROUP BY ALL)
SELECT conv_id, CAST(sum(n - 1) AS BIGINT) AS matches, count(*) FILTER (WHERE n > 1) AS repeated, min(first) FILTER (WHERE n > 1) AS first_copy FROM t JOIN c ON t.role IS NOT DISTINCT FROM c.role AND t.text IS NOT DISTINCT FROM c.text GROUP BY conv_id""",
    "prefix_link_pairs": """WITH l AS (SELECT * FROM (SELECT conv_id, turn AS id, role, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM conversations) WHERE role = 'assistant')
SELECT a.conv_id, a.id AS prefix_id, b.id AS full_id, len(a.m)::BIGINT AS n FROM l a JOIN l b ON a.conv_id = b.conv_id AND len(a.m) < len(b.m) AND b.m[1:len(a.m)] = a.m""",
    "manifest_left_join": """WITH g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS k, min(o_orderstatus) AS a FROM orders GROUP BY 1)
SELECT c_custkey AS task_id, c_mktsegment, CASE WHEN n IS NULL THEN 'missing' WHEN k > 1 THEN 'conflict' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status, CASE WHEN k = 1 THEN a END AS answer FROM customer LEFT JOIN g ON c_custkey = o_custkey""",
    "amendment_overlay": """WITH f AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS k, coalesce(v, c_mktsegment) AS v, coalesce(n, 0) AS corrections FROM customer LEFT JOIN f ON c_custkey = o_custkey""",
    "vote_reconciliation": """WITH g AS (SELECT l_orderkey, count(*) AS n, CAST(max(l_returnflag) <> min(l_returnflag) AS INT) + CAST(max(l_linestatus) <> min(l_linestatus) AS INT) AS d FROM lineitem GROUP BY 1)
SELECT CASE WHEN n = 1 THEN 'one_review' WHEN d = 0 THEN 'agreed' WHEN d = 1 THEN 'corrected' ELSE 'dispute' END AS status, count(*) AS n, min(l_orderkey) AS first FROM g GROUP BY 1""",
    "constraint_report": """WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), v AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id IS NULL) AS id_present, count(*) FILTER (WHERE NOT coalesce(trim(text) <> '', false)) AS text_not_blank,
count(*) FILTER (WHERE NOT coalesce(n_chars = length(text), false)) AS n_chars_right, count(*) FILTER (WHERE quality IS NULL) AS labelled, count(*) FILTER (WHERE NOT coalesce(lang IN ('en', 'fr', 'de', 'es'), false)) AS language_known, count(*) FILTER (WHERE coalesce(toxic, 0) <> 0) AS not_toxic FROM d)
SELECT rule, n AS rows, violations, violations = 0 AS passed FROM v UNPIVOT (violations FOR rule IN (id_present, text_not_blank, n_chars_right, labelled, language_known, not_toxic))""",
    "citation_validation": """WITH c AS (SELECT item_id, array_to_string(string_split(text, ' ')[3:CASE WHEN item_id % 9 = 0 THEN 2 ELSE 8 END], ' ') AS quote, unnest([item_id * 17 % 1100, item_id]) AS doc_id FROM benchmark)
SELECT item_id, c.doc_id, CASE WHEN text IS NULL THEN 'unknown_document' WHEN quote = '' THEN 'empty_quote' WHEN contains(text, quote) THEN 'ok' ELSE 'not_verbatim' END AS code FROM c LEFT JOIN documents d ON c.doc_id = d.doc_id""",
    "usage_daily_cost": "SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_returnflag, count(*) AS requests, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS cost FROM lineitem GROUP BY ALL",
    "ledger_running_budget": "SELECT o_custkey, o_orderkey, charged, charged > 100000000 AS over FROM (SELECT o_custkey, o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS charged FROM orders)",
    "redirect_chain": """WITH RECURSIVE r AS (SELECT * FROM (SELECT s_suppkey AS src, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 1 WHEN s_suppkey % 10 = 8 THEN s_suppkey + 1 WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey - 1 END AS dst FROM supplier) WHERE dst IS NOT NULL),
chain AS (SELECT src, dst AS pos, 1 AS hops, [src] AS seen FROM r UNION ALL SELECT c.src, r.dst, c.hops + 1, list_append(c.seen, c.pos) FROM chain c JOIN r ON c.pos = r.src WHERE NOT list_contains(c.seen, c.pos))
SELECT src, arg_max(pos, hops) AS target, max(hops)::BIGINT AS hops, arg_max(list_contains(seen, pos), hops) AS cycle FROM chain GROUP BY src""",
    "chunk_windows": f"""WITH {CORPUS}, t AS (SELECT id, len({tok('text')}) AS n FROM corpus), c AS (SELECT id, n, unnest(range(0, CAST(greatest(0, ceil((n - 220) / 188)) AS BIGINT) + 1)) AS chunk FROM t)
SELECT id, chunk, chunk * 188 AS start, least(n, chunk * 188 + 220) AS "end" FROM c""",
    "evidence_spans_800": f"""WITH {CORPUS}, p AS (SELECT id, k, unnest(string_split(text, chr(10))) AS para, unnest(range(0, k)) AS i FROM (SELECT id, text, len(string_split(text, chr(10))) AS k FROM corpus)),
s AS (SELECT id, i, j, substr(para, CAST(j * 800 + 1 AS BIGINT), 800) AS piece FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(para) / 800) AS BIGINT)))) AS j FROM p)),
g AS (SELECT id, count(*) AS spans, max(length(piece)) AS longest, md5(string_agg(piece, '|' ORDER BY i, j)) AS pieces FROM s GROUP BY id)
SELECT c.id, spans, longest, pieces FROM corpus c LEFT JOIN g ON c.id = g.id""",
    "block_render_roundtrip": rf"""WITH {CORPUS}, d AS (SELECT *, id::BIGINT // 100 AS g FROM corpus),
k AS (SELECT g, string_agg(id, ',' ORDER BY id) AS ids, string_agg(text, chr(10)) AS body FROM d GROUP BY g),
m AS (SELECT g, list_filter(list_transform(range(0, 8), lambda i: substr(md5(ids || ':' || i), 1, 8)), lambda c: NOT contains(body, c))[1] AS nonce FROM k),
r AS (SELECT g, nonce, count(*) AS n, string_agg('<<' || nonce || ' ' || id || '|' || coalesce(replace(replace(replace(replace(title, '\', '\e'), '|', '\p'), '>', '\g'), chr(10), '\n'), '\0') || CASE WHEN text IS NULL THEN '\z' ELSE '' END || '>>' || chr(10) || coalesce(text, '') || chr(10) || '<</' || nonce || '>>' || chr(10), '' ORDER BY id) AS rendered FROM d JOIN m USING (g) GROUP BY g, nonce)
SELECT g, n, nonce, length(rendered) AS length, md5(rendered) AS digest, true AS same FROM r""",
    "context_budget_ladder": """WITH t AS (SELECT conv_id AS id, list(length(text)) AS d, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'system'), 0) AS BIGINT) AS fixed FROM conversations GROUP BY 1),
r AS (SELECT id, fixed, cap, fixed + list_sum(list_transform(d, lambda x: least(x, cap))) AS length FROM t, (SELECT unnest([4000, 2000, 1000, 500, 250, 120, 60]) AS cap)),
b AS (SELECT id, max(cap) FILTER (WHERE length <= 1500) AS cap, max(fixed) AS fixed FROM r GROUP BY id)
SELECT b.id, b.cap::BIGINT AS cap, CAST(r.length AS BIGINT) AS length, CASE WHEN b.cap IS NULL THEN CASE WHEN b.fixed > 1500 THEN 'mandatory_too_long' ELSE 'documents_too_long' END END AS failure FROM b LEFT JOIN r ON b.id = r.id AND b.cap = r.cap""",
    "round_robin_balance": "WITH t AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('rr:' || doc_id), doc_id) AS turn FROM documents), o AS (SELECT row_number() OVER (ORDER BY turn, lang) AS place, lang, doc_id FROM t) SELECT * FROM o WHERE place <= 100",
    "bottom_k_per_bucket": "SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('bk:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 5",
    "quota_cross_fill": """WITH d AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'first' ELSE 'other' END AS bucket, sha256('q:' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, doc_id) AS r FROM d),
s AS (SELECT doc_id, bucket, h, CASE WHEN r <= CASE WHEN bucket = 'first' THEN 60 ELSE 40 END THEN 0 ELSE 1 END::BIGINT AS spare FROM r) SELECT doc_id, bucket, spare FROM s ORDER BY spare, h, doc_id LIMIT 100""",
    "batch_packing": """WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS n FROM (SELECT l_suppkey AS shard, l_orderkey AS seq, count(*) AS states FROM lineitem GROUP BY 1, 2)),
p AS (SELECT shard, seq, states, n, 0::BIGINT AS batch, states AS used FROM g WHERE n = 1
  UNION ALL SELECT g.shard, g.seq, g.states, g.n, CASE WHEN p.used + g.states > 20 THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.used + g.states > 20 THEN g.states ELSE p.used + g.states END FROM p JOIN g ON g.shard = p.shard AND g.n = p.n + 1)
SELECT shard, seq, states, batch FROM p""",
    "question_ngrams": f"WITH {QUESTIONS}, t AS (SELECT qid, {tok('question')} AS t FROM questions) SELECT DISTINCT qid, array_to_string(t[i : i + n - 1], ' ') AS ngram FROM (SELECT qid, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, (SELECT unnest([2, 3, 4]) AS n))",
    "risk_tags": f"WITH {QUESTIONS}, {_ASKED}, q AS (SELECT qid, lower(question) AS q FROM asked), t AS (SELECT qid, list_filter([" + ", ".join(f"CASE WHEN {_word(p)} THEN '{k}' END" for k, p in RISKS.items()) + "], lambda x: x IS NOT NULL) AS t FROM q) SELECT qid, array_to_string(CASE WHEN list_contains(t, 'relation') THEN t ELSE list_append(t, 'relation') END, ',') AS tags FROM t",
    "wording_screen": f"""WITH {QUESTIONS}, {_ASKED}, q AS (SELECT qid, lower(trim(question)) AS q FROM asked) SELECT qid, CASE WHEN length(q) < 24 OR NOT ends_with(q, '?') OR length(regexp_replace(q, '[^?]', '', 'g')) <> 1 THEN 'malformed_question'
WHEN {_word(PRONOUNS)} THEN 'unresolved_pronoun_screen' WHEN {_word(NOW)} THEN 'unanchored_time_screen' END AS issue FROM q""",
    "question_category": f"""WITH {QUESTIONS}, {_ASKED}, q AS (SELECT lower(question) AS q FROM asked) SELECT CASE {' '.join(f"WHEN {_word(p)} THEN '{k}'" for k, p in CATEGORIES.items())} ELSE 'unclassified_common_attribute' END AS category, count(*) AS n FROM q GROUP BY 1""",
    "repeated_reason_invalidates": "WITH t AS (SELECT conv_id, turn, lower(string_split(text, ' ')[1]) AS reason FROM conversations WHERE role = 'assistant'), b AS (SELECT reason FROM t GROUP BY reason HAVING count(DISTINCT conv_id) > 1) SELECT conv_id, turn, reason IN (SELECT reason FROM b) AS invalid FROM t",
    "facts_visible": """WITH t AS (SELECT conv_id, turn, text, lower(string_split(text, ' ')[1]) AS w FROM conversations), n AS (SELECT DISTINCT conv_id, w FROM t WHERE turn < 2)
SELECT n.conv_id, bool_and(EXISTS (SELECT 1 FROM t WHERE t.conv_id = n.conv_id AND t.turn >= 2 AND contains(lower(t.text), n.w))) AS visible FROM n GROUP BY n.conv_id""",
    "interval_classification": """WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), e AS (SELECT item_id, length(array_to_string(w[1:i], ' ')) - length(w[i]) AS a, length(array_to_string(w[1:i], ' ')) AS b FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w))
SELECT item_id, CASE WHEN a >= 40 AND b <= 80 THEN 'inside' WHEN b <= 40 OR a >= 80 THEN 'outside' ELSE 'straddling' END AS kind, count(*) AS n FROM e GROUP BY ALL""",
    "action_parse": """WITH e AS (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT event_type, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'answer' WHEN 'signup' THEN 'search' ELSE 'invalid' END AS action, count(*) AS n,
min(CASE event_type WHEN 'view' THEN 'k' || k WHEN 'click' THEN 'a' || k WHEN 'signup' THEN 't' || k END) AS first, count(DISTINCT CASE WHEN event_type IN ('view', 'click', 'signup') THEN k END) AS arguments FROM e GROUP BY 1, 2""",
    "membership_sets": """SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS both, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(*) FILTER (WHERE d.doc_id IS NULL) AS unknown, count(*) FILTER (WHERE toxic = 1 AND lang = 'en') AS toxic_en, count(*) FILTER (WHERE d.doc_id IS NULL) = 0 AS labels_within FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
    "longest_text_per_title": f"WITH {CORPUS}, c AS (SELECT id::BIGINT AS doc_id, array_to_string({_TITLE2}, ' ') AS key, length(text) AS size FROM corpus) SELECT key, arg_max(doc_id, (size, -doc_id)) AS doc_id, max(size) AS size, count(*) AS texts FROM c GROUP BY key",
    "consecutive_line_dedup": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents), s AS (SELECT doc_id, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY pos) = line, false) AS same FROM l) SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE same) AS dropped FROM s GROUP BY doc_id",
    "label_mask_spans": """WITH t AS (SELECT *, len(string_split(text, ' ')) AS n FROM conversations), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS words, CAST(coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS kept, CAST(min(start) FILTER (WHERE role = 'assistant') AS BIGINT) AS first FROM s GROUP BY conv_id""",
}
