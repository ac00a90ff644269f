"""Queries of projections, probes, reviews, candidate lists, structure and audits, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import structure as X
from ..functions import text as T
from ..operators import datasets as D
from ..operators import retrieval as R
from ..operators.stats import prefix_sums
from ..scratch import written
from ..session import table
from ..tables import CORPUS, QUESTIONS, ROLLOUTS, STEPS, corpus, questions, rollouts, steps
from .evaluation import _F1, _common, _plain
from .retrieval import _BASE as _BM25
from .retrieval import tok


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def public_trace_projection(spark, sf):
    """Nested steps renamed, flattened and stripped of a volatile field."""
    t = _turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.length("text").alias("chars"), (F.length("text") * 3).alias("latency_ms")).alias("step")))).alias("trace"))
    return t.select("conv_id", F.to_json(F.transform("trace", lambda x: F.struct(x["turn"].alias("n"), x["step"].dropFields("latency_ms").alias("s")))).alias("trace"))


def corpus_validation(spark, sf):
    """An uploaded corpus against its limits: unique ids, no blank text, rows and bytes."""
    c = corpus(spark, sf)
    one = c.agg(F.count("*").alias("documents"), F.count_distinct("id").alias("ids"), F.count_if(F.trim("text") == "").alias("blank"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    return one.withColumn("valid", (F.col("documents") == F.col("ids")) & (F.col("blank") == 0) & (F.col("documents") <= 10_000) & (F.col("bytes") <= 20_000_000))


def dense_index_audit(spark, sf):
    """Vectors of an index: shape, finiteness, unit length, and rows for each document."""
    e = table(spark, sf, "embeddings")
    n = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return e.groupBy("label").agg(F.count("*").alias("chunks"), F.count_if(F.size("embedding") != 64).alias("misshapen"), F.count_if(F.abs(F.sqrt(n) - 1) > 1e-5).alias("not_unit"), F.count_if(F.exists("embedding", lambda x: F.isnan(x))).alias("not_finite"))


def selected_rows(spark, sf):
    """A two-phase fetch: cheap columns choose the rows, whole rows follow by id; a missing one would show."""
    d = table(spark, sf, "documents")
    chosen = d.select("doc_id", "lang", "n_chars").filter("lang = 'fr' AND n_chars > 500")
    got = d.join(chosen.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.md5("text").alias("digest"))
    return chosen.join(got, "doc_id", "left").select("doc_id", "digest", F.col("digest").isNull().alias("missing"))


def replication_diff(spark, sf):
    """Results of two runs by case and retriever: the same list, the same score, or not."""
    line = table(spark, sf, "lineitem")
    run = lambda c: line.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("retriever")).agg(F.array_join(F.array_sort(F.collect_list(F.col(c).cast("string"))), ",").alias("ids"), F.count("*").alias("n"))
    a, b = run("l_linenumber"), run("l_suppkey")
    j = a.join(b.withColumnsRenamed({"ids": "ids2", "n": "n2"}), ["case_id", "retriever"])
    return j.groupBy("retriever").agg(F.count("*").alias("cases"), F.count_if(F.col("ids") == F.col("ids2")).alias("same"), F.count_if(F.col("n") == F.col("n2")).alias("same_size"))


def peer_matches(spark, sf):
    """Rollouts of a group with the same actions and the same found documents as an earlier one."""
    s = steps(spark, sf).groupBy("group_id", "rollout_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))), lambda x: x["action"]), ">").alias("actions"), F.array_join(F.transform(F.array_sort(F.collect_set("found")), lambda x: x.cast("string")), ",").alias("found"))
    first = F.first("rollout_id").over(Window.partitionBy("group_id", "actions", "found").orderBy("rollout_id"))
    p = s.withColumn("peer", first).filter("peer <> rollout_id")
    return p.groupBy("group_id").agg(F.count("*").alias("matches"), F.min("peer").alias("first_peer"))


def cohort_intersection(spark, sf):
    """Users with events of three kinds or more on a day, and the number of such days."""
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count_distinct("event_type").alias("kinds"))
    return d.filter("kinds >= 3").groupBy("user_id").agg(F.count("*").alias("days"))


def journal_summary(spark, sf):
    j = table(spark, sf, "orders")
    return j.groupBy("o_orderstatus").agg(F.count_distinct(F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256)).alias("digests"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


def ledger_phase_summary(spark, sf):
    """Calls by phase, a digest suffix stripped from the phase's name."""
    o = table(spark, sf, "orders").select(F.concat_ws(":", "o_orderpriority", F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("kind"), F.round("o_totalprice").cast("long").alias("charged"))
    return o.groupBy(F.regexp_replace("kind", ":[0-9a-f]{64}$", "").alias("phase")).agg(F.count("*").alias("calls"), F.sum("charged").alias("charged"))


def first_visible_step(spark, sf):
    """The first step of each rollout at which the document 6 was found, and at which any was."""
    return steps(spark, sf).groupBy("rollout_id").agg(F.min(F.when(F.col("found") == 6, F.col("step"))).alias("six"), F.min(F.when(F.col("found").isNotNull(), F.col("step"))).alias("any"))


def excerpt_windows(spark, sf):
    """The best window of 24 tokens of each question's best document."""
    c, q = corpus(spark, sf), questions(spark, sf)
    best = written(R.bm25_search(c, q, 1, boost=False).select("qid", "id"))
    j = c.select("id", T.tokens(F.col("text")).alias("w")).join(R.few(best), "id").join(q.select("qid", F.array_distinct(T.tokens(F.col("question"))).alias("q")), "qid")
    b = X.best_excerpt(F.col("w"), F.col("q"), 24)
    return j.select("qid", "id", b.alias("b")).select("qid", "id", F.col("b.distinct").cast("long").alias("distinct_terms"), F.col("b.all").cast("long").alias("all_terms"), (-F.col("b.at")).cast("long").alias("start"))


def sentence_prefixes(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.length(X.sentence_prefix(F.col("text"), 120)).cast("long").alias("kept"), F.md5(X.sentence_prefix(F.col("text"), 120)).alias("digest"))


def sentence_offsets(spark, sf):
    """Lossless sentence pieces of the documents' texts."""
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), X.with_offsets(X.sentences(F.col("text"))).alias("p"))
    return b.select("item_id", F.posexplode("p").alias("n", "x")).select("item_id", F.col("n").cast("long").alias("n"), "x.start", "x.end")


def proper_name_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.proper_names(F.col("text"))).cast("long").alias("names"), F.get(X.proper_names(F.col("text")), F.lit(0)).alias("first"))


def span_location(spark, sf):
    """A word of an item among the documents of its last digit: the first that holds it, and where.

    Each document is searched by itself and the first hit taken by an aggregate, so no group of texts is collected.
    """
    d = table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("g"), F.array(F.struct(F.col("doc_id").alias("id"), "text")).alias("docs"))
    b = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 10).alias("g"), F.get(F.split("text", " "), F.when(F.col("item_id") % 8 == 0, 10_000).otherwise(5)).alias("value")).withColumn("value", F.coalesce("value", F.lit("")))
    hits = d.join(R.few(b), "g").select("item_id", X.locate(F.col("value"), F.col("docs")).alias("x")).filter("x IS NOT NULL").groupBy("item_id").agg(F.min("x").alias("x"))
    return b.select("item_id").join(hits, "item_id", "left").select("item_id", "x.id", "x.start")


def reasoning_split(spark, sf):
    """Turns wrapped in think pairs of several shapes."""
    raw = F.when(F.col("turn") == 0, F.concat(F.lit("<think>"), F.substring("text", 1, 20), F.lit("</think> "), F.substring("text", 30, 20))).when(F.col("turn") == 1, F.concat(F.lit("<think>a</think><think>"), F.substring("text", 1, 5), F.lit("</think>"))).when(F.col("turn") == 2, F.concat(F.lit("<think>"), F.substring("text", 1, 9))).otherwise(F.substring("text", 1, 12))
    p = X.think_split(F.col("raw"))
    return _turns(spark, sf).select("conv_id", "turn", F.translate(raw, "\n", " ").alias("raw")).select("conv_id", "turn", p["reasoning"].alias("reasoning"), p["action"].alias("action"), p["valid"].alias("valid"))


def masked_keys(spark, sf):
    """Customer names against masks of their neighbours' names."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.concat(F.lit("Customer#0000000"), F.lit("*"), F.substring("c_name", 18, 1)).alias("mask"))
    c = c.withColumn("mask", F.when(F.col("c_custkey") % 7 == 0, F.lit("Customer#********1")).otherwise(F.col("mask")))
    return c.select("c_custkey", X.masked_match(F.col("c_name"), F.col("mask")).alias("match"))


def json_field_order(spark, sf):
    """Audit fields have to stand before the action."""
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("value").alias("audit"), F.col("event_type").alias("action")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("action"), F.col("value").alias("audit")))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_type", X.fields_in_order(raw, "audit", "action").alias("ok")).groupBy("event_type").agg(F.count_if("ok").alias("in_order"), F.count_if(~F.col("ok")).alias("not"))


def local_timestamps(spark, sf):
    """Unix seconds as ISO text at +08:00, by day."""
    e = table(spark, sf, "events").select(F.date_format(F.from_utc_timestamp(F.timestamp_seconds(F.unix_timestamp("ts")), "+08:00"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
    return e.groupBy(F.substring("iso", 1, 10).alias("day")).agg(F.count("*").alias("n"), F.min("iso").alias("first"))


def fake_policy_rollouts(spark, sf):
    """The deterministic policy: search with the question, answer with the best document's text; correct if it holds the question."""
    c, q = corpus(spark, sf), questions(spark, sf)
    top = R.bm25_search(c, q, 1, boost=False).join(c.select("id", F.col("text").alias("answer")), "id")
    return q.join(top, "qid", "left").select("qid", F.coalesce("id", F.lit("none")).alias("source"), F.coalesce(F.contains(F.replace("answer", F.lit("\n"), F.lit(" ")), "question"), F.lit(False)).alias("correct"))


def probe_classification(spark, sf):
    """The last decision of each rollout against the queries before it: answer, new search, repeated search, invalid."""
    s = steps(spark, sf)
    w = Window.partitionBy("rollout_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    last = s.withColumn("history", F.collect_set(F.when(F.col("action") == "search", F.col("query"))).over(w)).withColumn("r", F.row_number().over(Window.partitionBy("rollout_id").orderBy(F.desc("step")))).filter("r = 1")
    kind = F.when(F.col("action") == "answer", "answer").when((F.col("action") == "search") & F.array_contains("history", F.col("query")), "repeated").when(F.col("action") == "search", "search").otherwise("invalid")
    return last.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.size("history").cast("long")).alias("queries_before"))


def step_metric_fallbacks(spark, sf):
    """Token counts of a step: usage if recorded, else the mask's sum, else the ids; case totals only if every step has one."""
    n = F.size(F.split("text", " ")).cast("long")
    got = F.coalesce(F.when(F.col("turn") % 3 == 0, n), F.when(F.col("turn") % 3 == 1, n - 1), F.when(F.col("conv_id") % 4 != 0, F.length("text").cast("long")))
    return _turns(spark, sf).withColumn("tokens", got).groupBy("conv_id").agg(F.count("*").alias("steps"), F.count("tokens").alias("known"), F.when(F.count("tokens") == F.count("*"), F.sum("tokens")).alias("total"))


def visible_documents(spark, sf):
    """Documents that a conversation's messages show: once each with the last text, and every occurrence."""
    t = _turns(spark, sf).select("conv_id", "turn", (F.length("text") % 3).alias("doc"), F.length("text").alias("size"))
    return t.groupBy("conv_id").agg(F.count("*").alias("occurrences"), F.count_distinct("doc").alias("documents"), F.sum("size").cast("long").alias("all_sizes")).join(
        t.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "doc").orderBy(F.desc("turn")))).filter("r = 1").groupBy("conv_id").agg(F.sum("size").cast("long").alias("last_sizes")), "conv_id")


def candidate_merge(spark, sf):
    """Candidate answers of several passes, merged by their normal form in order, at most eight behind the original."""
    b = table(spark, sf, "benchmark").select("item_id", F.split(F.lower("text"), "[ \n]").alias("w"))
    cands = F.concat(F.slice("w", 1, 9), F.slice("w", 4, 9))
    e = b.select("item_id", F.posexplode(cands).alias("pos", "answer")).withColumn("key", F.array_join(T.official_words(F.col("answer")), " ")).filter("key <> ''")
    first = e.groupBy("item_id", "key").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("pos")).cast("long")).filter("place <= 9")
    return ranked.select("item_id", "place", "key")


def option_labels(spark, sf):
    """Labels of the options that equal the gold answer; NONE where there are none."""
    b = table(spark, sf, "benchmark").select("item_id", F.split(F.lower("text"), "[ \n]").alias("w"))
    gold = F.array_join(T.official_words(F.get("w", F.lit(2))), " ")
    labels = F.filter(F.transform(F.slice("w", 1, 6), lambda o, i: F.when(F.array_join(T.official_words(o), " ") == gold, F.char(F.lit(65) + i))), lambda x: x.isNotNull())
    return b.select("item_id", F.when((gold == "") | (F.size(labels) == 0), "NONE").otherwise(F.array_join(labels, ",")).alias("labels"))


def row_acceptance(spark, sf):
    """The first rule that a training row breaks, in rule order."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rule = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "low_quality").when(F.col("toxic") == 1, "toxic").when(F.col("n_chars") < 50, "too_short").when(F.col("n_chars") > 20_000, "too_long").when(~F.col("lang").isin("en", "fr"), "language").otherwise("accepted")
    return d.groupBy(rule.alias("code")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def rl_signal_audit(spark, sf):
    """Audit of groups: advantages of mean 0, finite rewards, components that add up; violations by check."""
    w = Window.partitionBy("group_id")
    r = rollouts(spark, sf).withColumn("adv", (F.col("reward") - F.avg("reward").over(w)) / (F.coalesce(F.stddev_pop("reward").over(w), F.lit(0.0)) + 1e-8))
    g = r.groupBy("group_id").agg(F.avg("adv").alias("m"), F.count_if(F.isnan("reward")).alias("nan"), F.max(F.abs(F.col("reward") - F.col("correct").cast("double") + 0.03 * F.col("searches"))).alias("gap"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.abs("m") > 1e-6).alias("mean_not_zero"), F.count_if(F.col("nan") > 0).alias("not_finite"), F.count_if(F.col("gap") > 1e-8).alias("sums_differ"), F.count_if(F.col("n") < 2).alias("single"))


def environment_fingerprint(spark, sf):
    """Digests of the tables that make an environment."""
    one = lambda t, *c: X.row_sums(table(spark, sf, t), *c).withColumn("part", F.lit(t))
    return one("benchmark", "item_id", "text").unionByName(one("documents", "doc_id", "text")).unionByName(one("nation", "n_nationkey", "n_name")).unionByName(one("region", "r_regionkey", "r_name"))


def context_sweep(spark, sf):
    """Budgets in order until the first that fails its gate, that one included."""
    sizes = _turns(spark, sf).groupBy("conv_id").agg(F.sum(F.length("text")).alias("size"))
    budgets = spark.createDataFrame([(b,) for b in (8000, 4000, 3000, 2000, 1000, 500)], "budget int")
    g = sizes.crossJoin(F.broadcast(budgets)).groupBy("budget").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("size") > F.col("budget")).cast("int")), 6).alias("truncated"))
    g = g.withColumn("passed", F.col("truncated") <= 0.4)
    failed = F.coalesce(F.sum((~F.col("passed")).cast("int")).over(Window.orderBy(F.desc("budget")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("failed", failed).filter("failed = 0").select(F.col("budget").cast("long").alias("budget"), "cases", "truncated", "passed")


def query_history(spark, sf):
    """Distinct queries of each rollout in first-use order; those with fewer than two are left out."""
    first = steps(spark, sf).filter("action = 'search'").groupBy("rollout_id", "query").agg(F.min("step").alias("at"))
    return first.groupBy("rollout_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "query"))), lambda x: x["query"].cast("string")).alias("q")).filter(F.size("q") >= 2).select("rollout_id", F.array_join("q", ",").alias("queries"))


def exposed_identifiers(spark, sf):
    """Hexadecimal identifiers anywhere in nested JSON, collected from its text."""
    e = table(spark, sf, "events").select("user_id", F.to_json(F.struct("event_type", F.struct(F.concat(F.lit("id-"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 24)).alias("ref")).alias("inner"))).alias("raw"))
    ids = e.select("user_id", F.explode(F.regexp_extract_all("raw", F.lit(r'"id-([0-9a-f]{24})"'), 1)).alias("id"))
    return ids.groupBy("user_id").agg(F.count_distinct("id").alias("ids"), F.min("id").alias("least"))


def complementary_actions(spark, sf):
    """Rollouts with exactly one kind of action get the other; the first twenty of each in hash order."""
    kinds = steps(spark, sf).filter("action IN ('search', 'answer')").groupBy("rollout_id").agg(F.collect_set("action").alias("k")).filter(F.size("k") == 1)
    k = kinds.select("rollout_id", F.when(F.get("k", F.lit(0)) == "search", "answer").otherwise("search").alias("needs"))
    return D.bottom_k(k, "needs", "rollout_id", "ca", 20).select("needs", "rollout_id", "rank")


def superseded_decisions(spark, sf):
    """Decisions and re-reviews that name the digest of the line they replace; a stale digest changes nothing."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("line"))
    re = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("line")).otherwise(F.lit("stale")).alias("line"), F.lit("X").alias("new"))
    return o.join(re, ["o_orderkey", "line"], "left").groupBy(F.coalesce("new", "o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


def dual_consensus(spark, sf):
    """Two reviewers of each document (quality label, and length rule with an uncertain band): agreed, disputed, uncertain."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    b = F.when(F.col("n_chars").between(400, 600), "uncertain").when(F.col("n_chars") > 300, "yes").otherwise("no")
    a = F.when(F.col("quality") == 1, "yes").otherwise("no")
    return d.select(a.alias("a"), b.alias("b")).groupBy(F.when(F.col("b") == "uncertain", "uncertain").when(F.col("a") == F.col("b"), F.concat(F.lit("agreed_"), "a")).otherwise("disputed").alias("verdict")).agg(F.count("*").alias("n"))


def paired_change_tags(spark, sf):
    """Tags of what changed between a user's first and last event of a day, several for a pair."""
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("a"), F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("b"), F.count("*").alias("n")).filter("n > 1")
    tags = F.array_compact(F.array(F.when(F.col("a.event_type") != F.col("b.event_type"), F.lit("type")), F.when(F.col("b.value") > F.col("a.value"), F.lit("up")), F.when(F.col("b.value") > 2 * F.col("a.value"), F.lit("doubled"))))
    return e.select(F.explode(F.when(F.size(tags) == 0, F.array(F.lit("none"))).otherwise(tags)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def policy_counterfactual(spark, sf):
    """Four answer policies for each case, scored at once."""
    b = table(spark, sf, "benchmark").select("item_id", F.split(F.lower("text"), "[ \n]").alias("w"))
    gold = F.array_join(F.slice("w", 1, 3), " ")
    arms = F.array(*[F.struct(F.lit(n).alias("policy"), a.alias("answer")) for n, a in (("original", gold), ("shorter", F.array_join(F.slice("w", 1, 2), " ")), ("shifted", F.array_join(F.slice("w", 2, 3), " ")), ("empty", F.lit("")))])
    e = b.select("item_id", gold.alias("gold"), F.explode(arms).alias("p"))
    f1 = T.official_f1(T.official_words(F.col("p.answer")), T.official_words(F.col("gold")))
    return e.groupBy("p.policy").agg(F.count("*").alias("n"), F.round(F.avg(f1), 6).alias("f1"), F.count_if(F.col("p.answer") == F.col("gold")).alias("exact"))


def stratified_clusters(spark, sf):
    """Means over seeds within a condition and question, then over questions, then by condition."""
    line = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_linestatus").agg(F.avg("l_discount").alias("x"))
    return line.groupBy("l_returnflag", "l_suppkey").agg(F.avg("x").alias("x")).groupBy("l_returnflag").agg(F.count("*").alias("questions"), F.round(F.avg("x"), 6).alias("mean"))


def review_batches(spark, sf):
    """Batches of ten by source, in hash order."""
    d = table(spark, sf, "documents").select("source", "doc_id", D.hash_order("rb", F.col("doc_id")).alias("h"))
    return prefix_sums(d, "n", F.lit(1), "h", "source").withColumn("batch", F.floor(F.col("n") / 10)).groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


def support_documents(spark, sf):
    """Titles and sentences zipped into documents: sentences of a title joined, in first-seen order of the titles."""
    p = F.split("text", "\n")
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.arrays_zip(F.transform(p, lambda x: F.substring(x, 1, 1)).alias("title"), p.alias("sentence"))).alias("pos", "z"))
    g = d.groupBy("doc_id", F.col("z.title").alias("title")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("z.sentence").alias("s")))).alias("s"), F.min("pos").alias("first"))
    return g.select("doc_id", "title", F.col("first").cast("long").alias("first"), F.size("s").cast("long").alias("sentences"), F.md5(F.array_join(F.transform("s", lambda x: x["s"]), " ")).alias("digest"))


def terminator_trimming(spark, sf):
    """Token ids (word lengths) without trailing terminators (2 and 3), and how many went."""
    t = _turns(spark, sf).select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w) % 5).alias("ids"))
    keep = F.array_max(F.transform("ids", lambda x, i: F.when(~x.isin(2, 3), i + 1).otherwise(0)))
    return t.select("conv_id", "turn", F.size("ids").cast("long").alias("before"), keep.cast("long").alias("after"))


QUERIES = {f.__name__: f for f in (public_trace_projection, corpus_validation, dense_index_audit, selected_rows, replication_diff, peer_matches, cohort_intersection, journal_summary, ledger_phase_summary, first_visible_step, excerpt_windows, sentence_prefixes, sentence_offsets, proper_name_counts, span_location, reasoning_split, masked_keys, json_field_order, local_timestamps, fake_policy_rollouts, probe_classification, step_metric_fallbacks, visible_documents, candidate_merge, option_labels, row_acceptance, rl_signal_audit, environment_fingerprint, context_sweep, query_history, exposed_identifiers, complementary_actions, superseded_decisions, dual_consensus, paired_change_tags, policy_counterfactual, stratified_clusters, review_batches, support_documents, terminator_trimming)}

_PLAIN = "array_to_string(list_filter(regexp_split_to_array(translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '[ \\t\\n]+'), lambda y: y <> '' AND y NOT IN ('a', 'an', 'the')), ' ')"
_W = "w AS (SELECT item_id, regexp_split_to_array(lower(text), '[ \\n]') AS w FROM benchmark)"
_RB = f"WITH {STEPS}, {ROLLOUTS}"
ORACLES = {
    "public_trace_projection": """SELECT conv_id, '[' || string_agg('{"n":' || turn || ',"s":{"role":"' || role || '","chars":' || length(text) || '}}', ',' ORDER BY turn) || ']' AS trace FROM conversations GROUP BY conv_id""",
    "corpus_validation": "SELECT *, documents = ids AND blank = 0 AND documents <= 10000 AND bytes <= 20000000 AS valid FROM (SELECT count(*) AS documents, count(DISTINCT doc_id) AS ids, count(*) FILTER (WHERE trim(text) = '') AS blank, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents)",
    "dense_index_audit": "SELECT label, count(*) AS chunks, count(*) FILTER (WHERE len(embedding) <> 64) AS misshapen, count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-5) AS not_unit, 0::BIGINT AS not_finite FROM embeddings GROUP BY label",
    "selected_rows": "SELECT doc_id, md5(text) AS digest, false AS missing FROM documents WHERE lang = 'fr' AND n_chars > 500",
    "replication_diff": """WITH g AS (SELECT l_orderkey, l_linestatus AS retriever, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS a, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS b FROM lineitem GROUP BY ALL)
SELECT retriever, count(*) AS cases, count(*) FILTER (WHERE a = b) AS same, count(*) AS same_size FROM g GROUP BY retriever""",
    "peer_matches": f"""WITH {STEPS}, s AS (SELECT group_id, rollout_id, string_agg(action, '>' ORDER BY step) AS actions, array_to_string(list_sort(list_filter(list_distinct(list(found)), lambda x: x IS NOT NULL)), ',') AS found FROM steps GROUP BY ALL),
p AS (SELECT *, min(rollout_id) OVER (PARTITION BY group_id, actions, found) AS peer FROM s) SELECT group_id, count(*) AS matches, min(peer) AS first_peer FROM p WHERE peer <> rollout_id GROUP BY group_id""",
    "cohort_intersection": "SELECT user_id, count(*) AS days FROM (SELECT user_id, ts::DATE AS d FROM events GROUP BY ALL HAVING count(DISTINCT event_type) >= 3) GROUP BY user_id",
    "journal_summary": "SELECT o_orderstatus, count(DISTINCT (o_custkey, o_orderpriority)) AS digests, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY o_orderstatus",
    "ledger_phase_summary": "SELECT o_orderpriority AS phase, count(*) AS calls, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS charged FROM orders GROUP BY 1",
    "first_visible_step": f'WITH {STEPS} SELECT rollout_id, min(step) FILTER (WHERE found = 6) AS six, min(step) FILTER (WHERE found IS NOT NULL) AS "any" FROM steps GROUP BY rollout_id',
    "excerpt_windows": f"""{_BM25}, c AS (SELECT r.qid, r.id, {tok('text')} AS w, list_distinct({tok('question')}) AS q FROM ranked r JOIN corpus USING (id) JOIN questions USING (qid) WHERE rank = 1),
e AS (SELECT qid, id, w, q, unnest(range(0, greatest(0, len(w) - 24) + 1)) AS p FROM c), s AS (SELECT qid, id, p, len(list_intersect(w[p + 1 : p + 24], q)) AS d, len(list_filter(w[p + 1 : p + 24], lambda x: list_contains(q, x))) AS a FROM e)
SELECT qid, id, d::BIGINT AS distinct_terms, a::BIGINT AS all_terms, p AS start FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d DESC, a DESC, p) AS n FROM s) WHERE n = 1""",
    "sentence_prefixes": r"""WITH c AS (SELECT item_id, text, regexp_extract(substr(text, 1, 120), '^((?s:.*)[.!?])(?:\s|$)', 1) AS whole FROM benchmark), p AS (SELECT item_id, CASE WHEN length(text) <= 120 THEN text WHEN whole <> '' THEN whole ELSE substr(text, 1, 120) END AS p FROM c)
SELECT item_id, length(p) AS kept, md5(p) AS digest FROM p""",
    "sentence_offsets": r"""WITH p AS (SELECT doc_id AS item_id, list_filter(string_split(replace(regexp_replace(text, '([.!?])(\s+[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT item_id, unnest(l) AS x, unnest(range(0, len(l))) AS n FROM p)
SELECT item_id, n, CAST(sum(length(x)) OVER w - length(x) AS BIGINT) AS start, CAST(sum(length(x)) OVER w AS BIGINT) AS "end" FROM e WINDOW w AS (PARTITION BY item_id ORDER BY n)""",
    "proper_name_counts": "WITH n AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*') AS n FROM documents) SELECT doc_id, len(list_distinct(n))::BIGINT AS names, n[1] AS first FROM n",
    "span_location": """WITH b AS (SELECT item_id, coalesce((string_split(text, ' '))[CASE WHEN item_id % 8 = 0 THEN 10001 ELSE 6 END], '') AS v FROM benchmark),
h AS (SELECT item_id, doc_id AS id, (strpos(text, v) - 1)::BIGINT AS start, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM b JOIN documents ON doc_id % 10 = item_id % 10 AND v <> '' AND contains(text, v))
SELECT b.item_id, h.id, h.start FROM b LEFT JOIN h ON b.item_id = h.item_id AND n = 1""",
    "reasoning_split": """WITH t AS (SELECT conv_id, turn, translate(text, chr(10), ' ') AS x FROM conversations) SELECT conv_id, turn, CASE WHEN turn = 0 THEN trim(substr(x, 1, 20)) END AS reasoning, CASE WHEN turn = 0 THEN trim(substr(x, 30, 20)) WHEN turn > 2 THEN trim(substr(x, 1, 12)) END AS action, turn = 0 OR turn > 2 AS valid FROM t""",
    "masked_keys": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN right(c_name, 1) = '1' ELSE substr(c_name, 10, 7) = '0000000' END AS match FROM customer""",
    "json_field_order": 'SELECT event_type, count(*) FILTER (WHERE event_id % 3 = 0) AS in_order, count(*) FILTER (WHERE event_id % 3 <> 0) AS "not" FROM events GROUP BY event_type',
    "local_timestamps": "WITH e AS (SELECT strftime(date_trunc('second', ts) + INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%S') AS iso FROM events) SELECT left(iso, 10) AS day, count(*) AS n, min(iso) AS first FROM e GROUP BY 1",
    "fake_policy_rollouts": f"""{_BM25}, t AS (SELECT r.qid, r.id, text AS answer FROM ranked r JOIN corpus USING (id) WHERE rank = 1)
SELECT q.qid, coalesce(id, 'none') AS source, coalesce(contains(replace(answer, chr(10), ' '), question), false) AS correct FROM questions q LEFT JOIN t ON q.qid = t.qid""",
    "probe_classification": f"""WITH {STEPS}, l AS (SELECT rollout_id, arg_max(action, step) AS action, arg_max(query, step) AS query, max(step) AS m FROM steps GROUP BY rollout_id),
h AS (SELECT l.rollout_id, l.action, count(DISTINCT s.query) AS n, coalesce(bool_or(s.query = l.query), false) AS seen FROM l LEFT JOIN steps s ON s.rollout_id = l.rollout_id AND s.step < m AND s.action = 'search' GROUP BY ALL)
SELECT CASE WHEN action = 'answer' THEN 'answer' WHEN action = 'search' AND seen THEN 'repeated' WHEN action = 'search' THEN 'search' ELSE 'invalid' END AS kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS queries_before FROM h GROUP BY 1""",
    "step_metric_fallbacks": """WITH t AS (SELECT conv_id, len(string_split(text, ' ')) AS n, turn, length(text) AS c FROM conversations), g AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN n WHEN turn % 3 = 1 THEN n - 1 WHEN conv_id % 4 <> 0 THEN c END AS tokens FROM t)
SELECT conv_id, count(*) AS steps, count(tokens) AS known, CASE WHEN count(tokens) = count(*) THEN CAST(sum(tokens) AS BIGINT) END AS total FROM g GROUP BY conv_id""",
    "visible_documents": """WITH t AS (SELECT conv_id, turn, length(text) % 3 AS doc, length(text) AS size FROM conversations), l AS (SELECT conv_id, CAST(sum(size) AS BIGINT) AS last_sizes FROM (SELECT conv_id, doc, arg_max(size, turn) AS size FROM t GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, count(*) AS occurrences, count(DISTINCT doc) AS documents, CAST(sum(size) AS BIGINT) AS all_sizes, any_value(last_sizes) AS last_sizes FROM t JOIN l USING (conv_id) GROUP BY conv_id""",
    "candidate_merge": f"""WITH {_W}, e AS (SELECT item_id, unnest(list_concat(w[1:9], w[4:12])) AS a, generate_subscripts(list_concat(w[1:9], w[4:12]), 1) AS pos FROM w), k AS (SELECT item_id, key, min(pos) AS pos FROM (SELECT item_id, {_PLAIN.format(x='a')} AS key, pos FROM e) WHERE key <> '' GROUP BY 1, 2)
SELECT item_id, place, key FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS place FROM k) WHERE place <= 9""",
    "option_labels": f"""WITH {_W}, e AS (SELECT item_id, {_PLAIN.format(x='w[3]')} AS gold, unnest(w[1:6]) AS o, generate_subscripts(w[1:6], 1) AS i FROM w)
SELECT item_id, coalesce(string_agg(CASE WHEN gold <> '' AND {_PLAIN.format(x='o')} = gold THEN chr(CAST(64 + i AS INTEGER)) END, ',' ORDER BY i), 'NONE') AS labels FROM e GROUP BY item_id""",
    "row_acceptance": """SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'low_quality' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 50 THEN 'too_short' WHEN n_chars > 20000 THEN 'too_long' WHEN lang NOT IN ('en', 'fr') THEN 'language' ELSE 'accepted' END AS code, count(*) AS n, min(d.doc_id) AS first
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
    "rl_signal_audit": f"""{_RB}, a AS (SELECT group_id, reward, correct, searches, (reward - avg(reward) OVER w) / (coalesce(stddev_pop(reward) OVER w, 0) + 1e-8) AS adv FROM rollouts WINDOW w AS (PARTITION BY group_id)),
g AS (SELECT group_id, avg(adv) AS m, count(*) AS n FROM a GROUP BY group_id) SELECT count(*) AS groups, count(*) FILTER (WHERE abs(m) > 1e-6) AS mean_not_zero, 0::BIGINT AS not_finite, 0::BIGINT AS sums_differ, count(*) FILTER (WHERE n < 2) AS single FROM g""",
    "environment_fingerprint": " UNION ALL ".join(f"""SELECT '{t}' AS part, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) || '-' || count(*) AS fingerprint, count(*) AS rows
FROM (SELECT sha256({k}::VARCHAR || chr(1) || coalesce({c}, chr(2))) AS h FROM {t})""" for t, k, c in (("benchmark", "item_id", "text"), ("documents", "doc_id", "text"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))),
    "context_sweep": """WITH s AS (SELECT conv_id, sum(length(text)) AS size FROM conversations GROUP BY 1), g AS (SELECT budget::BIGINT AS budget, count(*) AS cases, round(avg(CAST(size > budget AS INT)), 6) AS truncated FROM s, (SELECT unnest([8000, 4000, 3000, 2000, 1000, 500]) AS budget) GROUP BY 1),
p AS (SELECT *, truncated <= 0.4 AS passed, coalesce(sum(CASE WHEN truncated <= 0.4 THEN 0 ELSE 1 END) OVER (ORDER BY budget DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM g) SELECT budget, cases, truncated, passed FROM p WHERE f = 0""",
    "query_history": f"WITH {STEPS}, f AS (SELECT rollout_id, query, min(step) AS s FROM steps WHERE action = 'search' GROUP BY ALL) SELECT rollout_id, string_agg(query::VARCHAR, ',' ORDER BY s) AS queries FROM f GROUP BY rollout_id HAVING count(*) >= 2",
    "exposed_identifiers": "SELECT user_id, count(DISTINCT substr(md5(event_id::VARCHAR), 1, 24)) AS ids, min(substr(md5(event_id::VARCHAR), 1, 24)) AS least FROM events GROUP BY user_id",
    "complementary_actions": f"""WITH {STEPS}, k AS (SELECT rollout_id, CASE WHEN min(action) = 'search' THEN 'answer' ELSE 'search' END AS needs FROM steps WHERE action IN ('search', 'answer') GROUP BY rollout_id HAVING min(action) = max(action))
SELECT needs, rollout_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY needs ORDER BY sha256('ca:' || rollout_id), rollout_id) AS rank FROM k) WHERE rank <= 20""",
    "superseded_decisions": "SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1",
    "dual_consensus": """WITH v AS (SELECT CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS a, CASE WHEN n_chars BETWEEN 400 AND 600 THEN 'uncertain' WHEN n_chars > 300 THEN 'yes' ELSE 'no' END AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT CASE WHEN b = 'uncertain' THEN 'uncertain' WHEN a = b THEN 'agreed_' || a ELSE 'disputed' END AS verdict, count(*) AS n FROM v GROUP BY 1""",
    "paired_change_tags": """WITH p AS (SELECT arg_min(event_type, (ts, event_id)) AS t1, arg_max(event_type, (ts, event_id)) AS t2, arg_min(value, (ts, event_id)) AS v1, arg_max(value, (ts, event_id)) AS v2 FROM events GROUP BY user_id, ts::DATE HAVING count(*) > 1)
SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN t1 = t2 AND v2 <= v1 THEN ['none'] ELSE list_filter([CASE WHEN t1 <> t2 THEN 'type' END, CASE WHEN v2 > v1 THEN 'up' END, CASE WHEN v2 > 2 * v1 THEN 'doubled' END], lambda x: x IS NOT NULL) END) AS tag FROM p) GROUP BY tag""",
    "policy_counterfactual": f"""WITH {_W}, g AS (SELECT array_to_string(w[1:3], ' ') AS gold, unnest([{{'p': 'original', 'a': array_to_string(w[1:3], ' ')}}, {{'p': 'shorter', 'a': array_to_string(w[1:2], ' ')}}, {{'p': 'shifted', 'a': array_to_string(w[2:4], ' ')}}, {{'p': 'empty', 'a': ''}}]) AS x FROM w),
s AS (SELECT x.p AS policy, x.a AS said, gold, {_plain('x.a')} AS a, {_plain('gold')} AS b FROM g), c AS (SELECT *, coalesce({_common('a', 'b')}, 0)::DOUBLE AS c FROM s)
SELECT policy, count(*) AS n, round(avg(CASE WHEN a <> b AND (array_to_string(a, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(b, ' ') IN ('yes', 'no', 'noanswer')) THEN 0.0 WHEN c = 0 THEN 0.0 ELSE {_F1} END), 6) AS f1, count(*) FILTER (WHERE said = gold) AS exact FROM c GROUP BY policy""",
    "stratified_clusters": "SELECT l_returnflag, count(*) AS questions, round(avg(x), 6) AS mean FROM (SELECT l_returnflag, l_suppkey, avg(x) AS x FROM (SELECT l_returnflag, l_suppkey, l_linestatus, avg(l_discount) AS x FROM lineitem GROUP BY ALL) GROUP BY ALL) GROUP BY l_returnflag",
    "review_batches": "SELECT source, batch, count(*) AS n, min(doc_id) AS least FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY sha256('rb:' || doc_id), doc_id) - 1) // 10 AS batch FROM documents) GROUP BY ALL",
    "support_documents": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM l)
SELECT doc_id, substr(s, 1, 1) AS title, min(pos) AS first, count(*) AS sentences, md5(string_agg(s, ' ' ORDER BY pos)) AS digest FROM e GROUP BY doc_id, substr(s, 1, 1)""",
    "terminator_trimming": """WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w) % 5) AS ids FROM conversations)
SELECT conv_id, turn, len(ids)::BIGINT AS before, coalesce(list_max(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ids[i] NOT IN (2, 3) THEN i ELSE 0 END)), 0)::BIGINT AS after FROM t""",
}
