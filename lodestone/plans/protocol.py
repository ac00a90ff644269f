"""Queries of rewards by provenance, protocol checks, selections, synthesis and run comparisons, beside their DuckDB statements where SQL has them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import json as J
from ..operators import datasets as D
from ..operators import rewards as W
from ..operators import rollout as O
from ..operators import selection as S
from ..operators import stats
from ..operators import synthesis as Y
from ..operators import validators as V
from ..session import table
from ..tables import CORPUS, PARAGRAPHS, QUESTIONS, ROLLOUTS, STEPS, corpus, paragraphs, questions, rollouts, steps
from .retrieval import _BASE as _BM25
from .evaluation import _ARMS, _F1, _PAIRS, _SCORED, _arms, _pairs

_STORED = {"v096": W.provenance(), "v098-answer-v1": W.provenance("v098-answer-v1"), "v102-oversearch-zero": W.provenance("v102-oversearch-zero", over_search=0.0), "unknown": '{"Mystery": {}}'}


def reward_versions(spark, sf):
    """Each case scored by four provenances; those that aren't known give null."""
    text = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    case = F.col("case_id")
    rows = _pairs(spark, sf).join(text, "case_id").select(
        "case_id", F.col("gold").alias("answer"), F.col("said").alias("final_answer"), F.when(case % 3 != 0, F.array("text")).otherwise(F.array().cast("array<string>")).alias("observations"),
        F.when(case % 4 == 0, "max_steps").otherwise("answer").alias("reason"), (case % 3).alias("searches"), F.array(F.lit("A"), F.lit("b")).alias("support_titles"),
        F.when(case % 2 == 0, F.array(F.lit("a"), F.lit("B "))).otherwise(F.array(F.lit("a"))).alias("found_titles"), (case % 2).alias("over_steps"), F.lit(0).alias("empty_searches"),
        F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(p).alias("stored")) for v, p in _STORED.items()])).alias("p"),
    )
    return rows.select("case_id", "p.version", F.round(W.total(F.col("p.stored")), 6).alias("total"))


def nested_actions(spark, sf):
    """Outputs with nested objects, some with more behind them and some never closed: where the first object ends, and the action."""
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    raw = F.concat(F.lit('{"action":"search","query":"k'), "k", F.lit('","meta":{"list":[1,"}"],"n":{"x":'), F.col("event_id").cast("string"), F.lit("}}}"))
    raw = F.when(F.col("event_id") % 5 == 0, F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    raw = F.concat(raw, F.when(F.col("event_id") % 3 == 1, " tail").when(F.col("event_id") % 3 == 2, '{"b":1}').otherwise(""))
    p = D.parsed_action(F.col("raw"))
    return e.select("event_id", raw.alias("raw")).select("event_id", J.first_object_end(F.col("raw")).alias("stop"), p["action"].alias("action"), p["argument"].alias("argument"))


def title_keys(spark, sf):
    return corpus(spark, sf).groupBy(J.title_key(F.col("title")).alias("key")).agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first"))


_CANDIDATES = ('{"candidates":[{"answer":"x","evidence_ids":["s1"]}]}', '{"candidates":[{"answer":" ","evidence_ids":[]}]}', '{"candidates":[{"answer":"x","evidence_ids":["s1","s1","s9"]}]}', '{"candidates":"x"}', '{"candidates":[{},{},{},{},{}]}', '{"candidates":[],"more":1}')
_CODES = ("", "candidate_0:answer_invalid,candidate_0:missing_evidence", "candidate_0:evidence_1:duplicate,candidate_0:evidence_2:unknown_or_stale", "candidates_list_required_or_too_long", "candidates_list_required_or_too_long", "unexpected_fields")


def _of(column, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


def candidate_validation(spark, sf):
    raw = table(spark, sf, "benchmark").select("item_id", _of(F.col("item_id"), _CANDIDATES).alias("raw"))
    return raw.select("item_id", F.array_join(V.candidate_errors(F.col("raw"), F.array(F.lit("s1"), F.lit("s2"))), ",").alias("errors"))


_SAY = '{{"id":"{0}","status":"{1}","reason":"because","evidence_ids":[{2}]}}'
_REVIEWS = tuple('{"assessments":[' + ",".join(_SAY.format(*a) for a in two) + '],"information_gap":"","queries":[]}' for two in (
    (("original", "supported", '"s1"'), ("selected", "supported", '"s1"')), (("original", "insufficient", ""), ("selected", "supported", '"s1"')), (("original", "supported", ""), ("selected", "supported", '"s1"')), (("original", "supported", '"s1"'),), (("original", "contradicted", '"s9"'), ("selected", "maybe", '"s1"')),
))


def policy_decisions(spark, sf):
    """Reviews checked, and the answer that they let stand."""
    checked = V.review(F.col("raw"), ("original", "selected"), F.array(F.lit("s1")))
    d = V.decided(F.lit("old"), F.lit("new"), checked)
    return table(spark, sf, "benchmark").select("item_id", _of(F.col("item_id"), _REVIEWS).alias("raw")).select("item_id", F.array_join(checked["errors"], ",").alias("errors"), d["answer"].alias("answer"), d["status"].alias("status"))


def training_row_audit(spark, sf):
    """Trajectories of all documents, some damaged, through the row check."""
    c = corpus(spark, sf).withColumn("n", F.col("id").cast("long"))
    m = Y.trajectory(F.concat(F.lit("What of "), "title", F.lit("?")), F.array(F.struct("id", "title", "text")), F.col("text"))
    c = c.select("id", "n", m.alias("m"), F.when(F.col("n") % 5 == 0, "").otherwise(F.coalesce("text", F.lit(""))).alias("gold"))
    bad = F.struct(F.lit("assistant").alias("role"), F.lit("no").alias("content"))
    damaged = F.when(F.col("n") % 4 == 1, F.slice("m", 1, 4)).when(F.col("n") % 4 == 2, F.concat(F.slice("m", 1, 2), F.array(bad), F.slice("m", 4, 2))).otherwise(F.col("m"))
    return c.select("id", F.array_join(V.training_row_errors(damaged, F.col("gold")), ",").alias("errors"))


def generated_splits(spark, sf):
    one = lambda split: Y.generated_split(corpus(spark, sf), 400, split, "g" + split).select("task_id", "question", F.size("messages").cast("long").alias("messages"), F.md5("gold_answer").alias("gold"))
    return one("train").unionByName(one("test"))


def frozen_case_check(spark, sf):
    """Probe cases of all questions under the frozen conditions, against the set's rules."""
    q = questions(spark, sf)
    return V.frozen_cases(Y.probe_cases(q, "qid"), 120)


def probe_comparison(spark, sf):
    """Two runs over the same cases, by condition: changed actions and queries, changes of exactness and F1."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("task_id"), _of(F.col("o_orderkey"), V.CONDITIONS).alias("condition"), "o_orderpriority")
    signature = F.when(F.col("case_id") % 3 == 0, "answer").otherwise(F.concat(F.lit("search:"), "o_orderpriority"))
    changed = F.col("case_id") % 7 == 0
    em = lambda shift: ((F.col("case_id") + shift) % 5 == 0).cast("int")
    run = lambda s, e: o.select("case_id", "task_id", "condition", s.alias("signature"), e.alias("em"), (e * 0.5 + 0.25).alias("f1"))
    return stats.compared_probes(run(signature, em(F.lit(0))), run(F.when(changed, "search:other").otherwise(signature), em(changed.cast("int"))))


def error_migration(spark, sf):
    """Cases that the first arm got right and the second wrong, by stratum and what the second saw."""
    a, b = _arms(spark, sf)
    j = a.select("case_id", "stratum", F.col("em").alias("x")).join(b.select("case_id", F.col("em").alias("y"), "n"), "case_id").filter("x = 1 AND y = 0")
    kind = F.when(F.col("n") % 3 == 0, "gold_answer_visible_but_wrong").when(F.col("n") % 3 == 1, "retrieval_or_evidence_insufficient").otherwise("protocol_or_termination")
    return j.groupBy("stratum", kind.alias("category")).agg(F.count("*").alias("n"))


def pair_run_aggregate(spark, sf):
    """A run's aggregate by reason, with the rule that supported answers are correct ones, and two order statistics."""
    r = rollouts(spark, sf).withColumn("supported", F.col("correct") & (F.col("cents") % 3 == 0))
    sums = r.groupBy("reason").agg(F.count("*").alias("count"), F.count_if("correct").alias("correct"), F.count_if("supported").alias("supported"), F.round(F.avg("searches"), 6).alias("mean_searches"), F.count_if(F.col("searches") >= 3).alias("search_limit"))
    return sums.withColumn("consistent", F.col("supported") <= F.col("correct")).join(stats.order_statistics(r, "n_steps", "reason"), "reason")


def context_usage(spark, sf):
    """Turns as calls by phase: how many were cut, by how much, and how often."""
    t = table(spark, sf, "conversations").select(F.col("role").alias("phase"), F.length("text").alias("size"))
    g = t.groupBy("phase").agg(F.count("*").alias("calls"), F.count_if(F.col("size") > 500).alias("truncated"), F.sum(F.greatest(F.col("size") - 500, F.lit(0))).alias("dropped"))
    return g.withColumn("truncation_rate", F.round(stats.rate(F.col("truncated"), F.col("calls")), 6))


def state_weights(spark, sf):
    """Weights of an arm's states: arm A plain, arm B four times as much for hard cases, normalised by the fixed 34 of 46."""
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("arm"), (F.col("o_orderpriority") == "1-URGENT").alias("hard"))
    w = F.when(F.col("arm") == "A", 1.0).otherwise(F.when(F.col("hard"), 4.0).otherwise(1.0) * 34.0 / 46.0)
    return o.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.sum(w), 4).alias("weight"))


def label_intersection(spark, sf):
    """Labels that both reviewers (odd and even lines) of an order gave."""
    line = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_returnflag"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))).alias("b"))
    return line.select("l_orderkey", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("labels"))


def uniform_sample(spark, sf):
    return S.uniform_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "us", 100)


def balanced_choice(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_compact(F.array("lang", "source")).alias("labels"))
    return S.balanced(d, "doc_id", "labels", "bc", 100, {"es": 25, "fr": 25, "de": 10})


def quota_disjoint_pools(spark, sf):
    """Per status, orders with no shared supplier, at most three of each priority."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("suppliers"))
    quotas = {p: 3 for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
    return S.quota_disjoint(o.join(line, "o_orderkey"), "o_orderstatus", "o_orderkey", "o_orderkey", "o_orderpriority", "suppliers", quotas)


def sealed_set_replay(spark, sf):
    """The first forty orders of at least two parts that share none, made again among the first 5,000."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_distinct(F.collect_list("l_partkey")).alias("parts"))
    o = table(spark, sf, "orders").select("o_orderkey").join(line, "o_orderkey")
    return S.replayed(o.withColumn("place_in", F.col("o_orderkey")), "o_orderkey", "place_in", "parts", 40, 5000)


def risk_subset(spark, sf):
    """Per nation, the first six of its suppliers whose labels (by key) reach two of each kind."""
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.array_compact(F.array(F.when(F.col("s_suppkey") % 2 == 0, F.lit("even")), F.when(F.col("s_suppkey") % 3 == 0, F.lit("third")))).alias("labels"))
    return S.risk_subsets(s, "s_nationkey", "s_suppkey", "s_suppkey", "labels", 6, {"even": 2, "third": 2})


def nonempty_search(spark, sf):
    """Conversations with a tool message, before the last turn, whose JSON result holds a document with text."""
    t = table(spark, sf, "conversations")
    content = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.array(F.struct(F.substring("text", 1, (F.col("conv_id") % 2 * 9).cast("int")).alias("text"))).alias("result")))).otherwise(F.col("text"))
    m = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), content.alias("content")))).alias("m"))
    docs = lambda c: F.from_json(c, "result array<struct<text:string>>")["result"]
    full = F.exists(F.slice("m", 1, F.greatest(F.size("m") - 1, F.lit(0))), lambda x: (x["role"] == "tool") & F.coalesce(F.exists(docs(x["content"]), lambda d: F.coalesce(d["text"] != "", F.lit(False))), F.lit(False)))
    return m.select("conv_id", full.alias("nonempty"))


def temporal_citations(spark, sf):
    """A conversation's quote (the last word of its third turn) against what stands before and after that turn."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    q = t.filter("turn = 2").select("conv_id", F.element_at(F.split("text", " "), -1).alias("quote"))
    j = t.join(q, "conv_id").groupBy("conv_id").agg(F.max(((F.col("turn") < 2) & F.contains("text", "quote")).cast("int")).alias("before"), F.max(((F.col("turn") > 2) & F.contains("text", "quote")).cast("int")).alias("after"))
    return j.select("conv_id", F.when(F.col("before") == 1, "seen_before").when(F.col("after") == 1, "seen_only_after").otherwise("never_visible").alias("kind"))


def paragraph_ids(spark, sf):
    """Ids of paragraphs by their place and text, and how many distinct review keys (title, text) they have."""
    p = paragraphs(spark, sf).select(F.sha2(F.concat_ws("\u0001", F.lit("p"), "id", F.col("paragraph_index").cast("string"), "text"), 256).alias("pid"), "id", F.struct("title", "text").alias("key"))
    return p.groupBy("id").agg(F.count("*").alias("paragraphs"), F.min("pid").alias("least"), F.count_distinct("key").alias("keys"))


def rl_collection_metrics(spark, sf):
    """Collection quality: shares of reasons, failures, how many actions have whole log-probabilities, tokens and mean advantage."""
    w = Window.partitionBy("group_id")
    r = rollouts(spark, sf).withColumn("adv", F.col("reward") - F.avg("reward").over(w))
    share = lambda c: F.round(F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 6)
    one = r.agg(F.count("*").alias("rollouts"), *[share(F.col("reason") == x).alias(f"{x}_rate") for x in ("answer", "invalid_action", "repeated_action", "max_steps")], share(F.col("cents") < 0).alias("failure_rate"), (F.round(F.avg("adv"), 6) + 0.0).alias("advantage_mean"))
    s = steps(spark, sf).filter("action <> 'other'").select(F.array_repeat(F.lit(1), (F.col("step") % 4).cast("int")).alias("ids"), F.array_repeat(F.lit(-0.5), (F.col("step") % 4 - F.when(F.col("step") % 5 == 0, 1).otherwise(0)).cast("int")).alias("logprobs"))
    whole = (F.size("ids") > 0) & (F.size("ids") == F.size("logprobs"))
    return one.crossJoin(F.broadcast(s.agg(F.round(F.count_if(whole) / F.greatest(F.count("*"), F.lit(1)), 6).alias("logprob_completeness"), F.round(F.avg(F.size("ids")), 6).alias("mean_tokens"))))


def wavefront_rollouts(spark, sf):
    """Episodes of all questions under the script, in waves."""
    r = O.rollouts(questions(spark, sf), corpus(spark, sf), O.Scripted())
    return r.select("qid", "reason", F.size("queries").cast("long").alias("searches"), "answer", F.array_join(F.get("results", F.lit(0)), ",").alias("first"))


def review_pool(spark, sf):
    """Lines of an order as reviews by two reviewers, later lines being retries: approvals and shared labels."""
    line = table(spark, sf, "lineitem")
    r = line.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 2).alias("reviewer"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("attempt"), F.when(F.col("l_quantity") > 10, "approve").otherwise("reject").alias("verdict"), F.array_distinct(F.array("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 3).cast("string"))).alias("labels"))
    return S.review_pool(r).select("id", "approved", F.array_join("labels", ",").alias("labels"))


def smallest_cohort(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_compact(F.array("lang", "source")).alias("labels"))
    found = S.smallest_cohort(d, "doc_id", "labels", "sc", {"es": 8, "fr": 8, "de": 8}, range(20, 60, 4))
    return found if found is not None else d.limit(0).select(F.lit(0).cast("long").alias("place"), "doc_id")


def deficit_cohort(spark, sf):
    """The smallest cohort of orders with 50 customers, enough open and closed ones, few pending, and each priority."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.array("o_orderpriority").alias("labels"))
    gates = {p: 15 for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
    return S.deficit_cohort(o, "o_orderkey", "o_custkey", "o_orderstatus", "labels", "dc", range(60, 121), 50, {"F": 30, "O": 30}, {"P": 20}, gates)


def failure_decomposition(spark, sf):
    """A frozen pool by reason, correctness and searches: counts, and shares of all and of the reason."""
    g = rollouts(spark, sf).groupBy("reason", "correct", F.least("searches", F.lit(3)).alias("searches")).agg(F.count("*").alias("n"))
    share = lambda *by: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6)
    return g.withColumn("of_reason", share("reason")).withColumn("of_all", share(F.lit(1)))


def engineering_acceptance(spark, sf):
    """A ledger of orders against its cases: every rule with its violations."""
    o = table(spark, sf, "orders")
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("calls"), F.count_distinct("l_linenumber").alias("places"))
    j = o.join(n, "o_orderkey", "left")
    return D.constraints(j, has_calls=F.col("calls") > 0, calls_within_budget=F.col("calls") <= 6, no_call_twice=F.col("calls") == F.col("places"), charged=F.col("o_totalprice") > 0, known_state=F.col("o_orderstatus").isin("F", "O", "P"))


def ablation_manifest(spark, sf):
    """Three arms of an experiment over the same tasks, each with a fingerprint of its settings."""
    arms = [("base", 1.0, -0.2), ("no_over_search", 1.0, 0.0), ("half_exact", 0.5, -0.2)]
    config = F.to_json(F.struct(F.col("arm"), F.col("exact"), F.col("over"), F.lit(42).alias("seed"), F.col("tasks")))
    return spark.createDataFrame(arms, "arm string, exact double, over double").crossJoin(F.broadcast(questions(spark, sf).agg(F.count("*").alias("tasks")))).withColumn("fingerprint", F.sha2(config, 256))


def training_ledger_metrics(spark, sf):
    """A ledger of physical updates (orders) by shard (status): logical ones are the last of each customer; retries, mixed groups, histogram."""
    o = table(spark, sf, "orders").select("o_orderstatus", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    last = o.groupBy("o_orderstatus", "o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("p"), F.count("*").alias("tries"), (F.min("o_orderpriority") != F.max("o_orderpriority")).alias("mixed"))
    g = last.groupBy("o_orderstatus").agg(F.sum("tries").alias("physical"), F.count("*").alias("logical"), F.count_if(F.col("tries") > 1).alias("retried"), F.count_if("mixed").alias("mixed"))
    h = last.groupBy("o_orderstatus", "p").agg(F.count("*").alias("c")).groupBy("o_orderstatus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda x: F.concat_ws("=", x["p"], x["c"].cast("string"))), ",").alias("histogram"))
    return g.join(h, "o_orderstatus")


def third_search(spark, sf):
    """Rollouts of at least three searches by reason: how often the third found a document that the first two had not."""
    s = steps(spark, sf).filter("action = 'search'").withColumn("n", F.row_number().over(Window.partitionBy("rollout_id").orderBy("step"))).filter("n <= 3")
    g = s.groupBy("rollout_id").agg(F.collect_set(F.when(F.col("n") < 3, F.col("found"))).alias("had"), F.max(F.when(F.col("n") == 3, F.col("found"))).alias("third"), F.max("n").alias("n")).filter("n = 3")
    new = F.col("third").isNotNull() & ~F.array_contains("had", F.col("third"))
    return g.join(rollouts(spark, sf).select("rollout_id", "reason", "correct"), "rollout_id").groupBy("reason").agg(F.count("*").alias("n"), F.count_if(new).alias("new"), F.count_if(new & F.col("correct")).alias("new_and_correct"))


def packet_record_check(spark, sf):
    """Review packets (orders) against their records (a copy, in which some states, customers or rows differ): the first fault of each."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    r = o.filter("o_orderkey % 11 <> 0").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("customer"), F.when(F.col("o_orderkey") % 7 == 0, "?").otherwise(F.col("o_orderstatus")).alias("state"))
    return V.packet_faults(o, r, "o_orderkey", {"o_custkey": "customer", "o_orderstatus": "state"}).groupBy("fault").agg(F.count("*").alias("n"))


def stage_review_audit(spark, sf):
    """Reviews of all items' packets, faulty by rule, against the stage-bound citation rules."""
    n = F.col("item_id")
    doc = lambda stage, i, text: F.struct(F.lit(stage).alias("stage"), F.lit(i).alias("id"), text.alias("text"))
    packet = F.struct(F.md5("text").alias("packet_sha256"), F.when(n % 3 == 0, "answer").when(n % 3 == 1, "search").otherwise("run").alias("action"), F.array(doc("visible", "v", F.col("text")), doc("retrieved", "v", F.col("text")), doc("retrieved", "w", F.reverse("text"))).alias("docs"))
    cite = lambda stage, i, quote: F.struct(F.lit(stage).alias("stage"), F.lit(i).alias("document_id"), quote.alias("quote"))
    head = F.substring("text", 1, 9)
    cites = F.when(n % 5 == 0, F.array(cite("visible", "v", head))).when(n % 5 == 1, F.array(cite("retrieved", "w", F.substring(F.reverse("text"), 1, 9)))).when(n % 5 == 2, F.array(cite("retrieved", "v", head), cite("visible", "w", head))).when(n % 5 == 3, F.array(cite("visible", "v", F.lit(" ")))).otherwise(F.array().cast("array<struct<stage:string,document_id:string,quote:string>>"))
    review = F.struct(F.when(n % 7 == 0, "stale").otherwise(F.md5("text")).alias("packet_sha256"), F.when(n % 8 == 7, None).otherwise(n % 8 != 6).alias("approved"), F.when(n % 11 == 0, " ").otherwise("good").alias("reason"), F.when(n % 4 == 1, F.array(F.lit("mood"))).otherwise(F.array(F.lit("time"))).alias("risk_labels"), F.when(n % 2 == 0, "date").alias("missing_fact"), cites.alias("citations"))
    return table(spark, sf, "benchmark").select("item_id", review.alias("r"), packet.alias("p")).select("item_id", F.array_join(V.stage_review_errors(F.col("r"), F.col("p")), ",").alias("errors"))


QUERIES = {f.__name__: f for f in (deficit_cohort, sealed_set_replay, stage_review_audit, training_ledger_metrics, third_search, packet_record_check, wavefront_rollouts, review_pool, smallest_cohort, failure_decomposition, engineering_acceptance, ablation_manifest, reward_versions, nested_actions, title_keys, candidate_validation, policy_decisions, training_row_audit, generated_splits, frozen_case_check, probe_comparison, error_migration, pair_run_aggregate, context_usage, state_weights, label_intersection, uniform_sample, balanced_choice, quota_disjoint_pools, risk_subset, nonempty_search, temporal_citations, paragraph_ids, rl_collection_metrics)}

_NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


def _pick(x: str, values) -> str:
    return f"([{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}])[{x} % {len(values)} + 1]"


_BASE = f"WITH {STEPS}, {ROLLOUTS}"
_POOLS = """WITH RECURSIVE l AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY 1), r AS (SELECT o_orderstatus AS s, o_orderpriority AS c, k, e, row_number() OVER (PARTITION BY o_orderstatus ORDER BY k) AS n FROM orders JOIN l ON k = o_orderkey),
walk AS (SELECT s, 0::BIGINT AS n, 0::BIGINT AS k, false AS ok, []::BIGINT[] AS used, []::VARCHAR[] AS cats FROM (SELECT DISTINCT s FROM r) UNION ALL
SELECT w.s, r.n, r.k, len(list_filter(w.cats, lambda x: x = r.c)) < 3 AND NOT list_has_any(w.used, r.e), CASE WHEN len(list_filter(w.cats, lambda x: x = r.c)) < 3 AND NOT list_has_any(w.used, r.e) THEN list_concat(w.used, r.e) ELSE w.used END,
  CASE WHEN len(list_filter(w.cats, lambda x: x = r.c)) < 3 AND NOT list_has_any(w.used, r.e) THEN list_append(w.cats, r.c) ELSE w.cats END FROM walk w JOIN r ON r.s = w.s AND r.n = w.n + 1 WHERE len(w.cats) < 15)
SELECT s AS o_orderstatus, row_number() OVER (PARTITION BY s ORDER BY n) AS place, k AS o_orderkey FROM walk WHERE ok"""
_SEALED = """WITH RECURSIVE r AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS e, row_number() OVER (ORDER BY l_orderkey) AS n FROM lineitem GROUP BY 1),
walk AS (SELECT 0::BIGINT AS n, 0::BIGINT AS k, false AS ok, []::BIGINT[] AS used, 0 AS have UNION ALL
SELECT r.n, r.k, len(r.e) >= 2 AND NOT list_has_any(w.used, r.e), CASE WHEN len(r.e) >= 2 AND NOT list_has_any(w.used, r.e) THEN list_concat(w.used, r.e) ELSE w.used END, w.have + CASE WHEN len(r.e) >= 2 AND NOT list_has_any(w.used, r.e) THEN 1 ELSE 0 END
FROM walk w JOIN r ON r.n = w.n + 1 WHERE w.have < 40 AND w.n < 5000)
SELECT row_number() OVER (ORDER BY n) AS place, k AS o_orderkey, (SELECT sha256(string_agg(k::VARCHAR, chr(10) ORDER BY n)) FROM walk WHERE ok) AS digest FROM walk WHERE ok"""

ORACLES = {
    "quota_disjoint_pools": _POOLS,
    "sealed_set_replay": _SEALED,
    "stage_review_audit": """WITH b AS (SELECT item_id AS n, item_id % 8 < 6 AS ok, item_id % 5 AS c FROM benchmark)
SELECT n AS item_id, concat_ws(',', CASE WHEN n % 7 = 0 THEN 'packet_sha256_mismatch' END, CASE WHEN n % 8 = 7 THEN 'missing_boolean_approval' END, CASE WHEN n % 11 = 0 THEN 'missing_reason' END,
CASE WHEN ok AND n % 4 = 1 THEN 'invalid_risk_labels' END, CASE WHEN ok AND c = 4 THEN 'missing_citations' END, CASE WHEN ok AND c IN (2, 3) THEN 'illegal_verbatim_citation' END,
CASE WHEN ok AND c <> 4 AND n % 3 = 0 AND c <> 0 THEN 'answer_requires_visible_only_citations' END, CASE WHEN ok AND c <> 4 AND n % 3 = 1 AND c <> 1 THEN 'search_requires_new_top3_citation' END,
CASE WHEN ok AND c <> 4 AND n % 3 = 1 AND n % 2 = 1 THEN 'search_requires_missing_fact' END, CASE WHEN ok AND c <> 4 AND n % 3 = 2 THEN 'unknown_action' END) AS errors FROM b""",
    "training_ledger_metrics": """WITH l AS (SELECT o_orderstatus, o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p, count(*) AS tries, min(o_orderpriority) <> max(o_orderpriority) AS mixed FROM orders GROUP BY ALL),
h AS (SELECT o_orderstatus, string_agg(p || '=' || c, ',' ORDER BY p) AS histogram FROM (SELECT o_orderstatus, p, count(*) AS c FROM l GROUP BY ALL) GROUP BY 1)
SELECT l.o_orderstatus, CAST(sum(tries) AS BIGINT) AS physical, count(*) AS logical, count(*) FILTER (WHERE tries > 1) AS retried, count(*) FILTER (WHERE mixed) AS mixed, any_value(histogram) AS histogram FROM l JOIN h USING (o_orderstatus) GROUP BY 1""",
    "third_search": f"""{_BASE}, s AS (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY step) AS n FROM steps WHERE action = 'search'),
g AS (SELECT rollout_id, coalesce(list(found) FILTER (WHERE n < 3 AND found IS NOT NULL), []) AS had, max(found) FILTER (WHERE n = 3) AS third FROM s GROUP BY rollout_id HAVING max(n) >= 3),
j AS (SELECT reason, correct, third IS NOT NULL AND NOT list_contains(had, third) AS new FROM g JOIN rollouts USING (rollout_id)) SELECT reason, count(*) AS n, count(*) FILTER (WHERE new) AS new, count(*) FILTER (WHERE new AND correct) AS new_and_correct FROM j GROUP BY reason""",
    "packet_record_check": """SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'record_missing' WHEN o_orderkey % 5 = 0 THEN 'o_custkey_differs' WHEN o_orderkey % 7 = 0 THEN 'o_orderstatus_differs' ELSE 'ok' END AS fault, count(*) AS n FROM orders GROUP BY 1""",
    "wavefront_rollouts": f"""{_BM25}, f AS (SELECT qid, list(id ORDER BY rank) AS ids FROM ranked WHERE rank <= 3 GROUP BY qid),
t AS (SELECT qid FROM questions)
SELECT q.qid, CASE q.qid % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'repeated_action' WHEN 2 THEN 'invalid_action' ELSE 'max_steps' END AS reason, CASE q.qid % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 5 END::BIGINT AS searches,
CASE WHEN q.qid % 4 = 0 THEN coalesce(ids[1], 'nothing') END AS answer, CASE WHEN q.qid % 4 <> 2 THEN coalesce(array_to_string(ids, ','), '') END AS first FROM questions q LEFT JOIN f ON f.qid = q.qid""",
    "review_pool": """WITH r AS (SELECT l_orderkey AS id, l_linenumber % 2 AS w, arg_max({'v': l_quantity > 10, 'l': list_distinct([l_returnflag, l_linestatus, (l_suppkey % 3)::VARCHAR])}, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS r FROM lineitem GROUP BY ALL),
g AS (SELECT id, count(*) = 2 AND bool_and(r.v) AS approved, list_intersect(arg_min(r.l, w), arg_max(r.l, w)) AS l FROM r GROUP BY id) SELECT id, approved, CASE WHEN approved THEN array_to_string(list_sort(l), ',') END AS labels FROM g""",
    "failure_decomposition": f"{_BASE}, g AS (SELECT reason, correct, least(searches, 3)::BIGINT AS searches, count(*) AS n FROM rollouts GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY reason), 6) AS of_reason, round(n / sum(n) OVER (), 6) AS of_all FROM g",
    "engineering_acceptance": """WITH n AS (SELECT l_orderkey, count(*) AS calls, count(DISTINCT l_linenumber) AS places FROM lineitem GROUP BY 1), j AS (SELECT * FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
v AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT coalesce(calls > 0, false)) AS has_calls, count(*) FILTER (WHERE NOT coalesce(calls <= 6, false)) AS calls_within_budget, count(*) FILTER (WHERE NOT coalesce(calls = places, false)) AS no_call_twice, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) AS charged, count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) AS known_state FROM j)
SELECT rule, n AS rows, violations, violations = 0 AS passed FROM v UNPIVOT (violations FOR rule IN (has_calls, calls_within_budget, no_call_twice, charged, known_state))""",
    "ablation_manifest": """SELECT arm, exact::DOUBLE AS exact, over::DOUBLE AS over, n AS tasks, sha256('{"arm":"' || arm || '","exact":' || e || ',"over":' || o || ',"seed":42,"tasks":' || n || '}') AS fingerprint FROM (SELECT count(*) AS n FROM benchmark), (VALUES ('base', 1.0, -0.2, '1.0', '-0.2'), ('no_over_search', 1.0, 0.0, '1.0', '0.0'), ('half_exact', 0.5, -0.2, '0.5', '-0.2')) a(arm, exact, over, e, o)""",
    "reward_versions": f"""WITH {_PAIRS}, {_SCORED}, f AS (SELECT s.*, text, {_NORM.format('said')} = {_NORM.format('gold')} AS exact, {_NORM.format('said')} AS ns, CASE WHEN array_to_string(b, ' ') IN ('yes', 'no') THEN CAST(a = b AS DOUBLE) ELSE {_F1} END AS f1 FROM s JOIN benchmark ON item_id = case_id),
t AS (SELECT case_id, CASE WHEN exact THEN 1.0 ELSE 0 END + CASE WHEN case_id % 2 = 0 THEN 0.2 ELSE 0.1 END - 0.03 * (case_id % 3) - CASE WHEN case_id % 4 = 0 THEN 0.25 ELSE 0 END - CASE WHEN case_id % 3 = 0 AND NOT exact THEN 0.1 ELSE 0 END - 0.2 * (case_id % 2) AS rest,
  CASE WHEN ns <> '' AND case_id % 3 <> 0 AND contains({_NORM.format('text')}, ns) THEN 0.2 ELSE 0 END AS ev, CASE WHEN ns <> '' AND case_id % 4 <> 0 THEN 0.2 * f1 ELSE 0 END AS fs FROM f)
SELECT case_id, 'v096' AS version, round((rest + ev)::DOUBLE, 6) AS total FROM t UNION ALL SELECT case_id, 'v098-answer-v1', round((rest + fs)::DOUBLE, 6) FROM t UNION ALL SELECT case_id, unnest(['v102-oversearch-zero', 'unknown']), NULL FROM t""",
    "nested_actions": """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events), r AS (SELECT *, length('{"action":"search","query":"k' || k || '","meta":{"list":[1,"}"],"n":{"x":' || event_id || '}}}') AS n FROM e)
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN n END AS stop, CASE WHEN event_id % 15 NOT IN (0, 5, 10) AND event_id % 3 = 0 THEN 'search' ELSE 'invalid' END AS action, CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN 'k' || k END AS argument FROM r""",
    "title_keys": f"WITH {CORPUS} SELECT trim(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS key, count(*) AS n, min(id::BIGINT) AS first FROM corpus GROUP BY 1",
    "candidate_validation": f"SELECT item_id, {_pick('item_id', _CODES)} AS errors FROM benchmark",
    "policy_decisions": f"""SELECT item_id, {_pick('item_id', ('', '', 'original:missing_evidence', 'selected:missing_or_duplicate_assessment', 'original:evidence_0:unknown_or_stale,selected:status_invalid'))} AS errors,
CASE WHEN item_id % 5 = 1 THEN 'new' ELSE 'old' END AS answer, {_pick('item_id', ('preserve_supported_original', 'selected_supported', 'fallback_original', 'preserve_supported_original', 'fallback_original'))} AS status FROM benchmark""",
    "training_row_audit": """SELECT doc_id::VARCHAR AS id, concat_ws(',', CASE WHEN doc_id % 4 = 1 THEN 'five_turns_required,assistant_4:not_json' WHEN doc_id % 4 = 2 THEN 'assistant_2:not_json' END, CASE WHEN doc_id % 5 = 0 OR coalesce(text, '') = '' THEN 'gold_answer_missing' END) AS errors FROM documents""",
    "generated_splits": f"""WITH {CORPUS}, c AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS at, count(*) OVER () AS n FROM corpus), r AS (SELECT split, i, shift FROM range(0, 400) t(i), (VALUES ('train', 0), ('test', 1)) s(split, shift)),
j AS (SELECT r.*, c.title, c.text FROM r JOIN c ON c.at = (r.i + r.shift) % c.n)
SELECT split || '-' || lpad(i::VARCHAR, 5, '0') AS task_id, replace({_pick("CAST('0x' || substr(md5('g' || split || ':' || i), 1, 8) AS BIGINT)", Y.TEMPLATES)}, '{{title}}', title) AS question, 5::BIGINT AS messages, md5(text) AS gold FROM j""",
    "frozen_case_check": "SELECT 4 * count(*) AS cases, 4 * count(*) = 120 AS size_right, true AS conditions_right, count(DISTINCT item_id) = count(*) AS ids_unique FROM benchmark",
    "probe_comparison": f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS t, {_pick('o_orderkey', V.CONDITIONS)} AS condition, CASE WHEN o_orderkey % 3 = 0 THEN 'answer' ELSE 'search:' || o_orderpriority END AS s FROM orders),
r AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'search:other' ELSE s END AS s2, (k % 5 = 0)::INT AS e, ((k + (k % 7 = 0)::INT) % 5 = 0)::INT AS e2 FROM o)
SELECT condition, count(*) AS cases, count(DISTINCT t) AS questions, count(*) FILTER (WHERE s <> s2) AS changed, count(*) FILTER (WHERE s <> s2 AND starts_with(s, 'search:')) AS queries_changed, round(avg(e2 - e), 6) AS em_delta, round(avg((e2 - e) * 0.5::DOUBLE), 6) AS f1_delta, true AS same_cases FROM r GROUP BY condition""",
    "error_migration": f"WITH {_ARMS} SELECT a.stratum, CASE WHEN b.n % 3 = 0 THEN 'gold_answer_visible_but_wrong' WHEN b.n % 3 = 1 THEN 'retrieval_or_evidence_insufficient' ELSE 'protocol_or_termination' END AS category, count(*) AS n FROM a JOIN b ON a.case_id = b.case_id AND a.em = 1 AND b.em = 0 GROUP BY ALL",
    "pair_run_aggregate": f"""{_BASE} SELECT reason, count(*) AS count, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE correct AND cents % 3 = 0) AS supported, round(avg(searches), 6) AS mean_searches, count(*) FILTER (WHERE searches >= 3) AS search_limit, true AS consistent,
list_sort(list(n_steps))[(count(*) - 1) // 2 + 1] AS p50, list_sort(list(n_steps))[CAST(ceil(count(*) * 0.95::DOUBLE) AS BIGINT)] AS p95 FROM rollouts GROUP BY reason""",
    "context_usage": "SELECT role AS phase, count(*) AS calls, count(*) FILTER (WHERE length(text) > 500) AS truncated, CAST(sum(greatest(length(text) - 500, 0)) AS BIGINT) AS dropped, round(count(*) FILTER (WHERE length(text) > 500) / count(*), 6) AS truncation_rate FROM conversations GROUP BY role",
    "state_weights": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS arm, count(*) AS n, round(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END * 34.0::DOUBLE / 46.0::DOUBLE END), 4) AS weight FROM orders GROUP BY 1",
    "label_intersection": "SELECT l_orderkey, array_to_string(list_sort(list_intersect(coalesce(list(DISTINCT l_returnflag) FILTER (WHERE l_linenumber % 2 = 1), []), coalesce(list(DISTINCT l_returnflag) FILTER (WHERE l_linenumber % 2 = 0), []))), ',') AS labels FROM lineitem GROUP BY l_orderkey",
    "uniform_sample": "SELECT doc_id, lang FROM documents ORDER BY sha256('us:' || doc_id), doc_id LIMIT 100",
    "nonempty_search": "WITH t AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, bool_or(role = 'user' AND turn < last AND turn % 3 = 0 AND conv_id % 2 = 1 AND text <> '') AS nonempty FROM t GROUP BY conv_id",
    "temporal_citations": """WITH q AS (SELECT conv_id, string_split(text, ' ')[-1] AS quote FROM conversations WHERE turn = 2), j AS (SELECT conv_id, bool_or(turn < 2 AND contains(text, quote)) AS b, bool_or(turn > 2 AND contains(text, quote)) AS a FROM conversations JOIN q USING (conv_id) GROUP BY conv_id)
SELECT conv_id, CASE WHEN b THEN 'seen_before' WHEN a THEN 'seen_only_after' ELSE 'never_visible' END AS kind FROM j""",
    "paragraph_ids": f"WITH {CORPUS}, {PARAGRAPHS} SELECT id, count(*) AS paragraphs, min(sha256('p' || chr(1) || id || chr(1) || paragraph_index || chr(1) || text)) AS least, count(DISTINCT (title, text)) AS keys FROM paragraphs GROUP BY id",
    "rl_collection_metrics": f"""{_BASE}, a AS (SELECT *, reward - avg(reward) OVER (PARTITION BY group_id) AS adv FROM rollouts), s AS (SELECT round(avg((step % 4 > 0 AND step % 5 <> 0)::INT), 6) AS logprob_completeness, round(avg(step % 4), 6) AS mean_tokens FROM steps WHERE action <> 'other')
SELECT count(*) AS rollouts, round(avg((reason = 'answer')::INT), 6) AS answer_rate, round(avg((reason = 'invalid_action')::INT), 6) AS invalid_action_rate, round(avg((reason = 'repeated_action')::INT), 6) AS repeated_action_rate, round(avg((reason = 'max_steps')::INT), 6) AS max_steps_rate,
round(avg((cents < 0)::INT), 6) AS failure_rate, round(avg(adv), 6) + 0.0 AS advantage_mean, any_value(logprob_completeness) AS logprob_completeness, any_value(mean_tokens) AS mean_tokens FROM a, s""",
}
