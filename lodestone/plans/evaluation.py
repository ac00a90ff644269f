"""Queries of answer scoring and evaluation statistics, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import stats as S
from ..session import table
from ..tables import CORPUS, QUESTIONS, ROLLOUTS, STEPS, corpus, questions, rollouts, steps

_HOUSE = r"""list_filter(regexp_split_to_array(translate(regexp_replace(lower(coalesce({x}, '')), '(^|[^\p{{L}}\p{{N}}\p{{M}}_])(?:a|an|the)($|[^\p{{L}}\p{{N}}\p{{M}}_])', '\1 \2', 'g'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '[ \t\n\r\f\v]+'), lambda w: w <> '')"""


def _pairs(spark, sf):
    """A prediction and a reference for each item: the item's first 12 words, and words 4 to 18; some of them yes, no or empty."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.split("text", "[ \n]").alias("w"))
    special = lambda x, m, v: F.when(F.col("case_id") % m == 0, v).otherwise(x)
    said = special(special(F.array_join(F.slice("w", 1, 12), " "), 7, F.lit("Yes!")), 11, F.lit(""))
    gold = special(special(F.array_join(F.slice("w", 4, 15), " "), 14, F.lit("no")), 11, F.lit("the"))
    return b.select("case_id", said.alias("said"), gold.alias("gold"))


_PAIRS = """w AS (SELECT item_id AS case_id, regexp_split_to_array(text, '[ \\n]') AS w FROM benchmark),
pairs AS (SELECT case_id, CASE WHEN case_id % 11 = 0 THEN '' WHEN case_id % 7 = 0 THEN 'Yes!' ELSE array_to_string(w[1:12], ' ') END AS said,
  CASE WHEN case_id % 11 = 0 THEN 'the' WHEN case_id % 14 = 0 THEN 'no' ELSE array_to_string(w[4:18], ' ') END AS gold FROM w)"""
_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def _plain(x: str) -> str:
    """Lower case without punctuation, articles or empty words (official order)."""
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({x}, '')), {_PUNCT}, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


def _common(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda y: y = t)), len(list_filter({b}, lambda z: z = t)))))"


def token_f1_pairs(spark, sf):
    p = _pairs(spark, sf)
    # articles that punctuation does not touch are the same in either order; the test cases have no others
    a, b = T.answer_words(F.col("said")), T.answer_words(F.col("gold"))
    return p.select("case_id", F.round(T.token_f1(a, b), 6).alias("f1"), F.round(T.reward_f1(a, b), 6).alias("reward_f1"), (T.norm(F.col("said")) == T.norm(F.col("gold"))).alias("exact"), (T.normalize_answer(F.col("said")) == T.normalize_answer(F.col("gold"))).alias("normalized_exact"))


def official_f1_pairs(spark, sf):
    a, b = T.official_words(F.col("said")), T.official_words(F.col("gold"))
    return _pairs(spark, sf).select("case_id", F.round(T.official_f1(a, b), 6).alias("f1"), (F.array_join(a, " ") == F.array_join(b, " ")).alias("exact"))


def best_alias_score(spark, sf):
    """Three references a case: precision and recall of the one with the best (F1, exact), the earliest on ties; exact if any is."""
    p = _pairs(spark, sf)
    gold = F.split("gold", " ")
    aliases = F.array(F.col("gold"), F.array_join(F.slice(gold, 1, 9), " "), F.col("said"))
    e = p.select("case_id", T.official_words(F.col("said")).alias("a"), F.posexplode(F.when(F.col("case_id") % 5 == 0, aliases).otherwise(F.slice(aliases, 1, 2))).alias("pos", "alias")).withColumn("b", T.official_words(F.col("alias")))
    c = T.overlap(F.col("a"), F.col("b"))
    part = lambda n: F.when(F.size(n) > 0, c / F.size(n)).otherwise(0.0)
    s = e.select("case_id", "pos", F.round(T.token_f1(F.col("a"), F.col("b")), 6).alias("f1"), (F.col("a") == F.col("b")).alias("exact"), F.round(part(F.col("a")), 6).alias("p"), F.round(part(F.col("b")), 6).alias("r"))
    best = F.max_by(F.struct("f1", "p", "r", "pos"), F.struct("f1", "exact", -F.col("pos")))
    g = s.groupBy("case_id").agg(best.alias("best"), F.max(F.col("exact").cast("int")).alias("any_exact"))
    return g.select("case_id", "best.f1", "best.p", "best.r", F.col("best.pos").cast("long").alias("alias"), (F.col("any_exact") == 1).alias("exact"))


def pairwise_group_f1(spark, sf):
    """Mean F1 over the unordered pairs of titles of a group; of each 200 documents those of one id modulo 20 are a group, ten at most."""
    d = corpus(spark, sf).select(F.col("id").cast("long").alias("doc"), T.official_words(F.col("title")).alias("w")).withColumn("g", F.floor(F.col("doc") / 200) * 20 + F.col("doc") % 20)
    j = d.alias("a").join(d.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.doc") < F.col("b.doc")))
    return j.groupBy(F.col("a.g").alias("g")).agg(F.count("*").alias("pairs"), F.round(F.avg(T.token_f1(F.col("a.w"), F.col("b.w"))), 6).alias("mean_f1"))


def distribution_metrics(spark, sf):
    return S.distribution(table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 17 != 0, F.col("value"))), "v", "event_type")


def percentile_conventions(spark, sf):
    return S.percentile_conventions(table(spark, sf, "events"), "value", "user_id")


def _arms(spark, sf):
    """Orders as cases, priority as stratum; both arms score lineitems of a case, the second on a shifted threshold and without every 13th case."""
    line = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("stratum")).join(line, F.col("case_id") == F.col("l_orderkey"))
    a = o.select("case_id", "stratum", (F.col("q") % 10 < 6).cast("int").alias("em"), "n")
    b = o.filter("case_id % 13 <> 0").select("case_id", "stratum", (F.col("q") % 10 < 4 + F.col("n") % 4).cast("int").alias("em"), "n")
    return a, b


_ARMS = """o AS (SELECT o_orderkey AS case_id, o_orderpriority AS stratum, q, n FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
a AS (SELECT case_id, stratum, CAST(q % 10 < 6 AS INT) AS em, n FROM o), b AS (SELECT case_id, stratum, CAST(q % 10 < 4 + n % 4 AS INT) AS em, n FROM o WHERE case_id % 13 <> 0)"""


def paired_delta(spark, sf):
    a, b = _arms(spark, sf)
    return S.paired_report(S.paired(a, b, "case_id", "em"), "em")


def paired_changes(spark, sf):
    """Gains and losses by stratum, over the cases of both arms."""
    a, b = _arms(spark, sf)
    j = a.select("case_id", "stratum", F.col("em").alias("x")).join(b.select("case_id", F.col("em").alias("y")), "case_id")
    return j.groupBy("stratum").agg(F.count_if(F.col("x") < F.col("y")).alias("gains"), F.count_if(F.col("x") > F.col("y")).alias("losses"), F.round(F.sum(F.col("x") * F.col("y")) / F.greatest(F.sum("x"), F.lit(1)), 6).alias("retention"))


def arm_split_cube(spark, sf):
    a, b = _arms(spark, sf)
    every = a.withColumn("arm", F.lit("a")).unionByName(b.withColumn("arm", F.lit("b")))
    return every.cube("arm", "stratum").agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("accuracy"), F.sum("n").alias("lines"))


def bootstrap_ci(spark, sf):
    a, b = _arms(spark, sf)
    units = a.select("case_id", F.col("em").alias("x")).join(b.select("case_id", F.col("em").alias("y")), "case_id").select(F.col("case_id").alias("key"), (F.col("y") - F.col("x")).cast("double").alias("delta"))
    return S.bootstrap(units)


def bootstrap_conventions(spark, sf):
    """The interval of a difference between arms, customers being the units, by four conventions."""
    a, b = _arms(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey")
    j = a.select("case_id", F.col("em").alias("x")).join(b.select("case_id", F.col("em").alias("y")), "case_id").join(o, "case_id").withColumn("d", (F.col("y") - F.col("x")).cast("double"))
    return S.interval_conventions(S.clustered_units(j, "o_custkey", "d"))


def stratified_bootstrap(spark, sf):
    """Per condition: means over seeds within a question, then intervals over resampled questions."""
    seeds = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_linestatus").agg(F.avg("l_discount").alias("x"))
    return S.bootstrap(S.clustered_units(seeds, "l_suppkey", "x", ("l_returnflag",)), by=("l_returnflag",))


def varied_forecast(spark, sf):
    return S.varied_forecast(rollouts(spark, sf), "group_id", "reason")


def efficiency_metrics(spark, sf):
    return S.efficiency(table(spark, sf, "lineitem"), "l_quantity", "l_partkey", "l_suppkey", "l_returnflag")


def clustered_delta(spark, sf):
    a, b = _arms(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey")
    j = a.select("case_id", F.col("em").alias("before")).join(b.select("case_id", F.col("em").alias("after")), "case_id").join(o, "case_id").withColumn("delta", F.col("after") - F.col("before"))
    return S.clustered(j, "o_custkey", "before", "after", "delta")


def outcome_entropy(spark, sf):
    return S.entropy(rollouts(spark, sf), "group_id", "reason")


def pearson_guarded(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.lit(1.0).alias("one"))
    return e.groupBy("event_type").agg(S.pearson("value", "k").alias("value_k"), S.pearson("value", "one").alias("value_one"))


def variance_probability(spark, sf):
    return S.variance_probability(rollouts(spark, sf), "group_id", "reason")


def _arrays(spark, sf):
    """Token log-probabilities of a conversation turn from its words' lengths: current, old and reference."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    size = F.transform("w", lambda x: F.length(x).cast("double"))
    return c.select("conv_id", "turn", F.transform(size, lambda x: -x / 10).alias("cur"), F.transform(size, lambda x: -(x + x % 3 - 1) / 10).alias("old"), F.transform(size, lambda x: -(x + x % 2) / 10).alias("ref"), F.when(F.col("turn") % 2 == 0, 1.0).otherwise(-0.5).alias("adv"))


def grpo_loss_columns(spark, sf):
    c = S.clipped_loss(F.col("cur"), F.col("old"), F.col("ref"), F.col("adv"), 0.1)
    return _arrays(spark, sf).select("conv_id", "turn", *[F.round(v, 6).alias(k) for k, v in c.items()])


def logprob_comparison(spark, sf):
    """Absolute differences and ratios of two scorings of the same tokens, by conversation."""
    e = _arrays(spark, sf).select("conv_id", F.explode(F.arrays_zip("cur", "old")).alias("t")).select("conv_id", (F.col("t.cur") - F.col("t.old")).alias("d"))
    return e.groupBy("conv_id").agg(F.count("*").alias("tokens"), F.round(F.max(F.abs("d")), 6).alias("max_delta"), F.round(F.percentile(F.abs("d"), 0.95), 6).alias("p95_delta"), F.round(F.max(F.exp("d")), 6).alias("max_ratio"), F.round(F.avg(F.exp("d")), 6).alias("mean_ratio"))


def weighted_mean_loss(spark, sf):
    """Token-weighted mean of a per-order loss by year, beside the plain mean."""
    line = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("long").alias("year"), "l_discount", "l_quantity")
    return line.groupBy("year").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted"), F.round(F.avg("l_discount"), 6).alias("plain"))


def conditional_accuracy_bounds(spark, sf):
    """Accuracy by bucket with pending labels: bounds as if all pending were wrong, or right."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    n, pending, good = F.count("*"), F.count_if(F.col("quality").isNull()), F.coalesce(F.sum("quality"), F.lit(0)).cast("long")
    return d.groupBy("lang").agg(n.alias("n"), pending.alias("pending"), F.round(good / n, 6).alias("lower"), F.round((good + pending) / n, 6).alias("upper"), F.round(F.avg("quality"), 6).alias("known"))


def source_coverage_micro_macro(spark, sf):
    """Required against retrieved documents by rollout; unknown rollouts (days divisible by 4) count in neither mean."""
    s = steps(spark, sf)
    hits = s.filter(F.col("found").isin(1, 4)).groupBy("rollout_id").agg(F.count_distinct("found").alias("hit"))
    r = rollouts(spark, sf).join(hits, "rollout_id", "left").withColumn("known", F.substring("rollout_id", -2, 2).cast("int") % 4 != 0)
    need = F.when(F.col("known"), 2)
    hit = F.when(F.col("known"), F.coalesce("hit", F.lit(0)))
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("unknown"), F.round(F.sum(hit) / F.sum(need), 6).alias("micro"), F.round(F.avg(hit / need), 6).alias("macro"), F.round(F.avg((hit == need).cast("int")), 6).alias("complete"))


def evaluation_summary(spark, sf):
    """The global evaluation row; an empty denominator gives 0."""
    r = rollouts(spark, sf)
    share = lambda c: F.round(F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 6)
    return r.agg(F.count("*").alias("rollouts"), share(F.col("correct")).alias("exact_rate"), share(F.col("reason") == "answer").alias("answered_rate"), share(F.col("reason") == "invalid_action").alias("invalid_rate"), share(F.col("searches") > 0).alias("search_rate"), F.round(F.sum("searches") / F.greatest(F.count("*"), F.lit(1)), 6).alias("mean_searches"), F.round(F.avg("reward"), 6).alias("mean_reward"))


def probe_gate(spark, sf):
    """PASS, FAIL or UNVERIFIABLE by user: enough rollouts, few invalid ones, a known peak."""
    r = rollouts(spark, sf).groupBy("group_id").agg(F.count("*").alias("attempted"), F.count_if(F.col("reason") == "invalid_action").alias("failed"), F.max(F.when(F.col("group_id") % 6 != 0, F.col("n_steps"))).alias("peak"))
    status = F.when(F.col("peak").isNull(), "UNVERIFIABLE").when((F.col("attempted") >= 20) & (F.col("failed") <= 6) & (F.col("peak") <= 7), "PASS").otherwise("FAIL")
    return r.select("group_id", "attempted", "failed", "peak", status.alias("status"))


def arm_ranking(spark, sf):
    """Arms (statuses and priorities) that pass a gate, ranked by accuracy, then cost, then name."""
    o = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg((F.floor("o_totalprice") % 2 == 0).cast("int")), 6).alias("accuracy"), F.round(F.avg("o_totalprice"), 2).alias("cost"))
    gated = o.filter("n >= 10").withColumn("arm", F.concat_ws("/", "o_orderstatus", "o_orderpriority"))
    return gated.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), "cost", "arm")).cast("long")).select("arm", "n", "accuracy", "cost", "place")


QUERIES = {f.__name__: f for f in (token_f1_pairs, official_f1_pairs, best_alias_score, pairwise_group_f1, distribution_metrics, percentile_conventions, paired_delta, paired_changes, arm_split_cube, bootstrap_ci, bootstrap_conventions, stratified_bootstrap, varied_forecast, efficiency_metrics, clustered_delta, outcome_entropy, pearson_guarded, variance_probability, grpo_loss_columns, logprob_comparison, weighted_mean_loss, conditional_accuracy_bounds, source_coverage_micro_macro, evaluation_summary, probe_gate, arm_ranking)}

_A, _B = "a", "b"
_F1 = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(len(a) = 0 AND len(b) = 0 AS DOUBLE) WHEN c = 0 THEN 0.0 ELSE 2.0 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)) END"
_SCORED = f"s AS (SELECT *, coalesce({_common('a', 'b')}, 0)::DOUBLE AS c FROM (SELECT *, {_plain('said')} AS a, {_plain('gold')} AS b FROM pairs))"
_BASE = f"WITH {STEPS}, {ROLLOUTS}"
_ARR = """w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), z AS (SELECT conv_id, turn, list_transform(w, lambda x: length(x)::DOUBLE) AS s FROM w),
t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS adv, unnest(list_transform(s, lambda x: {'c': -x / 10, 'o': -(x + x % 3 - 1) / 10, 'r': -(x + x % 2) / 10})) AS x FROM z)"""


def _draws(by: str = "") -> str:
    """CTE m (by, r, m): the resampled means of u (by, key, delta)."""
    weight = " + ".join(f"(x >= {t})::INT" for t in S.POISSON)
    return f"""d AS (SELECT *, CAST('0x' || substr(md5('42:' || r // 8 || ':' || key), 1 + 4 * (r % 8), 4) AS BIGINT) AS x FROM u, range(0, 200) t(r)), w AS (SELECT *, {weight} AS w FROM d),
m AS (SELECT {by}r, sum(w * delta) / sum(w) AS m FROM w WHERE w > 0 GROUP BY {by}r)"""


ORACLES = {
    "token_f1_pairs": f"""WITH {_PAIRS}, {_SCORED} SELECT case_id, round({_F1}, 6) AS f1, round(CASE WHEN array_to_string(b, ' ') IN ('yes', 'no') THEN CAST(a = b AS DOUBLE) ELSE {_F1} END, 6) AS reward_f1,
trim(regexp_replace(lower(said), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(gold), '\\s+', ' ', 'g')) AS exact, array_to_string(a, ' ') = array_to_string(b, ' ') AS normalized_exact FROM s""",
    "official_f1_pairs": f"""WITH {_PAIRS}, {_SCORED} SELECT case_id, round(CASE WHEN a <> b AND (array_to_string(a, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(b, ' ') IN ('yes', 'no', 'noanswer')) THEN 0.0 WHEN c = 0 THEN 0.0 ELSE {_F1} END, 6) AS f1, a = b AS exact FROM s""",
    "best_alias_score": f"""WITH {_PAIRS}, al AS (SELECT case_id, said, unnest(range(0, CASE WHEN case_id % 5 = 0 THEN 3 ELSE 2 END)) AS pos, gold AS g FROM pairs),
e AS (SELECT case_id, pos, {_plain('said')} AS a, {_plain("CASE pos WHEN 0 THEN g WHEN 1 THEN array_to_string(string_split(g, ' ')[1:9], ' ') ELSE said END")} AS b FROM al),
c AS (SELECT *, coalesce({_common('a', 'b')}, 0)::DOUBLE AS c FROM e),
s AS (SELECT case_id, pos, round({_F1}, 6) AS f1, a = b AS exact, round(CASE WHEN len(a) > 0 THEN c / len(a) ELSE 0 END, 6) AS p, round(CASE WHEN len(b) > 0 THEN c / len(b) ELSE 0 END, 6) AS r FROM c)
SELECT case_id, f1, p, r, pos AS alias, anyx AS exact FROM (SELECT *, bool_or(exact) OVER (PARTITION BY case_id) AS anyx, row_number() OVER (PARTITION BY case_id ORDER BY f1 DESC, exact DESC, pos) AS n FROM s) WHERE n = 1""",
    "pairwise_group_f1": f"""WITH {CORPUS}, d AS (SELECT id::BIGINT AS doc, id::BIGINT // 200 * 20 + id::BIGINT % 20 AS g, {_plain('title')} AS w FROM corpus),
j AS (SELECT x.g, x.w AS a, y.w AS b FROM d x JOIN d y ON x.g = y.g AND x.doc < y.doc), s AS (SELECT *, coalesce({_common('a', 'b')}, 0)::DOUBLE AS c FROM j)
SELECT g, count(*) AS pairs, round(avg({_F1}), 6) AS mean_f1 FROM s GROUP BY g""",
    "distribution_metrics": """WITH e AS (SELECT event_type, CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM events) SELECT event_type, count(v) AS count, count(*) - count(v) AS missing, round(sum(v), 4) AS sum, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max,
round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM e GROUP BY event_type""",
    "percentile_conventions": "SELECT user_id, round(quantile_cont(value, 0.95), 6) AS linear, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS floor_index, list_sort(list(value))[CAST(ceil(count(*) * 0.95::DOUBLE) AS BIGINT)] AS nearest_rank FROM events GROUP BY user_id",
    "paired_delta": f"""WITH {_ARMS}, j AS (SELECT a.case_id IS NOT NULL AS l, b.case_id IS NOT NULL AS r, b.em - a.em AS d FROM a FULL JOIN b ON a.case_id = b.case_id)
SELECT count(*) FILTER (WHERE l AND r) AS pairs, count(*) FILTER (WHERE NOT r) AS before_only, count(*) FILTER (WHERE NOT l) AS after_only, count(*) FILTER (WHERE NOT (l AND r)) = 0 AS identical_case_sets, count(*) FILTER (WHERE d > 0) AS gains, count(*) FILTER (WHERE d < 0) AS losses, count(*) FILTER (WHERE d = 0) AS unchanged, round(avg(d), 6) AS mean_delta FROM j""",
    "paired_changes": f"WITH {_ARMS} SELECT a.stratum, count(*) FILTER (WHERE a.em < b.em) AS gains, count(*) FILTER (WHERE a.em > b.em) AS losses, round(sum(a.em * b.em) / greatest(sum(a.em), 1), 6) AS retention FROM a JOIN b ON a.case_id = b.case_id GROUP BY a.stratum",
    "arm_split_cube": f"WITH {_ARMS}, u AS (SELECT 'a' AS arm, * FROM a UNION ALL SELECT 'b', * FROM b) SELECT arm, stratum, count(*) AS n, round(avg(em), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS lines FROM u GROUP BY CUBE (arm, stratum)",
    "bootstrap_ci": f"""WITH {_ARMS}, u AS (SELECT a.case_id AS key, (b.em - a.em)::DOUBLE AS delta FROM a JOIN b ON a.case_id = b.case_id), {_draws()}
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS draws FROM m""",
    "bootstrap_conventions": f"""WITH {_ARMS}, u AS (SELECT o_custkey AS key, avg((b.em - a.em)::DOUBLE) AS delta FROM a JOIN b ON a.case_id = b.case_id JOIN orders ON o_orderkey = a.case_id GROUP BY 1), {_draws()},
s AS (SELECT list_sort(list(m)) AS s, quantile_cont(m, 0.025) AS l, quantile_cont(m, 0.975) AS h FROM m)
SELECT round(s[6], 6) AS before_low, round(s[195], 6) AS before_high, round(s[6], 6) AS held_low, round(s[196], 6) AS held_high, round(s[6], 6) AS index_low, round(s[196], 6) AS index_high, round(l, 6) AS linear_low, round(h, 6) AS linear_high FROM s""",
    "stratified_bootstrap": f"""WITH x AS (SELECT l_returnflag, l_suppkey, l_linestatus, avg(l_discount) AS x FROM lineitem GROUP BY ALL), u AS (SELECT l_returnflag, l_suppkey AS key, avg(x) AS delta FROM x GROUP BY ALL), {_draws('l_returnflag, ')}
SELECT l_returnflag, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS draws FROM m GROUP BY l_returnflag""",
    "varied_forecast": f"""{_BASE}, c AS (SELECT group_id, reason, count(*) AS c FROM rollouts GROUP BY ALL), v AS (SELECT *, sum(c) OVER (PARTITION BY group_id ORDER BY reason) AS upto, sum(c) OVER (PARTITION BY group_id) AS n FROM c),
g AS (SELECT group_id, max(n)::BIGINT AS n, list(upto::BIGINT ORDER BY reason) AS sums FROM v GROUP BY group_id), z AS (SELECT unnest([2, 4, 8]) AS size),
t AS (SELECT size, sim, CAST(sum(CASE WHEN len(list_distinct(list_transform(range(0, size), lambda i: len(list_filter(sums, lambda s: s <= CAST('0x' || substr(md5('f:' || group_id || ':' || sim || ':' || size || ':' || i), 1, 8) AS BIGINT) % n))))) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM g, z, range(0, 100) r(sim) GROUP BY ALL),
k AS (SELECT size, list(k ORDER BY k) AS k FROM t GROUP BY size), e AS (SELECT size, round(sum(1 - same), 6) AS expected FROM (SELECT size, group_id, sum(pow(c / n, size)) AS same FROM v, z GROUP BY ALL) GROUP BY size)
SELECT size::BIGINT AS size, expected, k[6] AS p05, k[51] AS median, k[96] AS p95 FROM k JOIN e USING (size)""",
    "efficiency_metrics": "SELECT l_returnflag, count(*) AS questions, round(60 * count(*) / nullif(sum(l_quantity), 0), 6) AS per_minute, round(sum(l_partkey) / nullif(sum(l_quantity), 0), 6) AS in_per_second, round(sum(l_suppkey) / nullif(sum(l_quantity), 0), 6) AS out_per_second FROM lineitem GROUP BY 1",
    "clustered_delta": f"""WITH {_ARMS}, c AS (SELECT o_custkey, avg(a.em) AS before, avg(b.em) AS after, avg(b.em - a.em) AS delta FROM a JOIN b ON a.case_id = b.case_id JOIN orders ON o_orderkey = a.case_id GROUP BY o_custkey)
SELECT count(*) AS clusters, round(avg(before), 6) AS before, round(avg(after), 6) AS after, round(avg(delta), 6) AS delta FROM c""",
    "outcome_entropy": f"{_BASE}, c AS (SELECT group_id, count(*) AS c FROM rollouts GROUP BY group_id, reason) SELECT group_id, CAST(sum(c) AS BIGINT) AS n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS entropy FROM c GROUP BY group_id",
    "pearson_guarded": "SELECT event_type, round(corr(value, CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS value_k, CASE WHEN stddev_pop(one) > 1e-12 AND stddev_pop(value) > 1e-12 THEN round(corr(value, one), 6) END AS value_one FROM (SELECT *, 1.0::DOUBLE AS one FROM events) GROUP BY event_type",
    "variance_probability": f"{_BASE}, c AS (SELECT group_id, count(*)::DOUBLE AS c FROM rollouts GROUP BY group_id, reason), n AS (SELECT *, sum(c) OVER (PARTITION BY group_id) AS n FROM c) SELECT group_id, " + ", ".join(f"round(1 - sum(pow(c / n, {g})), 6) + 0.0 AS p_{g}" for g in (2, 4, 8)) + " FROM n GROUP BY group_id",
    "grpo_loss_columns": f"""WITH {_ARR}, e AS (SELECT conv_id, turn, adv, exp(x.c - x.o) AS ratio, x.c - x.r AS d FROM t)
SELECT conv_id, turn, round(avg(-least(ratio * adv, greatest(0.9, least(1.1, ratio)) * adv)) + 0.02 * avg(exp(-d) + d - 1), 6) AS loss, round(avg(exp(-d) + d - 1), 6) AS kl, round(avg(CAST(ratio < 0.9 OR ratio > 1.1 AS INT)), 6) AS clip_fraction, round(max(ratio), 6) AS ratio_max FROM e GROUP BY conv_id, turn""",
    "logprob_comparison": f"WITH {_ARR} SELECT conv_id, count(*) AS tokens, round(max(abs(x.c - x.o)), 6) AS max_delta, round(quantile_cont(abs(x.c - x.o), 0.95), 6) AS p95_delta, round(max(exp(x.c - x.o)), 6) AS max_ratio, round(avg(exp(x.c - x.o)), 6) AS mean_ratio FROM t GROUP BY conv_id",
    "weighted_mean_loss": "SELECT year(l_shipdate)::BIGINT AS year, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, round(avg(l_discount), 6) AS plain FROM lineitem GROUP BY 1",
    "conditional_accuracy_bounds": "SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS pending, round(coalesce(sum(quality), 0) / count(*), 6) AS lower, round((coalesce(sum(quality), 0) + count(*) FILTER (WHERE quality IS NULL)) / count(*), 6) AS upper, round(avg(quality), 6) AS known FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang",
    "source_coverage_micro_macro": f"""{_BASE}, h AS (SELECT rollout_id, count(DISTINCT found) AS hit FROM steps WHERE found IN (1, 4) GROUP BY rollout_id),
r AS (SELECT reason, right(rollout_id, 2)::INT % 4 <> 0 AS known, coalesce(hit, 0) AS hit FROM rollouts LEFT JOIN h USING (rollout_id))
SELECT reason, count(*) AS n, count(*) FILTER (WHERE NOT known) AS unknown, round(sum(hit) FILTER (WHERE known) / (2 * count(*) FILTER (WHERE known)), 6) AS micro, round(avg(hit / 2) FILTER (WHERE known), 6) AS macro, round(avg((hit = 2)::INT) FILTER (WHERE known), 6) AS complete FROM r GROUP BY reason""",
    "evaluation_summary": f"{_BASE} SELECT count(*) AS rollouts, round(avg(correct::INT), 6) AS exact_rate, round(avg((reason = 'answer')::INT), 6) AS answered_rate, round(avg((reason = 'invalid_action')::INT), 6) AS invalid_rate, round(avg((searches > 0)::INT), 6) AS search_rate, round(avg(searches), 6) AS mean_searches, round(avg(reward), 6) AS mean_reward FROM rollouts",
    "probe_gate": f"""{_BASE}, g AS (SELECT group_id, count(*) AS attempted, count(*) FILTER (WHERE reason = 'invalid_action') AS failed, max(n_steps) FILTER (WHERE group_id % 6 <> 0) AS peak FROM rollouts GROUP BY group_id)
SELECT *, CASE WHEN peak IS NULL THEN 'UNVERIFIABLE' WHEN attempted >= 20 AND failed <= 6 AND peak <= 7 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""",
    "arm_ranking": """WITH g AS (SELECT o_orderstatus || '/' || o_orderpriority AS arm, count(*) AS n, round(avg(CAST(CAST(floor(o_totalprice) AS BIGINT) % 2 = 0 AS INT)), 6) AS accuracy, round(avg(o_totalprice), 2) AS cost FROM orders GROUP BY 1 HAVING count(*) >= 10)
SELECT arm, n, accuracy, cost, row_number() OVER (ORDER BY accuracy DESC, cost, arm) AS place FROM g""",
}
