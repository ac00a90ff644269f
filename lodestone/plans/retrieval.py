"""Queries of the retrieval family, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import excerpts as E
from ..operators import retrieval as R
from ..scratch import written
from ..session import table
from ..tables import CORPUS, PARAGRAPHS, QRELS, QUESTIONS, corpus, paragraphs, qrels, questions

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def tok(x: str) -> str:
    """The BM25 tokenizer in DuckDB."""
    return f"list_filter(regexp_extract_all(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[㐀-䶿一-鿿豈-﫿]|[a-z0-9]+'), lambda t: NOT list_contains([{_STOP}], t) AND (length(t) >= 2 OR strlen(t) > 1))"


def _bm25(source: str, keys: str, boost: bool, title_weight: int = 3) -> str:
    """CTEs up to ``scored`` (qid, keys, score)."""
    title = " || ".join([tok("title")] * title_weight) + " || " if title_weight else ""
    join = " AND ".join(f"s.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"coalesce(s.{k}, b.{k}) AS {k}" for k in keys.split(", "))
    ctes = f"""docs AS (SELECT {keys}, title, {title}{tok('text')} AS t FROM {source}),
post AS (SELECT {keys}, len(t) AS dl, token, count(*) AS tf FROM (SELECT {keys}, t, unnest(t) AS token FROM docs) GROUP BY ALL),
st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS mean FROM docs),
qt AS (SELECT DISTINCT qid, unnest({tok('question')}) AS token FROM questions),
hit AS (SELECT qid, {keys}, tf, dl, count(*) OVER (PARTITION BY qid, token) AS df FROM post JOIN qt USING (token)),
sums AS (SELECT qid, {keys}, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM hit, st GROUP BY qid, {keys})"""
    if not boost:
        return ctes + ", scored AS (SELECT * FROM sums WHERE score > 0)"
    return (
        ctes
        + f""", tk AS (SELECT {keys}, array_to_string({tok('title')}, ' ') AS title_key FROM docs),
qk AS (SELECT qid, array_to_string({tok('question')}, ' ') AS query_key FROM questions),
bo AS (SELECT qid, {keys}, CASE WHEN title_key = query_key THEN 10.0 ELSE 4.0 END AS boost FROM tk, qk WHERE title_key <> '' AND query_key <> '' AND contains(query_key, title_key)),
scored AS (SELECT coalesce(s.qid, b.qid) AS qid, {own}, coalesce(score, 0.0) + coalesce(boost, 0.0) AS score FROM sums s FULL JOIN bo b ON s.qid = b.qid AND {join})"""
    )


_TOP = "(SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank, id, round(score, 6) AS score FROM scored)"


def bm25_topk(spark, sf):
    return R.bm25_search(corpus(spark, sf), questions(spark, sf), 3, boost=False)


def bm25_title_boost(spark, sf):
    return R.bm25_search(corpus(spark, sf), _titled(spark, sf), 3, boost=True)


def _titled(spark, sf):
    """Benchmark questions, and the titles of documents divisible by 100 as questions of their own."""
    own = corpus(spark, sf).filter(F.col("id").cast("long") % 100 == 0).select((F.col("id").cast("long") + 1_000_000).alias("qid"), F.concat_ws(" ", F.lit("about"), "title").alias("question"))
    return questions(spark, sf).unionByName(own)


_TITLED = QUESTIONS.replace("questions AS (", "questions AS (SELECT id::BIGINT + 1000000 AS qid, 'about ' || title AS question FROM corpus WHERE id::BIGINT % 100 = 0 UNION ALL ")


def bm25_paragraph_distinct(spark, sf):
    return R.bm25_paragraphs(paragraphs(spark, sf), questions(spark, sf))


def page_paragraph_two_stage(spark, sf):
    return R.page_then_paragraph(corpus(spark, sf), paragraphs(spark, sf), questions(spark, sf))


def page_excerpts(spark, sf):
    """Excerpts of each question's best pages, in words; the budgets are an eighth of the fixed ones, as the table's paragraphs are short."""
    q = questions(spark, sf)
    asked = q.unionByName(corpus(spark, sf).filter("id % 100 = 0").select((F.col("id").cast("long") + 1_000_000).alias("qid"), F.concat(F.lit("about "), "title").alias("question")))
    found = E.page_excerpts(corpus(spark, sf), paragraphs(spark, sf), asked, lead=48, body=36, intro=12)
    places = F.array_join(F.transform("segments", lambda s: F.concat(s["paragraph_index"].cast("string"), F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.select("qid", "rank", "id", "page_score", "paragraph_index", places.alias("segments"), "text")


def keyword_topk(spark, sf):
    return R.keyword_search(corpus(spark, sf), questions(spark, sf))


def _dense(spark, sf, k=3):
    e = table(spark, sf, "embeddings")
    return R.dense_search(e.select(F.col("label").cast("string").alias("id"), F.col("embedding").alias("vector")), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), k)


def dense_max_per_doc(spark, sf):
    return _dense(spark, sf)


def rrf_fusion(spark, sf):
    c, q = corpus(spark, sf), questions(spark, sf)
    lists = R.bm25_search(c, q, R.CANDIDATES, boost=False).select(F.lit("bm25").alias("source"), "qid", "rank", "id").unionByName(R.keyword_search(c, q, R.CANDIDATES).select(F.lit("keyword").alias("source"), "qid", "rank", "id"))
    return R.fuse(lists)


def retrieval_recall_at_k(spark, sf):
    return R.recall(R.bm25_search(corpus(spark, sf), questions(spark, sf), 10, boost=False), qrels(spark, sf))


def retriever_comparison(spark, sf):
    """Keyword and BM25 in one environment: mean recalls of each."""
    c, q, rel = corpus(spark, sf), questions(spark, sf), qrels(spark, sf)
    one = lambda name, ranked: R.recall(ranked, rel).agg(F.count("*").alias("queries"), F.round(F.avg("recall_3"), 6).alias("recall_3"), F.round(F.avg("recall_10"), 6).alias("recall_10"), F.count_if("all_10").alias("all_10")).withColumn("retriever", F.lit(name))
    return one("bm25", R.bm25_search(c, q, 10, boost=False)).unionByName(one("keyword", R.keyword_search(c, q, 10)))


def rerank_window_max(spark, sf):
    c, q = corpus(spark, sf), questions(spark, sf)
    return R.rerank(R.bm25_search(c, q, R.CANDIDATES, boost=False), c, q, width=64, stride=64)


def linked_title_hop(spark, sf):
    c = corpus(spark, sf)
    return R.linked_hop(R.bm25_search(c, questions(spark, sf), 3, boost=False), c)


def replay_top3(spark, sf):
    """A written list per question (every seventh one damaged) against the one that a search of the paragraphs' pages, put together again, gives."""
    listed = lambda c: R.bm25_search(c, questions(spark, sf), 3, boost=False).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    stored = written(listed(corpus(spark, sf)).select("qid", F.when(F.col("qid") % 7 == 0, F.reverse("ids")).otherwise(F.col("ids")).alias("stored")))
    pages = paragraphs(spark, sf).groupBy("id", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    blank = corpus(spark, sf).join(pages.select("id"), "id", "left_anti").withColumn("text", F.lit(""))
    return stored.join(listed(pages.unionByName(blank)), "qid", "full").select("qid", F.array_join("ids", ",").alias("ids"), F.col("ids").eqNullSafe(F.col("stored")).alias("same"))


_KEYWORD = """terms AS (SELECT qid, unnest(list_distinct(regexp_extract_all(replace(lower(question), 'ß', 'ss'), '[㐀-䶿一-鿿豈-﫿]|[a-z0-9]+'))) AS term FROM questions),
body AS (SELECT id, replace(lower(title || ' ' || text), 'ß', 'ss') AS body FROM corpus),
kw AS (SELECT qid, id, CAST(sum((length(body) - length(replace(body, term, ''))) // length(term)) AS BIGINT) AS score FROM body, terms WHERE contains(body, term) GROUP BY qid, id),
kwr AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, score FROM kw)"""
_RANKED = f"ranked AS {_TOP}"
_RECALL = """rec AS (SELECT q.qid, count(*) AS n_relevant, round(count(*) FILTER (WHERE rank <= 3) / count(*), 6) AS recall_3, round(count(*) FILTER (WHERE rank <= 10) / count(*), 6) AS recall_10,
  count(*) FILTER (WHERE rank <= 3) = count(*) AS all_3, count(*) FILTER (WHERE rank <= 10) = count(*) AS all_10 FROM qrels q LEFT JOIN ranked r ON q.qid = r.qid AND q.id = r.id GROUP BY q.qid)"""
_BASE = f"WITH {CORPUS}, {QUESTIONS}, {_bm25('corpus', 'id', False)}, {_RANKED}"

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_title_boost, bm25_paragraph_distinct, page_paragraph_two_stage, page_excerpts, keyword_topk, dense_max_per_doc, rrf_fusion, retrieval_recall_at_k, retriever_comparison, rerank_window_max, linked_title_hop, replay_top3)}
ORACLES = {
    "bm25_topk": f"{_BASE} SELECT * FROM ranked WHERE rank <= 3",
    "bm25_title_boost": f"WITH {CORPUS}, {_TITLED}, {_bm25('corpus', 'id', True)}, {_RANKED} SELECT * FROM ranked WHERE rank <= 3",
    "bm25_paragraph_distinct": f"""WITH {CORPUS}, {QUESTIONS}, {PARAGRAPHS}, {_bm25('paragraphs', 'id, paragraph_index', True)},
one AS (SELECT * FROM (SELECT s.*, title_key, round(s.score, 9) AS r, row_number() OVER (PARTITION BY qid, title_key ORDER BY round(s.score, 9) DESC, paragraph_index, id) AS n FROM scored s JOIN tk USING (id, paragraph_index)) WHERE n = 1)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY r DESC, title_key, paragraph_index, id) AS rank, id, paragraph_index, round(score, 6) AS score FROM one) WHERE rank <= 3""",
    "page_paragraph_two_stage": f"""WITH {CORPUS}, {QUESTIONS}, {PARAGRAPHS}, {_bm25('corpus', 'id', True)}, pages_ AS (SELECT * FROM {_TOP} WHERE rank <= 3),
inner_ AS (SELECT * FROM (WITH {_bm25('paragraphs', 'id, paragraph_index', False, 0)} SELECT * FROM scored)),
j AS (SELECT i.*, p.rank, p.score AS page_score, row_number() OVER (PARTITION BY qid, id ORDER BY round(i.score, 9) DESC, paragraph_index) AS n FROM inner_ i JOIN pages_ p USING (qid, id))
SELECT qid, rank, id, page_score, paragraph_index, round(score, 6) AS body_score FROM j WHERE n = 1""",
    "page_excerpts": f"""WITH {CORPUS}, {_TITLED}, {PARAGRAPHS}, {_bm25('corpus', 'id', True)}, pages_ AS (SELECT * FROM {_TOP} WHERE rank <= 3),
el AS (SELECT id, paragraph_index, NULL AS title, text FROM paragraphs WHERE len({tok('text')}) > 0 AND array_to_string({tok('text')}, ' ') NOT IN ('bibliography', 'references', 'external links', 'see also', 'notes', 'further reading')),
inner_ AS (SELECT * FROM (WITH {_bm25('el', 'id, paragraph_index', False, 0)} SELECT * FROM scored)),
best AS (SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY qid, id ORDER BY round(i.score, 9) DESC, paragraph_index) AS n FROM inner_ i SEMI JOIN pages_ p USING (qid, id)) WHERE n = 1),
j AS (SELECT p.*, l.lead, b.paragraph_index AS best FROM pages_ p JOIN (SELECT id, min(paragraph_index) AS lead FROM el GROUP BY id) l USING (id) LEFT JOIN best b USING (qid, id)),
seg AS (SELECT qid, id, 0 AS n, lead AS pl, CASE WHEN best IS NULL THEN 48 WHEN best = lead THEN 36 ELSE 12 END AS lim FROM j UNION ALL SELECT qid, id, 1, best, 36 FROM j WHERE best <> lead),
w AS (SELECT s.*, regexp_extract_all(e.text, '[ \t]*[^ \t]+') AS pc, list_distinct({tok('question')}) AS q FROM seg s JOIN el e ON e.id = s.id AND e.paragraph_index = s.pl JOIN questions USING (qid)),
h AS (SELECT *, list_transform(pc, lambda x: list_filter({tok('x')}, lambda y: list_contains(q, y))) AS hits FROM w),
c AS (SELECT qid, id, n, i, row_number() OVER (PARTITION BY qid, id, n ORDER BY len(list_distinct(flatten(hits[i:i + lim - 1]))) DESC, len(flatten(hits[i:i + lim - 1])) DESC, i) AS r FROM (SELECT *, unnest(range(1, greatest(1, len(pc) - lim + 1) + 1)) AS i FROM h)),
o AS (SELECT qid, id, n, pl, length(array_to_string(pc[1:i - 1], '')) + length(pc[i]) - length(ltrim(pc[i], ' ' || chr(9))) AS a, ltrim(array_to_string(pc[i:i + lim - 1], ''), ' ' || chr(9)) AS own FROM h JOIN c USING (qid, id, n) WHERE r = 1),
t AS (SELECT qid, id, string_agg(pl || ':' || a || '-' || (a + length(own)), ',' ORDER BY n) AS segments, string_agg(own, chr(10) ORDER BY n) AS text FROM o GROUP BY qid, id)
SELECT qid, rank, id, score AS page_score, coalesce(best, lead) AS paragraph_index, segments, text FROM j JOIN t USING (qid, id)""",
    "keyword_topk": f"WITH {CORPUS}, {QUESTIONS}, {_KEYWORD} SELECT * FROM kwr WHERE rank <= 3",
    "dense_max_per_doc": """WITH p AS (SELECT q.vec_id AS qid, x.label::VARCHAR AS id, max(list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))) AS score
FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank, id, round(score, 6) AS score FROM p) WHERE rank <= 3""",
    "rrf_fusion": f"""{_BASE}, {_KEYWORD}, f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, id, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT qid, id, rank FROM kwr WHERE rank <= 20) GROUP BY qid, id)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS rank, id, round(score, 8) AS score FROM f) WHERE rank <= 3""",
    "retrieval_recall_at_k": f"{_BASE}, {QRELS}, {_RECALL} SELECT * FROM rec",
    "retriever_comparison": f"""WITH {CORPUS}, {QUESTIONS}, {QRELS}, {_KEYWORD}, a AS (SELECT * FROM (WITH {_bm25('corpus', 'id', False)}, {_RANKED}, {_RECALL} SELECT * FROM rec)),
b AS (SELECT * FROM (WITH ranked AS (SELECT * FROM kwr), {_RECALL} SELECT * FROM rec))
SELECT 'bm25' AS retriever, count(*) AS queries, round(avg(recall_3), 6) AS recall_3, round(avg(recall_10), 6) AS recall_10, count(*) FILTER (WHERE all_10) AS all_10 FROM a
UNION ALL SELECT 'keyword', count(*), round(avg(recall_3), 6), round(avg(recall_10), 6), count(*) FILTER (WHERE all_10) FROM b""",
    "rerank_window_max": f"""{_BASE}, w AS (SELECT id, {tok('text')} AS t FROM corpus), q AS (SELECT qid, list_distinct({tok('question')}) AS q FROM questions),
c AS (SELECT r.qid, r.id, r.rank, t, q, greatest(len(t) - 64, 0) AS last FROM ranked r JOIN w USING (id) JOIN q USING (qid) WHERE rank <= 20),
s AS (SELECT *, list_sort(list_distinct(list_concat(range(0, last + 1, 64), [last]))) AS every FROM c),
m AS (SELECT qid, id, rank, t, q, unnest(CASE WHEN len(every) <= 8 THEN every ELSE list_concat(every[1:7], every[-1:]) END) AS pos FROM s),
g AS (SELECT qid, id, rank AS old_rank, CAST(max(len(list_intersect(t[pos + 1 : pos + 64], q))) AS BIGINT) AS score FROM m GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old_rank) AS rank, id, old_rank, score FROM g""",
    "linked_title_hop": f"""{_BASE}, tk AS (SELECT id AS linked_id, array_to_string({tok("array_to_string(string_split(title, ' ')[1:3], ' ')")}, ' ') AS key FROM corpus),
l AS (SELECT DISTINCT qid, id, array_to_string({tok("array_to_string(string_split(line, ' ')[1:3], ' ')")}, ' ') AS key FROM (SELECT qid, r.id, unnest(string_split(text, chr(10))) AS line FROM ranked r JOIN corpus USING (id) WHERE rank <= 3)),
n AS (SELECT DISTINCT qid, linked_id, key FROM tk JOIN l USING (key) WHERE key LIKE '% %' AND linked_id <> id AND (qid, linked_id) NOT IN (SELECT qid, id FROM ranked WHERE rank <= 3))
SELECT qid, linked_id, key FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY key, linked_id) AS n FROM n) WHERE n = 1""",
    "replay_top3": f"""{_BASE}, g AS (SELECT qid, list(id ORDER BY rank) AS ids FROM ranked WHERE rank <= 3 GROUP BY qid)
SELECT qid, array_to_string(ids, ',') AS ids, ids = CASE WHEN qid % 7 = 0 THEN list_reverse(ids) ELSE ids END AS same FROM g""",
}
