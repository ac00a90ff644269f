"""Queries of searches that follow one another, beside their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hops as H
from ..operators import retrieval as R
from ..scratch import written
from ..tables import CORPUS, QUESTIONS, corpus, questions
from .retrieval import _RANKED, _bm25


def query_variants(spark, sf):
    """Every narrow query that is made of a benchmark item's own phrases, clauses and words."""
    return H.question_variants(questions(spark, sf)).drop("key")


def linked_title_searches(spark, sf):
    """Two hops over titles named anywhere in the whole texts found last."""
    return H.linked_titles(questions(spark, sf), corpus(spark, sf))


def fact_questions(asked, docs):
    """(qid, title, quote): the first long line of the best and of the fifth document of each question; a first search shows three."""
    ranked = R.bm25_search(docs, asked, 5, boost=False).filter("rank in (1, 5)").select("qid", "id")
    line = F.get(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 24), F.lit(0))
    return docs.join(R.few(written(ranked)), "id").select("qid", "title", line.alias("quote")).filter("quote is not null")


def oracle_search_paths(spark, sf):
    """The shortest greedy path of searches that shows both facts of an item; every sentence of the whole texts seen is asked, uncut."""
    asked, docs = questions(spark, sf), corpus(spark, sf)
    return H.oracle_paths(asked, docs, written(fact_questions(asked, docs)), sentences=None, variants=None, chars=None).select("qid", "n_facts", "n_closed", "n_searches", F.array_join("queries", "\n").alias("queries"))


QUERIES = {f.__name__: f for f in (query_variants, linked_title_searches, oracle_search_paths)}

_NORM = "trim(regexp_replace(lower({x}), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_WORDS = "regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[㐀-䶿一-鿿豈-﫿]|[a-z0-9]+')"
_PHRASE, _WORD = H.PHRASE.replace("'", "''").replace(r"\t", "\t").replace(r"\n", "\n"), H.WORD.replace("'", "''")
_KEY = lambda x: f"array_to_string(({_WORDS.format(x=x)})[1:{H.TITLE_WORDS}], ' ')"


def _hop(n: int, visible: str, seen: str, used: str) -> str:
    """One hop: titles in the documents of ``visible``, the first whose search shows a document that is not in ``seen``."""
    return f"""shown{n} AS (SELECT qid, rank, v.id, {_KEY("title")} AS own, ' ' || array_to_string({_WORDS.format(x="text")}, ' ') || ' ' AS body FROM ({visible}) v JOIN corpus c ON c.id = v.id),
found{n} AS (SELECT s.qid, s.rank, strpos(s.body, ' ' || t.title_key || ' ') AS place, t.title_key FROM shown{n} s JOIN titles t ON contains(s.body, ' ' || t.title_key || ' ') JOIN asked_keys a ON a.qid = s.qid
  WHERE length(replace(t.title_key, ' ', '')) >= {H.LEAST_TITLE} AND NOT contains(a.question_key, ' ' || t.title_key || ' ') AND (s.qid, t.title_key) NOT IN (SELECT qid, own FROM shown{n}) AND (s.qid, t.title_key) NOT IN (SELECT qid, title_key FROM ({used}))),
new{n} AS (SELECT f.* FROM found{n} f JOIN title_results r USING (title_key) WHERE (f.qid, r.id) NOT IN (SELECT qid, id FROM ({seen}))),
chosen{n} AS (SELECT qid, title_key FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, place, -length(title_key), title_key) AS n FROM new{n}) WHERE n = 1),
step{n} AS (SELECT qid, {n} AS hop, title_key, r.rank, r.id FROM chosen{n} JOIN title_results r USING (title_key))"""


_FIRST = "SELECT qid, rank, id FROM first_results"
ORACLES = {
    "query_variants": f"""WITH {QUESTIONS}, q AS (SELECT qid, question AS q FROM questions), p AS (SELECT qid, q, list_filter(regexp_extract_all(q, '({_PHRASE})'), lambda x: length(x) >= 5 AND lower(x) NOT IN {_IN(H.OPENERS)}) AS p,
list_filter(list_transform(string_split(array_to_string(list_transform(regexp_split_to_array(q, '[ \t\n]+'), lambda w: CASE WHEN lower(w) IN {_IN(H.CONJUNCTIONS)} THEN chr(1) ELSE w END), ' '), chr(1)), lambda c: trim(c, ' ?.,')), lambda c: length(c) >= 12) AS c,
list_filter(regexp_extract_all(q, '({_WORD})'), lambda w: length(w) >= 3 AND lower(w) NOT IN {_IN(H.FILLERS)}) AS w FROM q),
a AS (SELECT qid, list_concat([q], flatten(list_transform(p, lambda x: [x, q || ' ' || x])), c, {', '.join(f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' '))" for n in (2, 3, 4))}, w) AS a FROM p),
e AS (SELECT qid, i - 1 AS place, a[i] AS query, {_NORM.format(x='a[i]')} AS key FROM (SELECT qid, a, unnest(range(1, len(a) + 1)) AS i FROM a))
SELECT qid, min(place) AS place, arg_min(query, place) AS query FROM e WHERE key <> '' GROUP BY qid, key""",
    "linked_title_searches": f"""WITH {CORPUS}, asked AS (SELECT item_id AS qid, replace(text, chr(10), ' ') AS question FROM benchmark), asked_keys AS (SELECT qid, ' ' || array_to_string({_WORDS.format(x="question")}, ' ') || ' ' AS question_key FROM asked),
titles AS (SELECT title_key, min(title) AS title FROM (SELECT {_KEY("title")} AS title_key, title FROM corpus) WHERE title_key <> '' GROUP BY title_key),
questions AS (SELECT 'q' || qid AS qid, question FROM asked UNION ALL SELECT 't' || title_key, title FROM titles), {_bm25('corpus', 'id', False)}, {_RANKED},
first_results AS (SELECT a.qid, rank, id FROM ranked r JOIN asked a ON r.qid = 'q' || a.qid WHERE rank <= 3), title_results AS (SELECT substr(qid, 2) AS title_key, rank, id FROM ranked WHERE qid LIKE 't%' AND rank <= 3),
{_hop(1, _FIRST, "SELECT qid, id FROM first_results", "SELECT -1 AS qid, '' AS title_key")},
{_hop(2, "SELECT qid, rank, id FROM step1", "SELECT qid, id FROM first_results UNION ALL SELECT qid, id FROM step1", "SELECT qid, title_key FROM chosen1")}
SELECT * FROM step1 UNION ALL SELECT * FROM step2""",
}
