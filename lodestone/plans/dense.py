"""Queries of dense and fused retrieval, each beside its DuckDB statement."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dense as V
from ..operators import retrieval as R
from ..scratch import _made, scratch
from ..tables import CORPUS, QRELS, QUESTIONS, corpus, qrels, questions
from .retrieval import _RECALL, _bm25, tok

ENCODER = V.HashingEncoder()


def _index(spark, sf):
    c = corpus(spark, sf)
    path = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    V.build_index(c, path, ENCODER)
    _made.append((spark, path))
    return c, path


def dense_index_build(spark, sf):
    """An index built, opened against its manifest, and audited."""
    c, path = _index(spark, sf)
    return V.audit(V.open_index(c, path, ENCODER), ENCODER.width)


def _asked(spark, sf):
    """The questions and a blank one, which nothing answers."""
    return questions(spark, sf).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("qid"), F.lit(" ").alias("question")))


def hybrid_modes(spark, sf):
    """The three best documents of each question in each mode."""
    c, path = _index(spark, sf)
    vectors, asked = V.open_index(c, path, ENCODER), _asked(spark, sf)
    found = [V.search(c, vectors, asked, ENCODER, mode).withColumn("mode", F.lit(mode)) for mode in V.MODES]
    return found[0].unionByName(found[1]).unionByName(found[2])


def hybrid_recall(spark, sf):
    """Mean recalls at 3 and 10 of each mode."""
    c, path = _index(spark, sf)
    vectors, asked, rel = V.open_index(c, path, ENCODER), _asked(spark, sf), qrels(spark, sf)
    one = lambda mode: R.recall(V.search(c, vectors, asked, ENCODER, mode, 10), rel).agg(F.count("*").alias("queries"), F.round(F.avg("recall_3"), 6).alias("recall_3"), F.round(F.avg("recall_10"), 6).alias("recall_10"), F.count_if("all_10").alias("all_10")).withColumn("mode", F.lit(mode))
    return one(V.MODES[0]).unionByName(one(V.MODES[1])).unionByName(one(V.MODES[2]))


QUERIES = {f.__name__: f for f in (dense_index_build, hybrid_modes, hybrid_recall)}

_W = f"wt AS (SELECT id, {tok('text')} AS t FROM corpus), wc AS (SELECT id, chunk, t[chunk * 188 + 1 : chunk * 188 + 220] AS t FROM (SELECT id, t, unnest(range(0, CAST(greatest(0, ceil((len(t) - 220) / 188)) AS BIGINT) + 1)) AS chunk FROM wt))"
_VEC = """(SELECT {k}, list_transform(range(0, 64), lambda d: coalesce(m[d], 0)::DOUBLE) AS v FROM (SELECT {k}, map_from_entries(list((dim, x))) AS m FROM
(SELECT {k}, CAST('0x' || substr(h, 1, 4) AS BIGINT) % 64 AS dim, CAST(sum(1 - 2 * (CAST('0x' || substr(h, 5, 1) AS BIGINT) % 2)) AS BIGINT) AS x FROM (SELECT {k}, md5(unnest(t)) AS h FROM {f}) GROUP BY ALL) GROUP BY {k}))"""
_DENSE = f"""{_W}, cv AS (SELECT wc.id, wc.chunk, v FROM wc LEFT JOIN {_VEC.format(k='id, chunk', f='wc')} USING (id, chunk)),
qv AS (SELECT q.qid, v FROM questions q LEFT JOIN {_VEC.format(k='qid', f='(SELECT qid, ' + tok('question') + ' AS t FROM questions)')} USING (qid)),
dn AS (SELECT qid, id, max(coalesce(list_sum(list_transform(list_zip(qv.v, cv.v), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform(qv.v, lambda z: z * z))) * sqrt(list_sum(list_transform(cv.v, lambda z: z * z))), 0), 0.0)) AS s FROM qv, cv GROUP BY qid, id),
dr AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank, id, round(s, 6) AS score FROM dn),
sr AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank, id, round(score, 6) AS score FROM scored),
fs AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT qid, id, rank FROM sr WHERE rank <= 20 UNION ALL SELECT qid, id, rank FROM dr WHERE rank <= 20) GROUP BY qid, id),
fr AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, id) AS rank, id, round(s, 8) AS score FROM fs),
every AS (SELECT 'bm25-v2' AS mode, * FROM sr UNION ALL SELECT 'dense-v1', * FROM dr UNION ALL SELECT 'hybrid-rrf-v1', * FROM fr)"""
_ALL = f"WITH {CORPUS}, {QUESTIONS}, {_bm25('corpus', 'id', False)}, {_DENSE}"
_ONE = "SELECT '{m}' AS mode, count(*) AS queries, round(avg(recall_3), 6) AS recall_3, round(avg(recall_10), 6) AS recall_10, count(*) FILTER (WHERE all_10) AS all_10 FROM (WITH ranked AS (SELECT qid, rank, id FROM every WHERE mode = '{m}'), {r} SELECT * FROM rec)"
ORACLES = {
    "dense_index_build": f"WITH {CORPUS}, {_W} SELECT count(*) AS chunks, count(DISTINCT id) AS documents, 0::BIGINT AS misshapen, 0::BIGINT AS not_unit, 0::BIGINT AS not_finite FROM wc",
    "hybrid_modes": f"{_ALL} SELECT mode, qid, rank, id, score FROM every WHERE rank <= 3",
    "hybrid_recall": f"{_ALL}, {QRELS} " + " UNION ALL ".join(_ONE.format(m=m, r=_RECALL) for m in V.MODES),
}
