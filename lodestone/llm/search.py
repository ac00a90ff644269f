"""Operator 7: exact top-k by inner product.

Components become integers.  Vectors are dealt out by descending length; a block of them is rotated by the right
singular vectors of the whole table (from its Gram matrix, which is as small as the dimension squared), so that few
leading components hold most of an inner product.  For a block of queries, a partial sum over the leading components
plus the Cauchy-Schwarz bound of the rest says which pairs can still reach a query's k-th score; only those are summed
exactly, in integers.  As lengths fall, |q||x| alone rules out a whole block and ends the run for a query.

Queries come in blocks of bounded size, each joined with all rows by one narrow pass, whose k best are written before
the next block comes if there are several, so the driver and a task hold one block at a time.  No pair is shuffled, only
the k best of a query for each task, so a query's rows in the last step number at most k for each task.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; vectors of other
lengths are padded with zeros; where sums pass 2^53 they are made in Python's integers and scores held to the range of
a long; ties go to the smaller vec_id; rows that repeat a vec_id are each a candidate, and one query, with the smallest of
their vectors (component by component); a query's own rows (all with its vec_id) are no candidates; an empty table gives no rows; no other column is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, written

SCALE, K, EVERY = 1024, 10, 100
#: Queries of one pass, and vectors of one block.
QUERY_ROWS, BLOCK_ROWS = 4096, 1024
#: Bytes of a task's vectors, on average.
TASK_BYTES = 32 << 20
#: Leading rotated components of the partial sums: a share of the dimension.
LEADING = 0.5


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v: array<double> of whole numbers); rows that take no part are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(fine & F.col("vec_id").isNotNull())
    # floor() of a double beyond the range of a long would be cut there, so whole numbers stay doubles
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column, width: int | None = None) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == sizes[0]).all() and (width is None or width == sizes[0]):
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)))
    for i, n in enumerate(sizes):
        out[i, :n] = values[offsets[i] : offsets[i] + n]
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the whole table, by descending singular value: eigenvectors of its Gram matrix."""

    def partial(batches):
        gram = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"), width)
                m = m / max(1.0, np.abs(m).max())
                gram += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), 1), pa.int32()), pa.array(list(gram), pa.list_(pa.float64()))], names=["i", "g"])

    sums = arrow_map(rows.select("v"), partial, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((width, width))
    for i, j, x in sums.collect():  # as many cells as the dimension squared
        gram[i, j] = x
    gram = np.nan_to_num((gram + gram.T) / 2)
    return np.linalg.eigh(gram)[1][:, ::-1]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of matching rows of whole numbers, exact; beyond doubles' whole numbers by Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q * x).sum(axis=1).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([min(high, max(low, sum(int(a) * int(b) for a, b in zip(r, s, strict=True)))) for r, s in zip(q, x, strict=True)], dtype=np.int64)


def _best(ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int):
    """For a task's vectors: the k best of each query."""
    width, lead = queries.shape[1], max(1, int(queries.shape[1] * LEADING))
    with np.errstate(over="ignore", invalid="ignore"):
        rotated = queries @ turn
        q_length, q_rest = np.sqrt((queries**2).sum(1)), np.sqrt((rotated[:, lead:] ** 2).sum(1))
    most = float(np.abs(queries).max(initial=0)) * width

    def run(batches):
        parts = [(batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width)) for batch in batches if batch.num_rows]
        if not parts:
            return
        own, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        with np.errstate(over="ignore"):
            length = np.sqrt((rows**2).sum(1))
        order = np.lexsort((own, -length))
        own, rows, length = own[order], rows[order], length[order]
        best_s, best_v = [np.empty(0, np.int64) for _ in ids], [np.empty(0, np.int64) for _ in ids]
        least = np.full(len(ids), -np.inf)  # each query's k-th score so far
        for at in range(0, len(own), BLOCK_ROWS):
            vec, x, n = own[at : at + BLOCK_ROWS], rows[at : at + BLOCK_ROWS], length[at]
            wild = not most * float(np.abs(x).max(initial=0)) < 2**53  # beyond doubles' whole numbers: no bound is sound, so each pair is summed
            slack = 1e-9 * q_length * n + 1e-6  # more than the rounding of the rotated sums
            live = np.arange(len(ids)) if wild else np.nonzero(q_length * n + slack >= least)[0]  # lengths fall: the other queries have ended
            if not len(live):
                break
            can = ids[live, None] != vec[None, :]
            if not wild:
                rx = x @ turn
                bound = rotated[live, :lead] @ rx[:, :lead].T + np.outer(q_rest[live], np.sqrt((rx[:, lead:] ** 2).sum(1))) + slack[live, None]
                can &= bound >= least[live, None]
            whole = None
            if can.mean() > 0.05 and not wild:
                whole = queries[live] @ x.T  # whole numbers that doubles hold exactly
            for i in np.nonzero(can.any(axis=1))[0]:
                q, xi = live[i], np.nonzero(can[i])[0]
                s = whole[i, xi].astype(np.int64) if whole is not None else exact(np.broadcast_to(queries[q], (len(xi), width)), x[xi])
                s, v = np.concatenate([best_s[q], s]), np.concatenate([best_v[q], vec[xi]])
                keep = np.lexsort((v, -s))[:k]
                best_s[q], best_v[q] = s[keep], v[keep]
                if len(keep) == k:
                    least[q] = best_s[q][-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(s) for s in best_s])), pa.array(np.concatenate(best_v)), pa.array(np.concatenate(best_s))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query; both frames have vec_id and embedding."""
    rows, asked = integers(vectors, scale), integers(queries, scale)
    widest, count = rows.agg(F.max(F.size("v")), F.count("*")).first()
    width = max(widest or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    schema = "query_id long, vec_id long, score long"
    if not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(rows, width)
    tasks = max(count * width * 8 // TASK_BYTES, min(count // BLOCK_ROWS, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))) + 1
    # dealt out by turns: a vector or a vec_id that many rows have fills no task
    longest_first = rows.withColumn("n", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).repartition(tasks).sortWithinPartitions(F.desc("n"), "vec_id").select("vec_id", "v")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def ask(block: list) -> DataFrame:
        ids = np.array([i for i, _ in block], dtype=np.int64)
        q = np.zeros((len(block), width))
        for i, (_, v) in enumerate(block):
            q[i, : len(v)] = v
        best = arrow_map(longest_first, _best(ids, q, turn, k), schema)
        return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found, block = None, []
    for row in asked.groupBy("vec_id").agg(F.min("v").alias("v")).toLocalIterator():
        if len(block) == QUERY_ROWS:
            own = written(ask(block))
            found, block = own if found is None else found.unionByName(own), []
        block.append((row["vec_id"], row["v"]))
    if not block:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return ask(block) if found is None else found.unionByName(written(ask(block)))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * c::DOUBLE) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q, e x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""
