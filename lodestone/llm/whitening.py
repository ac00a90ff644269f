"""Operator 12: whitening of embeddings by a one-sided Jacobi SVD.

Components become integers; each distinct vector counts once.  A task reduces its centred rows, block by block, to the
triangle R of a QR factorisation; triangles of some tasks at a time are stacked and factorised again (TSQR), until one is
left, as large as the dimension squared.  Plane rotations then make R's columns orthogonal (one-sided Jacobi); the
lengths of the columns are the singular values, accurate also where they are small, and the accumulated rotations the
components.  The covariance matrix itself is never formed, so no digits are lost by squaring.

Defined cases: a vector that is null, or holds a null or non-finite entry, is dropped; shorter vectors are padded with
zeros to the longest, empty ones too; whole numbers are held to the range of a long, as is ``deviation``; components
without variance (below ``RANK`` times the largest singular value) can't be whitened and are left out, so a table of
one distinct vector gives no rows, as an empty one does; rows that repeat a vector or an id are each returned; other
columns are not read.  A component's sign makes its largest entry (the first of equal ones) positive.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

SCALE, COMPONENTS = 256, 4
#: Triangles that are stacked at a time, rows that are factorised at a time, and sweeps of rotations at most.
FAN, BLOCK_ROWS, SWEEPS = 16, 4096, 60
#: Singular values below this share of the largest are zero.
RANK = 1e-13
_LOW, _HIGH = -(2**63), 2**63 - 1


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    components: np.ndarray  # columns
    deviations: np.ndarray  # the components' standard deviations, falling
    explained: np.ndarray  # their shares of the variance


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v: array<bigint>); rows whose vector is null or holds null or non-finite entries are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(fine).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _whole(column, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    sizes, values = np.diff(column.offsets.to_numpy()), column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    if (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, n in enumerate(sizes):
        out[i, :n] = values[offsets[i] : offsets[i] + n]
    return out


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """rows - sums / n with one rounding of the mean's whole part taken out first, so that large means cost no digits."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    if rows.size and max(abs(int(rows.max())), abs(int(rows.min())), *(abs(int(w)) for w in whole)) >= 2**62:
        return rows.astype(float) - whole.astype(float) - rest
    return (rows - whole).astype(float) - rest


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _as_rows(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])


def tsqr(rows: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows (column v): blocks within a task, then triangles of FAN tasks at a time."""

    def local(batches):
        from pyspark import TaskContext

        r, held, count = np.zeros((0, width)), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(centred(_whole(batch.column("v"), width), n, sums))
                count += batch.num_rows
                if count >= BLOCK_ROWS:
                    r, held, count = triangle(np.vstack([r, *held])), [], 0
        if held or len(r):
            yield _as_rows(TaskContext.get().partitionId(), triangle(np.vstack([r, *held])))

    def stacked(table: pa.Table) -> pa.Table:
        r = np.zeros((0, width))
        for x in table.column("r").to_pylist():
            r = triangle(np.vstack([r, np.frombuffer(x).reshape(-1, width)]))
        return pa.Table.from_batches([_as_rows(table.column("part")[0].as_py(), r)])

    found, parts = arrow_map(rows.select("v"), local, "part int, r binary"), rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        found = found.withColumn("part", F.col("part") % parts).groupBy("part").applyInArrow(stacked, "part int, r binary")
    got = found.select("r").collect()  # one row
    return np.frombuffer(bytes(got[0]["r"])).reshape(-1, width) if got else np.zeros((0, width))


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) by rotations of pairs of columns.

    The disjoint pairs of a round robin are rotated at once.  Columns are first put in order of length, which is what
    makes the small singular values accurate."""
    width = r.shape[1]
    a = np.vstack([r, np.zeros((max(0, width - len(r)), width))])
    order = np.argsort(-np.sqrt((a**2).sum(0)), kind="stable")
    a, v = a[:, order].copy(), np.eye(width)[:, order]
    n = width + width % 2
    ring = list(range(n))
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(n - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: n // 2], reversed(ring[n // 2 :]), strict=True) if max(p, q) < width]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = (np.abs(gamma) > 1e-15 * size) & (size > 1e-290)
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = np.where(turn, 1 / np.hypot(1, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if worst < 1e-14:
            break
    length = np.sqrt((a**2).sum(0))
    order = np.argsort(-length, kind="stable")
    v = v[:, order]
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(0)[None, :], 0)[0] < 0, -1.0, 1.0) if width else v
    return length[order], v


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """The fit list: each distinct vector once, padded alike; copies meet within their task first."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))
    return rows.select(F.concat("v", zeros).alias("v")).distinct()


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of the distinct vectors (column v of whole numbers, all of one width); None without variance."""
    width, n = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    if not width:
        return None

    def partial(batches):
        sums = [0] * width
        for batch in batches:
            if batch.num_rows:
                m = _whole(batch.column("v"), width)
                small = max(abs(int(m.max())), abs(int(m.min()))) * len(m) < 2**62
                sums = [a + int(b) for a, b in zip(sums, m.sum(axis=0) if small else m.astype(object).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(s) for s in sums])], names=["i", "s"])

    per = arrow_map(vectors.select("v"), partial, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [0] * width
    for row in per.collect():  # one row for each dimension
        sums[row["i"]] = int(row["s"] or 0)
    length, v = jacobi(tsqr(vectors, width, n, sums))
    kept = int((length > RANK * length[0]).sum()) if length[0] > 0 else 0
    if not kept:
        return None
    return Whitening(n, sums, v[:, :kept], length[:kept] / np.sqrt(n), length[:kept] ** 2 / (length**2).sum())


def projected(rows: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    return centred(rows, model.n, model.sums) @ (model.components[:, :k] / model.deviations[:k])


def identity_error(vectors: DataFrame, model: Whitening, k: int) -> float:
    """The largest entry, in absolute value, of the whitened fit list's covariance minus the identity: sums of products for each task."""
    width = len(model.sums)

    def partial(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                z = projected(_whole(batch.column("v"), width), model, k)
                first += z.sum(0)
                second += z.T @ z
        both = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(both)), pa.int32()), pa.array(both)], names=["i", "s"])

    sums = np.zeros(k + k * k)
    for row in arrow_map(vectors.select("v"), partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # k + k * k rows
        sums[row["i"]] = row["s"]
    mean = sums[:k] / model.n  # of centred rows, so a rounding error; what it adds is taken off
    return float(np.abs(sums[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained) of every row and its first k components."""
    k, width = min(k, len(model.deviations)), len(model.sums)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    sums = np.array(model.sums, dtype=object)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _whole(batch.column("v"), width)
            z = projected(m, model, k)
            off = m.astype(object) * model.n - sums
            most = max((abs(x) for x in off.ravel()), default=0)
            off = off.astype(np.int64) if most * most * width < 2**63 else off
            deviation = [max(_LOW, min(_HIGH, int(x))) for x in (off * off).sum(axis=1)]
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(m)), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1), len(m)), pa.int32()), pa.array([model.n] * (k * len(m)), pa.int64()), pa.array(np.repeat(np.array(deviation, np.int64), k)), pa.array(z.ravel()), pa.array(np.tile(model.explained[:k], len(m)))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return arrow_map(rows.select("vec_id", "v"), run, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = integers(vectors)
    once = written(distinct_vectors(rows))
    model = fit(once)
    if model is None:
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whitened(rows, model).withColumn("identity_error", F.lit(identity_error(once, model, min(COMPONENTS, len(model.deviations)))))
