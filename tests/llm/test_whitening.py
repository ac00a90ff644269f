import math
from fractions import Fraction

import numpy as np
import pytest
from lodestone.llm import whitening


def fine(rows):
    keep = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in keep), default=0)
    return [(i, tuple(v) + (0,) * (width - len(v))) for i, v in keep]


def brute(rows, k=4):
    """Exact means and covariance in fractions, eigenvectors by numpy's symmetric solver."""
    rows = fine(rows)
    fit = sorted({v for _, v in rows})
    n, width = len(fit), len(fit[0]) if fit else 0
    if not width:
        return {}
    sums = [sum(c) for c in zip(*fit, strict=True)]
    off = [[Fraction(x) - Fraction(s, n) for x, s in zip(v, sums, strict=True)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in off) / n) for j in range(width)] for i in range(width)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    kept = [c for c in range(min(k, width)) if e[c] > 1e-12 * max(e[0], 1e-300)] if e[0] > 0 else []
    return {(at, c + 1): (i, n, sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)), float(np.dot([float(x - Fraction(s, n)) for x, s in zip(v, sums, strict=True)], w[:, c])) / math.sqrt(e[c]), e[c] / np.trace(cov)) for at, (i, v) in enumerate(rows) for c in kept}


def vectors(n, width, seed=0):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate((r.normal(size=(n, width)) * np.linspace(3, 0.3, width)) @ np.linalg.qr(r.normal(size=(width, width)))[0] + 5)]


ODD = [(1, None), (2, [1.0, None, 2.0]), (3, [float("nan"), 1.0, 1.0]), (4, [float("inf"), 0.0, 1.0])]


@pytest.mark.parametrize("rows", [
    vectors(300, 6) + ODD,
    vectors(120, 3) + vectors(60, 3) + [(500, [0.1, 0.2, 0.3])] * 200,
    [(1, [1.0, 2.0]), (2, [3.0]), (3, []), (3, [0.5, -7.25]), (None, [2.0, 2.0])],
    [(i, [float(i), 2.0 * i, 1.0]) for i in range(50)],
    [(i, [1e6 + x, x * x / 9]) for i, x in enumerate(range(40))],
    [(1, [1.0, 2.0]), (2, [1.0, 2.0])],
    ODD,
    [(1, []), (2, [])],
    [],
])
def test_like_exact_covariance(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n string").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = whitening.query(spark, str(tmp_path))
    got = df.collect()
    want = list(brute(rows).values())
    assert len(got) == len(want)
    key = lambda i, dev, c: (i is None, i or 0, dev, c)
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got), key=lambda r: key(r[0], r[3], r[1]))
    want = sorted(((i, c, *rest) for (_, c), (i, *rest) in brute(rows).items()), key=lambda r: key(r[0], r[3], r[1]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in got}:
        a, b = np.array([r[4] for r in got if r[1] == c]), np.array([r[4] for r in want if r[1] == c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    assert all(abs(a[5] - b[5]) <= 1e-9 * b[5] for a, b in zip(got, want, strict=True))
    assert all(r["identity_error"] < 1e-9 for r in df.collect())


def test_small_singular_values():
    """Columns of lengths over twelve orders: one-sided rotations keep the small values' digits, the squared matrix would not."""
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.normal(size=(200, 7)))[0]
    values = 10.0 ** np.arange(0, -14, -2)
    s, v = whitening.jacobi(whitening.triangle(q * values))
    assert np.allclose(s, values, rtol=1e-10)
    assert np.abs(v.T @ v - np.eye(7)).max() < 1e-13


@pytest.mark.parametrize("shape", [(50, 1), (3, 8), (100, 9), (400, 64)])
def test_jacobi(shape):
    a = np.random.default_rng(1).normal(size=shape)
    s, v = whitening.jacobi(whitening.triangle(a))
    assert np.allclose(s[: min(shape)], np.linalg.svd(a, compute_uv=False), rtol=1e-12)
    assert np.abs(v.T @ v - np.eye(shape[1])).max() < 1e-12


def test_triangles_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 4)
    rows = [v for _, v in fine(vectors(90, 5))]
    sums = [sum(c) for c in zip(*rows, strict=True)]
    r = whitening.tsqr(spark.createDataFrame([(list(v),) for v in rows], "v array<bigint>").repartition(9), 5, 90, sums)
    x = whitening.centred(np.array(rows), 90, sums)
    assert r.shape == (5, 5) and np.allclose(r.T @ r, x.T @ x, rtol=1e-12)


def test_large_entries(spark):
    """Deviations beyond a long are held to its range; sums beyond it are exact."""
    df = spark.createDataFrame([(1, [3e16]), (2, [-3e16]), (3, [3e16 - 512])], "vec_id long, embedding array<double>")
    rows = whitening.integers(df)
    model = whitening.fit(whitening.distinct_vectors(rows))
    assert model.sums == [256 * (int(3e16 - 512))] and model.n == 3
    assert {r["deviation"] for r in whitening.whitened(rows, model).collect()} == {2**63 - 1}
