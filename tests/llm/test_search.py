import math
import random

import pytest
from lodestone.llm import search


def brute(rows, k=10, every=100):
    fine = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, w in {i: min(v for j, v in fine if j == i) for i, _ in fine}.items():
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, v in fine if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(n, width=8, seed=1):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [c * r.choice([0.2, 1, 3]) + r.gauss(0, 0.2) for c in centre[i % 4]]) for i in range(n)]


@pytest.mark.parametrize("rows", [
    vectors(700),
    vectors(500)[:450] + [(i, [1.0] * 8) for i in range(1000, 1400)] + [(1, [0.5] * 8), (100, [1.0] * 8)],
    [(0, [1.0, None]), (100, None), (200, [float("nan")]), (300, []), (400, [0.5, float("inf")]), (500, [1.0, 2.0]), (7, [1.0]), (8, [2.0, 1.0, 5.0])],
    [(0, [1e13, -3e12]), (1, [2e9, 7.25]), (2, [1e300, 1.0]), (3, [0.1, 0.2]), (100, [0.0, 0.0])],
    [(100, [1.0])],
    [],
])
def test_like_brute_force(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in search.query(spark, str(tmp_path)).collect())
    want = brute(rows)
    assert got == want


def test_blocks_of_queries(spark, monkeypatch):
    rows = vectors(300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(search, "QUERY_ROWS", 2)
    monkeypatch.setattr(search, "BLOCK_ROWS", 16)
    got = sorted(tuple(r) for r in search.top_k(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == brute(rows, every=50)
