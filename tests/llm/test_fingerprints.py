import hashlib
import re
import struct

import pytest
import xxhash
from lodestone.llm import fingerprints
from pyspark.sql import functions as F


def chain(*values, seed=42):
    """Spark's xxhash64 of values: each hash seeds the next."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q" if v >= 2**31 or v < -(2**31) or isinstance(v, Long) else "<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


class Long(int):
    pass


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def naive(text):
    """The fingerprint by its definition: number the k-mers, order them by hash, take two of each cell, hash them in text order."""
    letters = [w[i : i + 16] for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w for i in range(0, len(w), 16)]
    hashed = [Long(signed(chain(w))) for w in letters]
    kmers = [chain(*hashed[i : i + 3]) >> 30 for i in range(max(1, len(hashed) - 2))] if hashed else []
    seen, numbered = {}, []
    for place, top in enumerate(kmers):
        n = seen[top] = seen.get(top, -1) + 1
        numbered.append(((chain(Long(top), n) >> 30) if n else top, place))
    cells = {}
    for top, place in sorted(numbered):
        cells.setdefault(top >> 28, []).append((place, top))
    return {c: chain(*[Long(top) for _, top in sorted(two[:2])]) & 0xFFFFFFFF for c, two in cells.items()}


def like(a, b):
    return sum(b.get(c) == h for c, h in a.items()) / len(a.keys() | b.keys()) if a or b else 1.0


def as_text(cells):
    order = sorted(cells, key=lambda c: c if c < 32 else c - 64)
    return "".join(f"{c << 32 | cells[c]:010x}" for c in order)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(f"{'null' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()))
    once = list(dict.fromkeys(rows))
    follows = dict(zip(once, once[1:] + once[:1], strict=True))
    out = []
    for i, text in rows:
        after = follows[i, text][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, last = naive(text), naive(edited), naive(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other), like(own, other), like(own, last)))
    return sorted(out, key=repr)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.mark.parametrize("rows", [
    [(i, " ".join(f"word{(i * j * j) % 53}" for j in range(20 * i))) for i in range(1, 30)],
    [(5, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f g"), (None, "x y z"), (None, None), (7, ""), (8, None), (2, " \t\n"), (9, "one"), (10, "two words")],
    [(1, "again and " * 700), (2, "again and " * 701), (3, "日本語のテキスト" * 40), (4, "é" * 100 + " " + "😀" * 33), (6, " lead and trail \n")],
    [(1, LONG), (2, LONG + " end"), (3, "word " * 50_000)],
    [(1, "alone here by itself")],
    [],
])
def test_like_its_definition(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, print string, n_chars int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_order_counts(spark):
    """The same lines in another order share their content, not their pairs."""
    lines = [f"line {i} holds the words a{i} b{i} c{i}" for i in range(200)]
    df = spark.createDataFrame([(0, " ".join(lines)), (1, " ".join(reversed(lines))), (2, " ".join(lines[:-5]))], "i int, text string")
    near = {r["i"]: r["x"] for r in fingerprints.fingerprinted(df, "text", "p").alias("a").join(fingerprints.fingerprinted(df.filter("i = 0"), "text", "q").select("q"), F.lit(True)).select("i", fingerprints.likeness(F.col("p"), F.col("q")).alias("x")).collect()}
    assert near[0] == 1.0 and near[2] > 0.8 and near[1] < 0.65


def test_no_python_worker(spark):
    plan = fingerprints.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas") if x in plan]


def test_passes_columns_through(spark):
    df = spark.createDataFrame([(1, "a b c", "kept")], "id int, `te.xt` string, print string")
    assert fingerprints.fingerprinted(df, "te.xt", "print").columns == ["id", "te.xt", "print"]
