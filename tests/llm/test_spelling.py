import re
import zlib
from collections import Counter

import pytest
from lodestone.llm import spelling


def words_of(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words, out = words_of(rows), {}
    for w, n in words.items():
        near = sorted((-words[o], o) for o in words if distance_one(w, o))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    result = []
    for w, (form, n, count, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.append((w, form, root, n, count, form_n))
    return sorted(result)


def texts():
    out = [(i, "Orientation orientation oriéntation, colourful! colorful banana1bananas ") for i in range(60)]
    out += [(i, "orientatio orientatiom ORIENTATIONS orientationss colourfull x") for i in range(100, 103)]
    out += [(i, "aaaaaaaa aaaaaaa aaaaaab aaaabaa zzaaaaaa") for i in range(200, 205)]
    out += [(300 + i, "straßene ÿÀÿÀÿÀÿ ÿÀÿÀÿÀ× element÷ element×") for i in range(30)]
    return out


@pytest.mark.parametrize("rows", [
    texts(),
    [(i, "chainabc " * 400 + "chainabd " * 35 + "chainabe " * 3) for i in range(1)] + [(9, "chainxbe chainxbe chainxbe")],
    texts()[:50] * 3 + [(None, "nothing Nothing nothings"), (7, None), (8, "")],
    [(1, "q" * 3000 + " " + "q" * 2999 + "w " + "q" * 3001) , (2, "q" * 3000 + " " + "q" * 2999 + "w " + "q" * 3001)],
    [(1, "short words"), (2, "loneliness")],
    [],
])
def test_like_brute_force(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in spelling.query(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(got) == brute(rows)


def test_whole_table(spark):
    """All words of the smallest table; neighbours by the plain definition and a dictionary."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = words_of(rows)
    letters = "".join(sorted(set("".join(words))))
    got = {r["word"]: r for r in spelling.query(spark, sf).collect()}
    assert {w: r["n"] for w, r in got.items()} == words
    for w, n in words.items():
        near = sorted((-words[o], o) for o in spelling.neighbours(w, letters) if o in words)
        assert got[w]["n_near"] == len(near)
        assert got[w]["form"] == (near[0][1] if near and -near[0][0] >= 10 * n else None)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 21])
def test_every_neighbour_once(monkeypatch, at_once):
    """With a filter that lets all pass, exactly the distinct neighbours are generated, each once."""
    import numpy as np

    monkeypatch.setattr(spelling, "AT_ONCE", at_once)
    table = np.full(16, 2**64 - 1, np.uint64)
    words = ["aabbccd", "aaaaaaa", "abcabca", "bbbbbbba", "dcbadcbaé"]
    got = Counter(spelling._reached(words, "abcdé", table, 10))
    assert set(got.values()) == {1}
    assert set(got) == {(i, x) for i, w in enumerate(words) for x in spelling.neighbours(w, "abcdé")}


def test_full_filter_costs_no_result(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_BITS", 8)
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    got = [tuple(r) for r in spelling.grouped(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(got) == brute(texts())
