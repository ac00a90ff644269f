import random

import pytest
from lodestone.llm import ngram_join as nj


def near_copies(seed=1, groups=6, members=14, words=60):
    """Groups whose members differ by few edits, around the threshold, with shared passages and short texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)] + ["Éa", "B"]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(words + 10 * g)]
        for _ in range(members):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                at = r.randrange(len(w))
                r.choice([lambda: w.__setitem__(at, r.choice(vocabulary)), lambda: w.insert(at, r.choice(vocabulary)), lambda: w.pop(at)])()
            out.append(" ".join(w))
    for _ in range(25):
        out.append(" ".join([r.choice(vocabulary) for _ in range(r.randrange(5, 40))] + passage))
    out += ["a b", "A  b", "a b c d", "a b c d", "", None, "  ", "x", "a b c d e", passage and " ".join(passage), " ".join(passage[:-1]), "one word " * 5000]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "size", "num"), [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_like_brute_force(spark, monkeypatch, seed, size, num):
    monkeypatch.setattr(nj, "HOT", 3)
    rows = near_copies(seed)
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n int").repartition(5)
    sets, classes, found = nj.linked(df, size, num, 100, chunk=4)
    got = sorted(tuple(r) for r in nj.components_of(df, size, num).collect())
    assert got == sorted(nj.brute(rows, size, num))
    kept = sorted(r["doc_id"] for r in nj.keep_one(df, size, num).collect())
    assert kept == [i for i, _, c in nj.brute(rows, size, num) if i == c]


def test_tree_finds_all_links():
    import numpy as np

    r = random.Random(9)
    for _ in range(60):
        universe = [(r.randrange(2, 9), r.randrange(10**12)) for _ in range(40)]
        base = r.sample(universe, 20)
        sets = []
        for _ in range(r.randrange(2, 14)):
            s = set(base) if r.random() < 0.7 else set(r.sample(universe, 15))
            s = {x for x in s if r.random() < 0.93} | set(r.sample(universe, r.randrange(3)))
            sets.append(s or {universe[0]})
        extra = [r.randrange(3) for _ in sets]
        sizes = [len(s) + e for s, e in zip(sets, extra)]
        paths = [np.sort(nj.placed(np.array([f for f, _ in s]), np.array([t * 64 for _, t in s]))).tobytes() for s in sets]
        sides = r.choice([[0] * len(sets), [i % 2 for i in range(len(sets))]])
        ids = list(range(len(sets)))

        def closed(links):
            parent = list(ids)
            for a, b in links:
                a, b = parent[a], parent[b]
                parent = [min(a, b) if x in (a, b) else x for x in parent]
            return parent

        want = [(i, j) for i in ids for j in range(i) if 185 * len(sets[i] & sets[j]) >= 85 * (sizes[i] + sizes[j]) and (len(set(sides)) == 1 or sides[i] != sides[j])]
        got = nj.tree_links(ids, sizes, ids, paths, sides, 85, 100)
        assert set(map(frozenset, got)) <= set(map(frozenset, want)) and closed(got) == closed(want)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z z"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in nj.components_of(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 1, None), (3, 0, 3)], key=repr)
    assert nj.components_of(df.limit(0)).count() == 0
