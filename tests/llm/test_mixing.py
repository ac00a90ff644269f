import re
from collections import defaultdict

from lodestone.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string, target long")


def by_hand(sizes):
    """Water filling by repeated resharing."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: 3 * sizes[s] for s in above}


def test_targets_and_copies(spark):
    rows = [(i, ["a", "B", "é", None, "tiny"][i % 5], "w " * (i % 7 if i % 5 < 4 else 0) + ("x" if i == 4 else ""), "clash", 5) for i in range(200)]
    rows += [(200, "a", None, None, None), (201, "a", "", None, None), (0, "a", "", None, None)]
    sizes, n = defaultdict(int), {}
    for i, s, t, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = by_hand(dict(sizes))
    got = mixing.rates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["taken"] == r["size"] * r["copies"] and r["taken"] <= 3 * r["size"]
    for r, (_, s, t, *_) in zip(sorted(got, key=lambda r: (r["doc_id"], -r["size"])), sorted(rows, key=lambda r: (r[0], -len(r[2] or ""))), strict=True):
        assert abs(r["target"] - want[s]) < 1e-9 and r["source_size"] == sizes[s]
    again = mixing.rates(frame(spark, rows).repartition(7)).collect()
    assert sorted(got) == sorted(again)
    mixed = mixing.mix(frame(spark, rows)).collect()
    assert len(mixed) == sum(r["copies"] for r in got)
    assert "copy" in mixed[0].asDict()


def test_empty(spark):
    assert mixing.rates(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [])).count() == 0


def test_all_empty_texts(spark):
    got = mixing.rates(frame(spark, [(1, "a", None, None, None), (2, None, "", None, None)])).collect()
    assert [(r["size"], r["taken"]) for r in got] == [(0, 0), (0, 0)]
