"""Causes of flat groups and the gate of given-back search costs, by hand and beside all pairs."""

import random

from lodestone.operators import trajectory as J

KIND = "group_id string, reward double, correct boolean, invalid boolean, signature string, coverage int"


def test_causes(spark):
    rows = [("low", 0.0, False, False, s, 0) for s in "aab"] + [("wrong", 0.0, False, False, s, 1) for s in "abc"] + [("right", 1.0, True, False, s, n) for n, s in enumerate("abc")]
    rows += [("mixed", 0.5, False, False, s, n) for n, s in enumerate("abcd")] + [("varied", float(n), True, n == 0, s, 0) for n, s in enumerate("abc")]
    got = {r.cause: r for r in J.zero_variance_causes(spark.createDataFrame(rows, KIND)).collect()}
    assert {k: r.groups for k, r in got.items()} == {"low_action_diversity": 1, "diverse_actions_all_wrong_same_support_reward": 1, "diverse_actions_all_correct": 1, "diverse_actions_flat_composite_reward": 1}
    assert {(r.groups_flat, r.median_actions, r.invalid_rate, r.decision) for r in got.values()} == {(4, 3.0, 0.0625, "no_sampling_change")}
    low = [(g, 0.0, False, False, s, 0) for g in "xyz" for s in ("ab" if g != "z" else "abc")]
    assert {(r.median_actions, r.decision) for r in J.zero_variance_causes(spark.createDataFrame(low, KIND)).collect()} == {(2.0, "group_size_8")}
    bad = [(g, x, c, True, s, n) for g, x, c, _, s, n in low]
    assert {r.decision for r in J.zero_variance_causes(spark.createDataFrame(bad, KIND)).collect()} == {"no_sampling_change"}
    assert J.zero_variance_causes(spark.createDataFrame([], KIND)).count() == 0


def test_gate_beside_all_pairs(spark):
    draw = random.Random(5)
    rows = [(draw.choice((1, 2)), f"g{draw.randint(0, 30)}", f"t{draw.randint(0, 5)}", draw.choice((0.0, 0.2, 0.4, 1.0)), draw.random() < 0.5, draw.choice((0, 0, 1, 2))) for _ in range(300)]
    got = {r.run: r for r in J.over_search_gate(spark.createDataFrame(rows, "run int, group_id string, task_id string, reward double, correct boolean, tags int")).collect()}
    new = lambda r: round(r[3] + 0.2 * r[5], 9)
    for run in (1, 2):
        own = [r for r in rows if r[0] == run]
        groups = [[r for r in own if r[1] == g] for g in {r[1] for r in own}]
        assert got[run].inversions == sum(new(a) < new(b) for g in groups for a in g if a[4] for b in g if not b[4])
        assert got[run].groups_changed == sum(any(abs((new(a) - sum(map(new, g)) / len(g)) - (a[3] - sum(x[3] for x in g) / len(g))) > 1e-9 for a in g) for g in groups)
        assert got[run].groups_varied == sum(len({new(a) for a in g}) > 1 for g in groups)
        assert got[run].tasks == len({r[2] for r in own if r[5]}) and got[run].tasks_correct == len({r[2] for r in own if r[5] and r[4]})
    assert got[None].inversions == got[1].inversions + got[2].inversions and not got[None].passed
    assert got[None].tasks == len({r[2] for r in rows if r[5]})
