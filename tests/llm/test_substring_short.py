"""Runs of short units, beside a brute force of its own that walks all runs in rank order."""

import random

from lodestone.llm import substring as sub
from lodestone.llm.common import ALNUM


def brute(rows):
    seen, out = {}, {}
    for i, text in sorted(rows):
        cut = sub.units(text)
        words = [text[a:b].encode().translate(ALNUM).split() for a, b in cut]
        gone = set()
        for a in range(len(cut)):
            b = next((b for b in range(a, len(cut)) if sum(map(len, words[a : b + 1])) >= sub.LEAST_WORDS), None)
            if words[a] and b is not None:
                key = b" ".join(w for x in words[a : b + 1] for w in x)
                doc, end = seen.setdefault(key, (i, b))
                gone |= {n for n in range(a, b + 1) if doc != i or n > end}
        out[i] = sub.without(text, sub.removed(text, gone)) if gone else text
    return out


def test_copies_of_short_units_go(spark):
    r = random.Random(6)
    cry = " ".join(f"{r.choice('ABCDE')}{n}!!" for n in range(150))
    poem = "\n".join(f"Short line {n}." for n in range(40))
    rows = [(1, cry), (2, cry), (3, "Other words.\n" + cry), (4, poem), (5, "Own first line. " + poem), (6, "ONE!! " * 30), (7, "Too few words."), (8, "Too few words.")]
    rows += [(10 + i, "\n".join(" ".join(r.choice(["Aa bb.", "Cc!", "Dd ee ff gg.", "Hh ii jj kk ll mm nn."]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 5)))) for i in range(60)]
    got = {x["doc_id"]: x["text"] for x in sub.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)
    assert got[1] == cry and got[2] == "" and got[3] == "Other words.\n"
    assert got[4] == poem and got[5] == "Own first line."
    assert got[6].split() == ["ONE!!"] * 6 and got[8] == "Too few words."
