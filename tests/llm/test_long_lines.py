"""Very long lines and windows of many near notices: linear, and the same ranges as by the plain rule."""

import random
import time

from lodestone.llm import licenses, substring


def _plain(text: str, gone: set[int]) -> str:
    """What stays, by the rule read literally: a short unit goes if its nearest long units within its line go."""
    cut = substring.units(text)
    line, lines = 0, []
    for _, b in cut:
        lines.append(line)
        line += text[b - 1] == "\n"
    long = [substring.digest(text[a:b]) is not None for a, b in cut]
    kept = []
    for i, (a, b) in enumerate(cut):
        same = [j for j in range(len(cut)) if lines[j] == lines[i] and long[j] and j != i]
        beside = [x for x in (max((j for j in same if j < i), default=None), min((j for j in same if j > i), default=None)) if x is not None]
        if not (i in gone or not long[i] and beside and gone.issuperset(beside)):
            kept.append(text[a:b])
    return "".join(kept)


def test_short_units_go_by_the_rule():
    draw = random.Random(7)
    for _ in range(300):
        text = "".join(" ".join(draw.choices(("ab", "cd", "ef"), k=draw.choice((1, 2, 7)))) + draw.choice((". ", ".\n", "\n")) for _ in range(draw.randint(1, 12)))
        cut = substring.units(text)
        gone = {i for i in range(len(cut)) if draw.random() < 0.5}
        assert substring.without(text, substring.removed(text, gone)) == _plain(text, gone)


def test_a_line_of_many_sentences():
    text = " ".join(f"Some words of sentence number {i} are here now." for i in range(100_000))
    begun = time.monotonic()
    ranges = substring.removed(text, set(range(0, 100_000, 2)))
    assert len(ranges) == 50_000 and time.monotonic() - begun < 5


def test_a_window_of_many_near_notices():
    search = licenses.Searcher(licenses.NOTICES, licenses.BASE)
    for notice, edits in (("mit license", 0), ("mit licence", 1)):
        words = licenses.alnum_words(f"{notice} " * 50_000)
        begun = time.monotonic()
        found = [x for x in search(words) if search.notices[x[0]][0] == "mit license"]
        assert [n for *_, n in found] == [edits] * 50_000 and time.monotonic() - begun < 5
