"""Excerpts of found pages beside a plain walk over all paragraphs and windows, with words and with a vocabulary's tokens."""

import random
import re

import pytest

from lodestone.functions import text as T
from lodestone.operators import excerpts as E
from lodestone.operators import retrieval as R
from lodestone.operators.context import byte_pairs

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _terms(x):
    return [t for t in re.findall(T.TOKEN, x.lower()) if t not in T.STOPWORDS and (len(t) > 1 or ord(t) > 127)]


def _cut(text, offsets, asked, limit):
    spans = [s for s in offsets(text) if s[1] > s[0]]
    at = 0
    if len(spans) > limit:
        def key(i):
            own = [t for a, b in spans[i : i + limit] for t in _terms(text[a:b]) if t in asked]
            return len(set(own)), len(own), -i
        at = max(range(len(spans) - limit + 1), key=key)
    return spans[at][0], spans[min(at + limit, len(spans)) - 1][1]


def _pages(draw):
    words = "alpha beta gamma delta epsilon zeta the of Running runners unbelievable 中文 café".split()
    line = lambda n: " ".join(draw.choices(words, k=n))
    heads = ["References", "further reading", "the of", "...", ""]
    return [(f"p{i}", line(2), [draw.choice(heads) if draw.random() < 0.3 else line(draw.randint(1, 60)) for _ in range(draw.randint(1, 5))]) for i in range(12)]


@pytest.mark.parametrize("kind", ["words", "vocabulary"])
def test_like_a_plain_walk(spark, kind):
    tokenizer = E.words if kind == "words" else byte_pairs(VOCABULARY)
    own = tokenizer()
    pages = _pages(random.Random(11))
    asked = [(1, "alpha running"), (2, "unbelievable gamma zeta"), (3, "runners 中"), (4, "nothing here")]
    corpus = spark.createDataFrame([(i, t, "\n".join(p)) for i, t, p in pages], "id string, title string, text string")
    paragraphs = spark.createDataFrame([(i, n, x) for i, _, p in pages for n, x in enumerate(p)], "id string, paragraph_index long, text string")
    questions = spark.createDataFrame(asked, "qid long, question string")
    got = {(r.qid, r.id): r for r in E.page_excerpts(corpus, paragraphs, questions, tokenizer, 3, 12, 9, 4).collect()}
    texts = {(i, n): x for i, _, p in pages for n, x in enumerate(p)}
    eligible = {k: x for k, x in texts.items() if _terms(x) and " ".join(_terms(x)) not in E.HEADINGS}
    scores = {(r.qid, r.id, r.paragraph_index): round(r.score, 9) for r in R.bm25_rows(spark.createDataFrame([(i, n, None, x) for (i, n), x in eligible.items()], "id string, paragraph_index long, title string, text string"), questions, ("id", "paragraph_index"), title_weight=0).collect()}
    expected = {}
    for r in R.bm25_search(corpus, questions, 3).collect():
        words = set(_terms(dict(asked)[r.qid]))
        numbers = sorted(n for i, n in eligible if i == r.id)
        if not numbers:
            continue
        best = min((n for n in numbers if scores.get((r.qid, r.id, n), 0) > 0), key=lambda n: (-scores[r.qid, r.id, n], n), default=None)
        parts = [(numbers[0], 12)] if best is None else [(best, 9)] if best == numbers[0] else [(numbers[0], 4), (best, 9)]
        places = [(n, *_cut(texts[r.id, n], lambda x: own([x])[0], words, limit)) for n, limit in parts]
        expected[r.qid, r.id] = (numbers[0] if best is None else best, places, "\n".join(texts[r.id, n][a:b] for n, a, b in places), r.rank)
    assert len(expected) > 5 and {k: (r.paragraph_index, [tuple(s) for s in r.segments], r.text, r.rank) for k, r in got.items()} == expected


def test_empty_tables_and_windows(spark):
    rows = spark.createDataFrame([("", ["a"], 3), (None, None, 3), ("one two three four", ["four"], 2), ("one two", [], 5)], "text string, asked array<string>, limit int")
    assert [(r.start, r.end) for r in E.excerpts(rows).collect()] == [(0, 0), (0, 0), (8, 18), (0, 7)]
    assert E.excerpts(rows.limit(0)).count() == 0
    assert E.best_window([["x"]] * 200_000 + [["y"]], {"x", "y"}, 288) == 200_001 - 288
