"""greedy paths that ask every sentence of whole texts, beside a plain walk without cuts."""

import random
import re

from lodestone.operators import hops as H
from lodestone.plans import hops as P
from test_hops import Bm25, corpus, norm, variants


def walk(question, facts, index):
    """The greedy path of one question, hop by hop; all sentences, all variants, whole queries."""
    docs = {i: (title, text) for i, title, text in index.docs}
    closed = lambda ids: {f for f in facts if any(docs[i][0] == f[0] and f[1] in docs[i][1] for i in ids)}
    runs = [(closed(index.search(q)), q, key) for key, q in variants(question)]
    runs = [x for x in runs if x[0]]
    partial = sorted((x for x in runs if len(x[0]) < len(facts)), key=lambda x: (-len(x[0]), len(x[1]), x[2]))[:4]
    full = sorted((x for x in runs if len(x[0]) == len(facts)), key=lambda x: (len(x[1]), x[2]))[:1]
    best = None
    for place, (have, q, key) in [*enumerate(partial, 1), *enumerate(full, 5)]:
        queries, used, ids, have = [q], {key}, list(index.search(q)), set(have)
        for _ in range(4):
            if len(have) == len(facts):
                break
            options = {}
            for i in ids:
                title, text = docs[i]
                sentences = [s.strip(" \t\n") for s in re.split(r"(?<=[.!?])[ \t\n]+", text)]
                for seed in [title, *[s for s in sentences if len(s) >= 24]]:
                    for form in (seed, f"{question} {seed}".strip(" ")):
                        if norm(form) and norm(form) != norm(question) and norm(form) not in used:
                            options.setdefault(norm(form), form)
            scored = [(len(closed(set(index.search(o)) - set(ids)) - have), -len(o), o) for o in options.values()]
            scored = [x for x in scored if x[0]]
            if not scored:
                break
            o = max(scored)[2]
            new = [i for i in index.search(o) if i not in ids]
            queries, used, ids, have = [*queries, o], used | {norm(o)}, ids + new, have | closed(new)
        mine = (len(have), -len(queries), -place, queries)
        best = mine if best is None else max(best, mine)
    return (len(facts), best[0], best[3]) if best else (len(facts), 0, None)


def test_whole_texts_like_a_walk(spark):
    """Links stand in sentences after the fourth, behind more variants than 56, behind questions of over 500 characters."""
    r = random.Random(5)
    docs = [(i, t, " ".join(f"Filler words of the {n} kind stand here alone." for n in range(30)) + " " + x if n % 9 == 0 else x) for n, (i, t, x) in enumerate(corpus(120))]
    questions, facts = [], []
    for q in range(12):
        at = r.randrange(120)
        tail = " and more of that kind " * 30 if q % 4 == 0 else ""
        questions.append((q, f"Which item does the record of {docs[at][1]} hold near the {r.choice(['amber', 'fjord'])}{tail}?"))
        facts += [(q, d[1], d[2].split(". ")[-1]) for d in (docs[at], docs[(at * 7 + 3) % 120])]
    frames = spark.createDataFrame(questions, "qid long, question string"), spark.createDataFrame(docs, "id string, title string, text string"), spark.createDataFrame(facts, "qid long, title string, quote string")
    index = Bm25(docs)
    got = {x["qid"]: (x["n_facts"], x["n_closed"], x["queries"]) for x in H.oracle_paths(*frames, sentences=None, variants=None, chars=None).collect()}
    want = {q: walk(text, {f[1:] for f in facts if f[0] == q}, index) for q, text in questions}
    assert got == want
    few = {x["qid"]: x["n_closed"] for x in H.oracle_paths(*frames).collect()}
    assert sum(x[1] for x in got.values()) > sum(few.values()) and any(x[2] and len(x[2]) > 1 for x in got.values())


def test_the_query_cuts_nothing(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(P.H, "oracle_paths", lambda asked, docs, facts, **k: (seen.update(k), facts.selectExpr("qid", "1L n_facts", "1L n_closed", "1L n_searches", "array(quote) queries"))[1])
    monkeypatch.setattr(P, "written", lambda df: df)
    monkeypatch.setattr(P, "questions", lambda *a: spark.createDataFrame([(1, "red fox")], "qid long, question string"))
    monkeypatch.setattr(P, "corpus", lambda *a: spark.createDataFrame([("1", "red fox", "the red fox runs far away, it does")], "id string, title string, text string"))
    P.oracle_search_paths(spark, "").collect()
    assert seen == {"sentences": None, "variants": None, "chars": None}
