import random

from hypothesis import given
from hypothesis import strategies as st
from lodestone.llm import toxicity as t
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


LEXICON = t.Lexicon({"idiot": 0.99, "scum": 0.98, "worthless": 0.97, "idiom": 0.5, "moron": 0.96}, {"vequ": 0.95, "lowe": 0.9}, frozenset({"morons"}))
MATCHER = t.Matcher(LEXICON)


def by_hand(token):
    """The best match by the edit distance to every word and every stem."""
    found = [(0.0, "", 0)]
    for w, p in LEXICON.words.items():
        e = distance(token, w)
        if e <= t.allowed(w) and not (e and token in LEXICON.excepted):
            found.append((p * t.PER_EDIT**e, w, e))
    found += [(p, s, 0) for s, p in LEXICON.stems.items() if token.startswith(s)]
    return max(found)[0]


@given(st.one_of(st.text("idotmscuwrhlevqu", max_size=12), st.tuples(st.sampled_from([*LEXICON.words, *LEXICON.stems]), st.text("idotsx", max_size=2), st.integers(0, 9)).map(lambda x: x[0][: x[2]] + x[1] + x[0][x[2] :])))
def test_automaton_is_the_edit_distance(token):
    hit = MATCHER.run(token)
    assert abs((hit[0] if hit else 0.0) - by_hand(token)) < 1e-12


def test_context():
    abuse, fuzzy, quoted, said, none = (t.score(x, MATCHER)[0] for x in ("what an idiot of a man", "you idi0t", 'the "idiot" of the title', "he said idiot", "a fine day"))
    assert abuse > 0.5 and fuzzy > 0.5 and quoted < 0.5 and said < 0.5 and none == t.BASE_SCORE
    assert t.score('he called "you idiot, you worthless scum"', MATCHER)[0] > 0.5
    assert t.score(None, MATCHER) == t.score("", MATCHER) == (t.BASE_SCORE, 0, 0)
    assert t.score("word " * 50_000 + "moron", MATCHER)[0] > 0.5


def corpus(spark):
    r = random.Random(2)
    clean = ["".join(r.choice("aeioublst") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        words = [r.choice(clean) for _ in range(30)]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(30), r.choice(["zidyot", "kvetching", "grmx" + r.choice(clean)]))
        docs.append((i, " ".join(words), "x", "clash"))
        if i % 3:
            labels.append((i, 1, toxic))
    docs += [(1000, None, None, None), (1001, "", "x", ""), (None, "zidyot", "x", ""), (5, docs[5][1], "x", "clash")]
    labels += [(7, 1, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: i % 5 == 0 for i in range(600)}


def test_held_out_accuracy_and_edges(spark, tmp_path):
    docs, labels, truth = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = t.query(spark, str(tmp_path)).collect()
    assert len(got) == 604
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert len(held) > 80 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["score"] == by[1001]["score"] == t.BASE_SCORE and by[None]["predicted"] == 1
    lexicon = t.learn(docs, labels)
    kept = t.reject(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)
    assert t.learn(docs, labels.filter("toxic > 5")) == t.Lexicon() and t.scored(docs.limit(0), lexicon).count() == 0


def test_holding_out(spark):
    import zlib

    rows = spark.range(200).select("id", t.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
