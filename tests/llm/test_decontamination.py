import random

from lodestone.llm import decontamination as d


def data():
    r = random.Random(3)
    vocabulary = ["the", "Ab", "é", "x1", "of", "Straße"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(1, say(14)), (2, say(10)), (3, "the ab"), (4, None), (5, "?!"), (6, say(30)), (7, None), (11, say(14)), (12, "the, AB")]
    items.append((13, items[0][1]))
    texts = [(i, say(r.randrange(0, 60))) for i in range(40)]
    texts += [(50, "x " + items[0][1].upper().replace("É", "é").replace("STRASSE", "Straße") + "! y"), (51, None), (52, ""), (53, "..."), (50, "the-ab " * 40 + items[5][1]), (54, items[1][1] + "\n" + items[1][1])]
    return texts, items


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in texts], "doc_id long, text string, n_words string, items int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_like_brute_force(spark, tmp_path):
    texts, items = data()
    docs, bench = frames(spark, texts, items)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, d.query(spark, str(tmp_path)).collect())) == sorted(d.brute(texts, items))


def test_blocks_give_the_same(spark):
    docs, bench = frames(spark, *data())
    key = lambda r: (r["doc_id"], r["n_words"], str(r))
    one, many = (sorted(d.hits(docs, bench, block_bytes=b).collect(), key=key) for b in (1 << 20, 100))
    assert one == many


def test_offsets_of_the_original(spark):
    text = "Zu Straße: (THE, ab) end"
    docs, bench = frames(spark, [(1, text)], [(3, "the ab")])
    (row,) = d.hits(docs, bench).collect()
    (span,) = row["char_spans"]
    assert text[span["start"] : span["end"]] == "THE, ab"


def test_clean_and_empty(spark):
    texts, items = data()
    docs, bench = frames(spark, texts, items)
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns
    bad = {(r[0], r[1]) for r in d.brute(texts, items) if r[5]}
    assert kept.count() == len(texts) - sum(r[5] for r in d.brute(texts, items))
    assert bad
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.clean(docs, none).count() == len(texts)
    assert d.hits(docs.limit(0), bench).count() == 0 and d.hits(docs, none).count() == len(texts)
