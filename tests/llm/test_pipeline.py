import random
from collections import Counter

import corpus_pipeline as cp
from lodestone.llm import decontamination, mixing, ngram_join, substring, toxicity
from pyspark.sql import functions as F


def fixture(spark, path):
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "el", "ir", "os", "um", "ent", "ork")]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    sentence = lambda: say(r.randrange(7, 14)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(6))
    items = [(i, say(15)) for i in range(4)]
    docs = [(i, " ".join(sentence() for _ in range(r.randrange(5, 12)))) for i in range(160)]
    docs = [(i, t + (" You zidyot, kvetching zidyot." if i % 4 == 0 else "")) for i, t in docs]
    docs += [(200 + i, docs[1 + 4 * i][1].replace("ork", "orx", 1)) for i in range(6)]
    docs += [(300 + i, sentence() + " " + passage + "\n" + sentence()) for i in range(5)]
    docs += [(400 + i, sentence() + " " + items[i][1] + " " + sentence()) for i in range(4)]
    docs += [(500, None), (501, "")]
    rows = [(i, t, "en", f"s{i % 3}" if i != 501 else None, len(t or "")) for i, t in docs]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return sorted((i, t, s) for i, t, _, s, _ in rows), items


def test_like_brute_force(spark, tmp_path):
    rows, items = fixture(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    matcher = toxicity.Matcher(toxicity.learn(docs, labels))
    kept = [x for x in rows if toxicity.score(x[1], matcher)[0] < 0.5]
    assert {x[0] for x in rows} - {x[0] for x in kept} == set(range(0, 160, 4))
    groups = {i: c for i, _, c in ngram_join.brute([(i, t) for i, t, _ in kept], 5, 80, 100)}
    kept = [x for x in kept if groups[x[0]] == x[0]]
    assert not any(200 <= x[0] < 206 for x in kept)
    texts = substring.brute([(i, t) for i, t, _ in kept])
    kept = [(i, t, s) for (i, _, s), t in zip(kept, texts, strict=True)]
    bad = {r[0] for r in decontamination.brute([(i, t) for i, t, _ in kept], items) if r[5]}
    assert bad == {400, 401, 402, 403}
    kept = [x for x in kept if x[0] not in bad]
    copies = {r["doc_id"]: r["copies"] for r in mixing.rates(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()}
    want = Counter({x: copies[x[0]] for x in kept if copies[x[0]]})
    got = cp.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"])
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


CLASHES = ("gone", "removed", "units", "size", "target", "copies", "source_size", "n", "key", "k1", "id", "component_id", "score", "items", "label", "level", "cap", "w", "toxic", "_id")


def test_clashing_names_pass_through(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    for name, stage in cp.STAGES:
        out, plain = stage(spark, odd, str(tmp_path)), stage(spark, docs, str(tmp_path))
        assert out.columns[: len(odd.columns)] == odd.columns, name
        assert out.count() == plain.count(), name
        row = out.filter("doc_id > 0").first()
        assert [row[c] for c in CLASHES] == list(range(len(CLASHES))), name


def test_stages_keep_the_columns_and_bear_empty_tables(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0
        assert out.columns[:5] == list(cp.COLUMNS) and (name == "mixing sources" or out.columns == docs.columns)
