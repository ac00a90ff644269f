import random

from lodestone.llm import licenses as lic


def texts():
    r = random.Random(5)
    say = lambda: " ".join(r.choice(["the", "license", "mit", "gnu", "public", "apache", "cc", "by", "general", "é", "of"]) for _ in range(r.randrange(30)))
    out = [say() for _ in range(150)]
    for notice in lic.NOTICES:
        for _ in range(12):
            broken = list(notice)
            for _ in range(r.randrange(4)):
                at = r.randrange(len(broken))
                r.choice([lambda: broken.__setitem__(at, r.choice("xyz ")), lambda: broken.insert(at, r.choice("xq")), lambda: broken.pop(at) if len(broken) > 3 else None])()
            out.append(f"{say()} {''.join(broken)} {say()}")
    return [*out, None, "", "  ", "CC-BY", "MIT License; MIT   license\nGNU GENERAL PUBLIC LICENSE", "cc by cc by cc by", "smit license", "word " * 20000 + "Apache Licence"]


def test_like_brute_force(spark, tmp_path):
    every = texts()
    spark.createDataFrame([(i, t, "clash") for i, t in enumerate(every)], "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in lic.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(every):
        n, places, labels = lic.brute(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places)), t
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert r["labels"] == ",".join(sorted(labels)), t
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)


def test_spans(spark):
    docs = spark.createDataFrame([(1, "x The MIT Lizense (y)"), (None, "mit license")], "doc_id long, text string")
    rows = lic.search(docs).collect()
    (span,) = rows[0]["spans"]
    assert (span["label"], span["matched"], span["edits"], span["start_word"], span["end_word"]) == ("mit", "mit lizense", 1, 2, 4)
    assert lic.search(docs.limit(0)).count() == 0
