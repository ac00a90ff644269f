import hashlib
import random

from lodestone.llm import substring as sub


def texts():
    r = random.Random(4)
    sentence = lambda n: " ".join(r.choice(["aa", "Bb", "é", "cc", "dd"]) for _ in range(n)).capitalize() + r.choice(".!?")
    shared = [sentence(r.randrange(1, 20)) for _ in range(12)]
    out = []
    for i in range(60):
        lines = [" ".join(r.choice([*shared, sentence(9), sentence(2)]) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 6))]
        out.append((i, "\n".join(lines)))
    passage = "Zz yy xx ww vv uu tt. Oh no. Ss rr qq pp oo nn mm ll. To an."
    out += [(70, "First here. " + passage), (71, "Other things are written here today. " + passage + "\nKept line."), (72, passage.upper()), (73, None), (74, ""), (75, "\n\n"), (76, "x." * 9), (77, "one two three four five six " * 3000), (None, passage)]
    return out


def test_like_brute_force(spark, tmp_path):
    rows = texts()
    spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, removed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: t for (i, _), t in zip(rows, sub.brute(rows))}
    got = sub.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and any(r["n_spans"] for r in got)
    for r in got:
        assert r["kept_sha256"] == hashlib.sha256((want[r["doc_id"]] or "").encode()).hexdigest(), r["doc_id"]
    kept = {r["doc_id"]: r for r in sub.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = [(x["start"], x["end"]) for x in kept[i]["removed"]]
        assert kept[i]["text"] == want[i] and (not t or sub.without(t, spans) == kept[i]["text"])
    assert kept[71]["text"] == "Other things are written here today.\nKept line." or kept[71]["text"].startswith("Other things are written here today.")
    assert kept[72]["text"] == "" and kept[None]["text"] == ""


def test_repeated_rows_and_empty(spark):
    line = "one two three four five six seven"
    df = spark.createDataFrame([(1, line), (1, line), (2, line + "\nmore"), (1, "other text\n" + line)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in sub.clean(df).collect())
    assert got == [(1, line), (1, line), (1, "other text\n" + line), (2, "more")]
    assert sub.clean(df.limit(0)).count() == 0


def test_units_make_up_the_text():
    for _, t in texts():
        cut = sub.units(t or "")
        assert "".join((t or "")[a:b] for a, b in cut) == (t or "")
