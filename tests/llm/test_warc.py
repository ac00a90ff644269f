import hashlib

from lodestone.llm import warc


def pages():
    long = "<p>é \r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>" * 5
    return [(5, "http://a/\r\nx y", long), (3, "http://b", long), (9, None, long), (3, "http://b", long), (1, "http://c", "short"), (2, "http://c", "short"), (4, "http://d", None), (6, "", ""), (None, "http://n", long), (7, "http://e", "x" * 99), (8, "http://e", "x" * 99), (10, "http://f", "y" * 100), (11, "http://f", "y" * 100), (12, "http://g", "é" * 300_000)]


def by_hand(rows):
    out = []
    for i, (p, _, h) in enumerate(rows):
        payload = (h or "").encode()
        same = sorted((q is None, q or 0, j) for j, (q, _, g) in enumerate(rows) if (g or "").encode() == payload)
        first = same[0]
        revisit = len(payload) >= 100 and first[2] != i and len(same) > 1
        out.append((p, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", None if not revisit else first[1]))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rows = pages()
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.query(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == by_hand(rows)


def test_payloads_and_framing(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    warc.write(df, f"{tmp_path}/w")
    back = warc.read(spark, f"{tmp_path}/w", payloads=True).collect()
    by_digest = {r["payload_digest"]: bytes(r["payload"]) for r in back if r["record_type"] == "response"}
    assert {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in pages()} == by_digest
    ids = {r["record_id"] for r in back}
    assert len(ids) == len(back) == len(pages()) and all(r["refers_to_id"] in ids for r in back if r["record_type"] == "revisit")
    assert all(r["stored_bytes"] == 0 for r in back if r["record_type"] == "revisit")


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.resolved(warc.read(spark, f"{tmp_path}/w")).count() == 0
