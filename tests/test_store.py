"""The store, reports, prefixes and digests."""

import hashlib
import json

import pytest
from lodestone.sources import readers, sinks


def test_batches_and_rows_are_numbered(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    sinks.upsert(rows((1, "a"), (2, "b"), (1, "a2")).coalesce(1), path)
    for v in "cdefg":
        sinks.upsert(rows((2, v)), path)
    assert sorted(map(tuple, sinks.latest(spark, path, "id").collect())) == [(1, "a2"), (2, "g")]
    events = str(tmp_path / "e")
    assert sinks.append_events(rows((1, "a"), (2, "b")), events) == 2 and sinks.append_events(rows((3, "c")), events) == 1
    for bad in (rows((3, "again")), rows((9, "x"), (9, "y"))):
        with pytest.raises(ValueError):
            sinks.append_events(bad, events)
    assert sorted(r["id"] for r in sinks.events(spark, events).collect()) == [1, 2, 3]
    with pytest.raises(FileExistsError):
        sinks._publish(rows((7, "z")), events, 1)
    assert sinks.events(spark, events).count() == 3


def test_reports_and_prefixes(spark, tmp_path):
    report = {"b": 1, "a": {"é": [1, None, 2.5]}}
    for r in ({"old": 1}, report):
        sinks.write_report(spark, r, f"{tmp_path}/deep/er/report.json")
    assert (tmp_path / "deep/er/report.json").read_text("utf-8") == json.dumps(report, ensure_ascii=False, indent=2)
    lines = tmp_path / "t.jsonl"
    lines.write_text("\n\n".join(json.dumps({"i": i}) for i in range(50)) + "\n", "utf-8")
    got = lambda n: [r["i"] for r in readers.read_prefix(spark, str(lines), "i long", n).collect()]
    assert got(7) == list(range(7)) and sorted(got(0)) == sorted(got(None)) == list(range(50))


def test_environment(spark, tmp_path):
    def record(i, docs):
        tool = {"role": "tool", "content": json.dumps({"ok": True, "result": [{"id": d, "title": d.upper(), "text": f"{d} {i}"} for d in docs]})}
        return {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": f"q{i}"}, tool], "metadata": {"task_id": f"t{i}", "gold_answer": f"a{i}", "difficulty": "easy"}}

    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(json.dumps(record(i, d)) for i, d in enumerate((["x", "y"], ["y"], ["x", "z"]))), "utf-8")
    tasks, corpus = readers.load_environment(spark, str(path), 2, 2)
    assert [tuple(r) for r in tasks.collect()] == [("t0", "q0", "a0", "easy"), ("t1", "q1", "a1", "easy")]
    assert sorted((r["id"], r["text"]) for r in corpus.collect()) == [("x", "x 0"), ("y", "y 1")]
    assert sorted(r["id"] for r in readers.load_environment(spark, str(path))[1].collect()) == ["x", "y", "z"]


def test_digests_of_long_files(spark, tmp_path):
    for name, body in (("a", b"x" * 5_000), ("b", b"y"), ("c", bytes(range(256)) * 20_000)):
        (tmp_path / name).write_bytes(body)
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    for most in (1 << 30, 4_000):
        got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in readers.file_digests(spark, str(tmp_path), most).collect()}
        assert got == want


def test_running_report(spark, tmp_path):
    from lodestone.streaming import events as E

    source = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame([(i, t) for i, t in r], "event_id long, event_type string").selectExpr("event_id", "current_timestamp() AS ts", "1L AS user_id", "event_type", "1.0D AS value", "'{}' AS props")
    rows((1, "a"), (2, "b")).coalesce(1).write.parquet(str(source / "events1.parquet"))
    stream = lambda: E.event_stream(spark, str(source), "part*.parquet").select("event_id", "event_type")
    source2 = spark.readStream.schema(E.SCHEMA).option("recursiveFileLookup", True).parquet(str(source)).select("event_id", "event_type")
    E.with_report(source2, str(tmp_path / "out"), "event_type")
    rows((3, "a")).coalesce(1).write.parquet(str(source / "events2.parquet"))
    E.with_report(source2, str(tmp_path / "out"), "event_type")
    report = json.loads((tmp_path / "out/report.json").read_text())
    assert report == {"status": "running", "batches": 2, "rows": 3, "counts": {"a": 2, "b": 1}} and stream().isStreaming


def test_waves(spark):
    from lodestone.operators import rollout as O

    corpus = spark.createDataFrame([("1", "red fox", "the red fox runs far"), ("2", "blue whale", "a blue whale swims deep")], "id string, title string, text string")
    tasks = spark.createDataFrame([(0, "red fox"), (1, "blue whale"), (2, "x"), (3, "fox"), (4, "nothing of it zzz")], "qid long, question string")
    got = {r["qid"]: r for r in O.rollouts(tasks, corpus, O.Scripted(), max_steps=3).collect()}
    assert [got[q]["reason"] for q in range(5)] == ["answer", "repeated_action", "invalid_action", "max_steps", "answer"]
    assert got[0]["answer"] == "1" and got[4]["answer"] == "nothing" and got[3]["queries"] == ["fox 0", "fox 1", "fox 2"] and got[1]["results"] == [["2"]]
    mended = O.rollouts(tasks.filter("qid = 1"), corpus, O.Scripted(), max_steps=3, repairs=1).first()
    assert mended["reason"] == "repeated_action" and len(mended["queries"]) == 2
