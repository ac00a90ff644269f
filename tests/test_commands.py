"""The command line, called in this session."""

import json

import pytest
from lodestone.__main__ import main

SF = "/root/testdata/sf0.001"


def test_commands(spark, tmp_path):
    assert "bm25_topk" in main(["list"]) and main(["environment"], spark)["settings"]["spark.sql.session.timeZone"] == "UTC"
    assert main(["show", "exact_dedup", SF, "--rows", "3"], spark).count() == 3
    report = main(["run", "state_weights", SF, f"{tmp_path}/a"], spark)
    assert report["rows"] == spark.read.parquet(f"{tmp_path}/a/rows").count() == 2 and main(["inspect", f"{tmp_path}/a"], spark) == report
    with pytest.raises(Exception, match="(?i)exists"):
        main(["run", "state_weights", SF, f"{tmp_path}/a"], spark)
    with pytest.raises(ValueError, match="unknown query"):
        main(["run", "nothing", SF, f"{tmp_path}/b"], spark)
    with pytest.raises(SystemExit):
        main(["sing"], spark)


def test_generated_rows_and_a_search(spark, tmp_path):
    main(["generate", SF, f"{tmp_path}/g", "--count", "7", "--split", "test"], spark)
    rows = [json.loads(x) for p in (tmp_path / "g").glob("part-*") for x in p.read_text("utf-8").splitlines()]
    assert [r["task_id"] for r in rows] == [f"test-{i:05d}" for i in range(7)] and all(len(r["messages"]) == 5 for r in rows)
    assert json.loads(rows[0]["messages"][-1]["content"]) == {"action": "answer", "answer": rows[0]["gold_answer"]}
    main(["index", SF, f"{tmp_path}/index"], spark)
    question = rows[0]["gold_answer"].replace("\n", " ")[:300]
    assert main(["search", SF, f"{tmp_path}/index", question, "--k", "2"], spark).count() == 2
