"""python -m lodestone COMMAND: list and show queries, run one into a folder, generate rows, build and ask an index, report on the environment."""

from __future__ import annotations

import argparse
import json
import platform
import sys

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dense, synthesis
from .plans import registry
from .session import session
from .sources import sinks
from .tables import corpus


def environment(spark: SparkSession) -> dict:
    """Versions, cores and the settings that results and plans depend on."""
    names = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled")
    java = spark._jvm.java.lang.System.getProperty("java.version")
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "java": java, "master": spark.sparkContext.master, "cores": spark.sparkContext.defaultParallelism, "settings": {n: spark.conf.get(n) for n in names}, "checkpoint_dir": spark.conf.get("spark.checkpoint.dir", None) is not None}


def run(spark: SparkSession, name: str, sf: str, out: str) -> dict:
    """A query's rows, written once under ``out/rows``, with a report beside them; nothing runs if the query or the place isn't good."""
    if name not in registry.QUERIES:
        raise ValueError(f"unknown query: {name}")
    df = registry.QUERIES[name](spark, sf)
    sinks.write_once(df, f"{out}/rows")
    report = {"query": name, "data": sf, "rows": spark.read.parquet(f"{out}/rows").count(), "columns": dict(df.dtypes), "environment": environment(spark)}
    sinks.write_report(spark, report, f"{out}/report.json")
    return report


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **defaults):
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for k, v in defaults.items():
            c.add_argument(f"--{k}", default=v, type=type(v) if v is not None else str)

    command("list")
    command("environment")
    command("show", "name", "sf", rows=20)
    command("inspect", "out")
    command("run", "name", "sf", "out")
    command("generate", "sf", "out", split="train", count=100, seed="42")
    command("index", "sf", "path")
    command("search", "sf", "path", "question", mode="hybrid-rrf-v1", k=3)
    return p


def main(argv: list[str], spark: SparkSession | None = None) -> DataFrame | dict | list:
    a = _parser().parse_args(argv)
    if a.command == "list":
        return sorted(registry.QUERIES)
    spark = spark or session()
    if a.command == "environment":
        return environment(spark)
    if a.command == "show":
        return registry.QUERIES[a.name](spark, a.sf).limit(a.rows)
    if a.command == "inspect":
        return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(f"{a.out}/report.json").collect()))
    if a.command == "run":
        return run(spark, a.name, a.sf, a.out)
    c, encoder = corpus(spark, a.sf), dense.HashingEncoder()
    if a.command == "generate":
        rows = synthesis.generated_split(c.filter("text is not null"), a.count, a.split, a.seed)
        rows.orderBy("task_id").coalesce(1).write.mode("errorifexists").json(a.out)
        return {"split": a.split, "rows": a.count, "path": a.out}
    if a.command == "index":
        return dense.build_index(c, a.path, encoder)
    asked = spark.createDataFrame([(0, a.question)], "qid long, question string")
    return dense.search(c, dense.open_index(c, a.path, encoder), asked, encoder, a.mode, a.k).join(c.select("id", F.substring("text", 1, 80).alias("start")), "id").orderBy("rank")


if __name__ == "__main__":
    result = main(sys.argv[1:])
    if isinstance(result, DataFrame):
        result.show(truncate=60)
    else:
        print(json.dumps(result, ensure_ascii=False, indent=2))
