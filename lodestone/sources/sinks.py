"""Sinks and the append-only store: write-once tables, event log, latest views, exports, budget ledger."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stats import prefix_sums
from ..scratch import written
from .readers import guarded


def write_once(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Written if nothing is there; an error otherwise."""
    df.write.format(format).mode("errorifexists").option("header", True).save(guarded(path))


def _batches(spark: SparkSession, path: str) -> int:
    """How many batches a folder of numbered batches holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(s.getPath().getName().startswith("batch-") for s in fs.listStatus(place)) if fs.exists(place) else 0


def _publish(df: DataFrame, path: str, number: int) -> None:
    """The rows as one numbered batch: written beside its place and moved there whole; an error if another writer took the number."""
    spark = df.sparkSession
    staging = f"{path}/.building-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, f"{path}/batch-{number:08d}"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(f"batch {number} is there already")


def _every(spark: SparkSession, path: str) -> DataFrame:
    """All batches with their numbers."""
    parts = [spark.read.parquet(f"{path}/batch-{n:08d}").withColumn("_seq", F.lit(n).cast("long")) for n in range(_batches(spark, path))]
    return reduce(DataFrame.unionByName, parts)


def append_events(df: DataFrame, path: str, key: str = "id") -> int:
    """Append rows whose key is new, as one batch; rows that are there already, or twice, make an error, as a primary key would.

    The input is written once and then checked and counted; a second writer of the same batch number fails.
    """
    spark, path = df.sparkSession, guarded(path)
    number, rows = _batches(spark, path), written(df)
    if number and not _every(spark, path).join(rows.select(key), key, "left_semi").isEmpty() or not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is there already")
    _publish(rows, path, number)
    return rows.count()


def events(spark: SparkSession, path: str) -> DataFrame:
    """The appended rows of all batches."""
    return _every(spark, path).drop("_seq")


def upsert(df: DataFrame, path: str) -> None:
    """Insert or replace: rows are appended as a numbered batch with their places, and ``latest`` shows the last of each key."""
    path = guarded(path)
    _publish(df.withColumn("_row", F.monotonically_increasing_id()), path, _batches(df.sparkSession, path))


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last row of each key, by batch and then by place in it; both are stored, so reruns agree."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_seq"), F.desc("_row"))
    return _every(spark, path).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_seq", "_row")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as one indented JSON file, with its folders; UTF-8, keys as given, an existing one replaced whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(guarded(path))
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(json.dumps(report, ensure_ascii=False, indent=2).encode())
    stream.close()
    fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"{path} could not be put in place")


def export_trajectories(rollouts: DataFrame, groups: DataFrame, transitions: DataFrame, path: str) -> None:
    """One JSON line a rollout: its group and its transitions in step order."""
    fields = [c for c in transitions.columns if c not in ("rollout_id", "step")]
    nested = transitions.groupBy("rollout_id").agg(F.array_sort(F.collect_list(F.struct("step", *fields))).alias("transitions"))
    whole = rollouts.join(groups.select("group_id", F.struct(*groups.columns).alias("group")), "group_id", "left").join(nested, "rollout_id", "left")
    whole.write.mode("errorifexists").json(guarded(path))


def export_messages(trajectories: DataFrame, path: str) -> None:
    """Training messages of terminated trajectories (messages, terminated, step, answer), the answer appended as an action."""
    last = trajectories.groupBy("rollout_id").agg(F.max_by(F.struct("messages", "terminated", "answer"), "step").alias("l")).filter("l.terminated")
    action = F.struct(F.lit("assistant").alias("role"), F.to_json(F.struct(F.lit("answer").alias("action"), F.col("l.answer").alias("answer"))).alias("content"))
    last.select(F.concat("l.messages", F.array(action)).alias("messages")).write.mode("errorifexists").json(guarded(path))


def budget_states(calls: DataFrame, total: float, stage_caps: dict[str, float]) -> DataFrame:
    """Each call of a ledger (seq, key, stage, reserved, charged, status) by what a reservation in order would have met.

    cached: the key was completed before; pending or unknown: it was reserved before without an end; over_stage and
    over_total: the reservation would pass a cap; else accepted.
    """
    same = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce("charged", "reserved")
    caps = F.create_map(*[F.lit(x) for pair in stage_caps.items() for x in pair])
    sums = prefix_sums(prefix_sums(calls, "_spent", spent, "seq"), "_stage_spent", spent, "seq", "stage")
    verdict = (
        F.when(F.max((F.col("status") == "done").cast("int")).over(same) == 1, "cached").when(F.max((F.col("status") != "done").cast("int")).over(same) == 1, "pending")
        .when(F.col("_stage_spent") + F.col("reserved") > caps[F.col("stage")], "over_stage").when(F.col("_spent") + F.col("reserved") > total, "over_total").otherwise("accepted")
    )
    return sums.select("seq", "key", "stage", verdict.alias("verdict"))
