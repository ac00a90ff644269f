"""Event streams: windowed counts under a watermark, sessions, idempotent resume, running reports.

The reference data has one natural stream, its append-only event log; windows and sessions are extensions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import write_report

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder, or where none is set, on one machine only, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (at or "file://" + tempfile.mkdtemp(prefix="lodestone-stream-")).rstrip("/")


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def window_counts(events: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Count and sum by tumbling window and type; events later than the delay are dropped."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "2 days") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unseen(batch: DataFrame, done: DataFrame, key: str = "event_id") -> DataFrame:
    """Resume by completed ids: the rows of a batch that the ledger lacks."""
    return batch.dropDuplicates([key]).join(done.select(key), key, "left_anti")


def drained(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Run the stream over all that is there, then read its rows back: each batch is one folder, so a retried batch replaces itself."""
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    run(stream, mode, put, path)
    rows = spark.read.parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def with_report(stream: DataFrame, path: str, by: str) -> None:
    """Run an append stream over all that is there; after each batch ``report.json`` tells how far it came and counts the rows so far by a column.

    A batch's counts replace those of a try before it, so a restart neither loses nor doubles any.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        batch.groupBy(by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={n}")
        sums = spark.read.parquet(f"{path}/counts").groupBy(by).agg(F.sum("n").alias("n")).collect()
        write_report(spark, {"status": "running", "batches": n + 1, "rows": sum(r["n"] for r in sums), "counts": {str(r[by]): r["n"] for r in sorted(sums, key=lambda r: str(r[by]))}}, f"{path}/report.json")

    run(stream, "append", put, path)


def run(stream: DataFrame, mode: str, put: Callable[[DataFrame, int], None], path: str) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
