"""Intermediate tables in the session's shared folder: they cut lineage, survive lost executors, and are read as often as needed."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side is broadcast; beyond, Spark shuffles it.
BROADCAST_ROWS = 20_000

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session, or where it is unset, on one machine only, a local one."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at and not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = at or "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many intermediate tables there are, for ``since``."""
    return len(_made)


def since(n: int) -> list[tuple[SparkSession, str]]:
    """The intermediate tables written after the mark, for ``release``."""
    return _made[n:]


def release(spark: SparkSession | None = None, tables: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete written intermediate tables, all or the given ones; results that still read them must have been consumed."""
    for made, path in list(_made) if tables is None else tables:
        try:
            if (made, path) in _made:
                _made.remove((made, path))
            target = made._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem((spark or made)._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            return


atexit.register(release)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint; its files go when the frame is garbage."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The (already materialised) frame, with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df
