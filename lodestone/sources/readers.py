"""Readers: explicit schemas, guarded paths, tolerant line files, several formats behind one call."""

from __future__ import annotations

import unicodedata
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Path parts that mark sealed data.
SEALED = ("sealed", "final-test", "final_test")


def guarded(path: str, sealed: tuple[str, ...] = SEALED) -> str:
    """The path, or an error if any decoding of it names sealed data or climbs out of its folder."""
    plain = path
    for _ in range(5):
        plain, before = unicodedata.normalize("NFKC", unquote(plain)), plain
        if plain == before:
            break
    parts = plain.replace("\\", "/").casefold().split("/")
    if ".." in parts:
        raise ValueError(f"path climbs out of its folder: {path}")
    if any(s in part for part in parts for s in sealed):
        raise PermissionError(f"sealed data: {path}")
    return path


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON by an explicit schema; blank lines are skipped, broken ones kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(guarded(path))


def read_prefix(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """The first ``limit`` records of line files in file order, blank lines not counted; 0 or None: all."""
    lines = spark.read.text(guarded(path)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value").filter(F.trim("value") != "")
    rows = lines.select("file", "block", "n", F.from_json("value", schema).alias("row"))
    return (rows.orderBy("file", "block", "n").limit(limit) if limit else rows).select("row.*")


def load_environment(spark: SparkSession, path: str, task_limit: int | None = None, corpus_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks, corpus) of trajectory records (messages, metadata): the first tasks in file order, and the last version of each document of the first records."""
    message = "struct<role:string,content:string>"
    schema = f"messages array<{message}>, metadata struct<task_id:string,gold_answer:string,difficulty:string>"
    asked = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    tasks = read_prefix(spark, path, schema, task_limit).select(F.col("metadata.task_id").alias("id"), asked.alias("question"), F.col("metadata.gold_answer").alias("answer"), F.col("metadata.difficulty").alias("difficulty"))
    records = read_prefix(spark, path, schema, corpus_limit).select(F.monotonically_increasing_id().alias("id"), "messages")
    return tasks, latest_documents(records)


def parse_lines(lines: DataFrame, schema: str, order: str = "line_no", value: str = "value", file: str = "file") -> DataFrame:
    """Parsed rows of numbered lines with a status: ok, blank, torn (a broken last line of its file) or corrupt (any other).

    The parser accepts text behind a complete object, so a line must also end as an object does.
    """
    ends = lines.groupBy(file).agg(F.max(order).alias("_last"))  # a maximum per file, so no file's lines meet in one task
    lines = lines.join(ends, file)
    body = F.trim(F.col(value))
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    whole = F.regexp_like(body, F.lit(r"(?s)^\{.*\}$")) & F.get_json_object(body, "$").isNotNull()
    status = F.when(body == "", "blank").when(whole, "ok").when(F.col(order) == F.col("_last"), "torn").otherwise("corrupt")
    return lines.select(file, order, status.alias("status"), F.when(status == "ok", parsed).alias("row"))


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of line files whose last record may be unfinished; corruption anywhere else is an error."""
    lines = spark.read.text(guarded(path)).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    rows = parse_lines(lines, schema).filter("status IN ('ok', 'corrupt')")
    sound = F.when(F.col("status") == "corrupt", F.raise_error(F.concat(F.lit("corrupt record in "), F.col("file")))).otherwise(F.lit(True))
    return rows.filter(sound).select("row.*")


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, CSV (with a header), JSON lines or one JSON array, by the path's ending."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    path = guarded(path)
    if path.endswith(".parquet"):
        return reader.parquet(path)
    if path.endswith(".orc"):
        return reader.orc(path)
    if path.endswith(".csv"):
        return reader.option("header", True).option("encoding", "UTF-8").csv(path)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if path.endswith((".jsonl", ".ndjson")):
        return reader.json(path)
    raise ValueError(f"unknown format: {path}")


def file_digests(spark: SparkSession, path: str, most: int = 1 << 30, block: int = 1 << 20) -> DataFrame:
    """(path, length, sha256) of whole files; a file without bytes has no row, as Spark's reader skips it.

    Files of up to ``most`` bytes are hashed where they are read; longer ones, which no row can hold, in blocks of one
    stream each through the session's file system.
    """
    files = spark.read.format("binaryFile").load(guarded(path))
    conf, jvm, long = spark._jsc.hadoopConfiguration(), spark._jvm, []
    for row in files.filter(F.col("length") > most).select("path", "length").toLocalIterator():
        place, digest = jvm.org.apache.hadoop.fs.Path(row["path"]), jvm.java.security.MessageDigest.getInstance("SHA-256")
        stream = jvm.java.security.DigestInputStream(place.getFileSystem(conf).open(place), digest)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), block, True)
        long.append((row["path"], row["length"], bytes(digest.digest()).hex()))
    own = files.filter(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return own.unionByName(spark.createDataFrame(long, "path string, length long, sha256 string")) if long else own


def latest_documents(records: DataFrame) -> DataFrame:
    """Corpus from tool messages (id, messages: array<struct<role, content>>; content holds ``{"result": [{id, title, text}]}``): the last record's version of each document wins."""
    docs = "result array<struct<id:string,title:string,text:string>>"
    m = records.select("id", F.posexplode("messages").alias("m", "message")).filter("message.role = 'tool'")
    d = m.select("id", "m", F.posexplode(F.from_json("message.content", docs)["result"]).alias("p", "doc")).filter("doc.id IS NOT NULL")
    w = Window.partitionBy("doc.id").orderBy(F.desc("id"), F.desc("m"), F.desc("p"))
    return d.withColumn("r", F.row_number().over(w)).filter("r = 1").select("doc.id", "doc.title", "doc.text").orderBy("id")
