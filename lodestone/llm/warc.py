"""Operator 6: WARC archives without repeated payloads.

Payload headers (digest, size, page) are shuffled by digest and reduced, before the shuffle, to the first page of each
digest; every further page of at least ``LEAST`` bytes becomes a revisit record that refers to that first response.
Archives are written by Spark's text writer, one record a row with CRLF CRLF between records, which is WARC 1.1's
framing: tasks commit through Spark's protocol, so a lost executor leaves no half file, and any store that Spark writes
will do.  Reading parses whole files by Content-Length and joins the revisit records to their responses by record id.

Defined cases: a null html is an empty payload, a null url leaves WARC-Target-URI out; payloads under ``LEAST`` bytes
are all responses; of rows that repeat the first page_id of a payload one is the response and the others revisit it (rows
that repeat a page_id with its payload are written once with a number, by which reruns know them); a null page_id is kept
as null and comes last; lines in urls are percent-encoded; an empty table gives archives without
records; other columns are not read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _made, arrow_map, checkpointed, scratch, small, written

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Bytes of one file, by the mean record: a reader holds one file at a time.
FILE_BYTES = 8 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def numbered(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, sha and row: with page_id and sha it tells rows apart, whenever they are evaluated."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("sha"))
    again = rows.groupBy("sha", "page_id").agg(F.count("*").alias("c")).filter("c > 1")
    again = checkpointed(again.select(F.col("sha").alias("a_sha"), F.col("page_id").alias("a_page")))
    if again.isEmpty():
        return rows.withColumn("row", F.lit(0).cast("long"))
    same = (F.col("sha") == F.col("a_sha")) & F.col("page_id").eqNullSafe(F.col("a_page"))
    repeated = written(rows.join(small(again), same).select(*rows.columns, (F.monotonically_increasing_id() + 1).alias("row")))
    return rows.join(small(again), same, "left_anti").withColumn("row", F.lit(0).cast("long")).unionByName(repeated)


def headers(rows: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest and row of numbered pages, without the payloads."""
    return rows.select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "row")


def record_id(digest: Column, page: Column, row: Column) -> Column:
    """A urn:uuid that depends on the page, its payload and its row."""
    h = F.md5(F.concat_ws(":", digest, F.coalesce(page.cast("string"), F.lit("null")), row.cast("string")))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def originals(head: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, o_page, o_row, o_url) of the response that revisits of a repeated payload refer to."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "row", "url")).alias("o")
    found = head.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(first, F.count("*").alias("c")).filter("c > 1")
    return found.select(F.col("payload_digest").alias("digest"), F.col("o.page_id").alias("o_page"), F.col("o.row").alias("o_row"), F.col("o.url").alias("o_url"))


def records(rows: DataFrame, head: DataFrame, least: int = LEAST) -> DataFrame:
    """One column ``value``: a whole record but for the closing CRLF CRLF.  Payloads are not shuffled if the repeats are few."""
    first = checkpointed(originals(head, least))
    j = rows.join(small(first), F.col("sha") == F.col("digest"), "left")
    revisit = F.col("digest").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("o_page")) & (F.col("row") == F.col("o_row")))
    uri = lambda c: F.replace(F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
        line("WARC-Record-ID", record_id(F.col("sha"), F.col("page_id"), F.col("row"))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("sha"), F.col("o_page"), F.col("o_row"))), line("WARC-Refers-To-Target-URI", uri(F.col("o_url"))), line("WARC-Refers-To-Date", F.lit(DATE)))).otherwise(""),
        line("X-Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF),
    )
    return j.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST, compression: str = "none") -> str:
    """Write deduplicated archives into the folder ``path``."""
    rows = numbered(pages)
    head = checkpointed(headers(rows))
    mean = head.agg(F.avg("payload_bytes")).first()[0] or 0
    per_file = max(1, int(FILE_BYTES // (mean + 600)))
    records(rows, head, least).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)
    return path


RECORD = "page_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string, stored_bytes long, payload binary"


def parse(content: bytes):
    """The records of an archive, by Content-Length: (WARC headers, HTTP head, stored payload)."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        named = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(named["Content-Length"])
        body = content.index(b"\r\n\r\n", start, stop) + 4
        yield named, content[start:body], content[body:stop]
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        at = stop + 4


def _parse_all(payloads: bool):
    def run(batches):
        kinds = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stored_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for named, http, payload in parse(content.as_py()):
                    full = int(dict(x.split(": ", 1) for x in http.decode().split(CRLF)[1:] if x)["Content-Length"])
                    page = named.get("X-Page-Id")
                    rows.append({"page_id": page and int(page), "record_id": named["WARC-Record-ID"], "record_type": named["WARC-Type"], "refers_to_id": named.get("WARC-Refers-To"), "payload_bytes": full, "payload_digest": named["WARC-Payload-Digest"].removeprefix("sha256:"), "stored_bytes": len(payload), "payload": payload if payloads else None})
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives of a folder; payloads as stored, if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow_map(files, _parse_all(payloads), RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """Records with ``refers_to``: the page_id of the response that a revisit names."""
    named = found.filter("record_type = 'revisit'").select(F.col("refers_to_id").alias("id")).distinct()
    response = checkpointed(found.filter("record_type = 'response'").select(F.col("record_id").alias("id"), F.col("page_id").alias("refers_to")).join(named, "id", "left_semi"))
    return found.join(small(response), F.col("refers_to_id") == F.col("id"), "left").drop("id")


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    _made.append((spark, path))
    return resolved(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, strlen(h)::BIGINT AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, CASE WHEN n >= 100 AND page_id <> first THEN 0 ELSE n END AS stored_bytes
FROM r
"""
