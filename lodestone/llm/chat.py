"""Operator 4: chat formatting with Spark expressions only.

Turns are sorted and merged: adjacent turns of one role share a block, their texts parted by a separator; the structs
of a conversation's turns are collected in this order and joined.  The template marks blocks with control strings; control strings inside texts and roles are escaped by one
more backslash after their first character, which unescaping takes away, so every text reads back as it was.

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n ...

A conversation becomes one string, so its turns meet in one task by the nature of the result; the rows of different
conversations never do.  Pieces are joined, and the loss mask is applied, in time linear in the string: the mask holds
byte ranges, since a range of a byte string is cut without a walk from its start.

Defined cases: a null text is empty, a null role is the empty role; turns are ordered by turn (nulls first), then role
and text, so ties and repeated rows have one order; a null conv_id is a conversation of its own; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ASSISTANT = "assistant"
#: What may follow "<" or "[" in a control string, of this template and of others.
_TAIL = r"(?=\|[a-z_]+\|>|/?s>|/?SYS>>)"
_SQUARE = r"(?=/?INST\])"


def escape(text: Column) -> Column:
    once = F.regexp_replace(text, r"(<\\*)" + _TAIL, r"$1\\")
    return F.regexp_replace(once, r"(\[\\*)" + _SQUARE, r"$1\\")


def unescape(text: Column) -> Column:
    once = F.regexp_replace(text, r"(\[\\*)\\" + _SQUARE, "$1")
    return F.regexp_replace(once, r"(<\\*)\\" + _TAIL, "$1")


def escape_role(role: Column) -> Column:
    """A role stands in one line: its backslashes are doubled and its line ends written as \\n, before ``escape``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    ends = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")  # an odd backslash before n
    return F.replace(ends, F.lit("\\\\"), F.lit("\\"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_runs, loss_spans): the string, and the loss mask as runs of (characters, loss?) and as byte ranges."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    joins, goes_on = F.lag("role").over(order) == F.col("role"), F.lead("role").over(order) == F.col("role")
    pieces = rows.select(
        "conv_id", "turn", "role", "text", (F.col("role") == ASSISTANT).alias("loss"), escape("text").alias("escaped"),
        F.when(joins, F.lit(SEP)).otherwise(F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).alias("before"), F.when(goes_on, F.lit("")).otherwise(F.lit(END + "\n")).alias("after"),
    )
    size = F.octet_length("before") + F.octet_length("escaped") + F.octet_length("after")
    start = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")
    every = pieces.select("conv_id", start, "before", F.col("escaped").alias("text"), "after", "loss").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "before", "text", "after", "loss"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["text"], x["after"])), "")
    run = lambda text, loss: F.struct(F.length(text).cast("long").alias("chars"), loss.alias("loss"))
    runs = F.flatten(F.transform("p", lambda x: F.array(run(x["before"], F.lit(False)), run(x["text"], x["loss"]), run(x["after"], F.lit(False)))))
    spans = F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct((x["start"] + F.octet_length(x["before"])).alias("start"), F.octet_length(x["text"]).alias("bytes")))
    return every.select("conv_id", whole.alias("formatted"), F.filter(runs, lambda x: x["chars"] > 0).alias("loss_runs"), spans.alias("loss_spans"))


def under_mask(text: str | Column, spans: str | Column) -> Column:
    """The unescaped texts of byte ranges of a formatted string, joined; the array of one holds its bytes once for all ranges."""
    cut = lambda b: F.array_join(F.transform(spans, lambda x: unescape(F.substring(b, x["start"].cast("int") + 1, x["bytes"]).cast("string"))), "")
    return F.get(F.transform(F.array(F.col(text).cast("binary")), cut), F.lit(0))


def parsed(chats: DataFrame) -> DataFrame:
    """(conv_id, turns: array<struct<role, text>> read back from the strings, formatted, loss_runs, loss_spans)."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, i: i > 0)
    role = lambda b: unescape_role(F.substring_index(b, "\n", 1))
    body = lambda b: F.substring_index(F.substr(b, F.instr(b, "\n") + 1), END, 1)
    texts = lambda b: F.split(body(b), r"<\|im_sep\|>")
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))
    return chats.select("conv_id", turns.alias("turns"), "formatted", "loss_runs", "loss_spans")


def query(spark, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    back = parsed(formatted(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.withColumn("loss", under_mask("formatted", "loss_spans")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_CONTROL = r"<\\*(?:\|[a-z_]+\|>|/?s>|/?SYS>>)|\[\\*/?INST\]"
SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + CASE WHEN before IS NOT DISTINCT FROM role THEN 10 ELSE 24 + length(role) END)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
