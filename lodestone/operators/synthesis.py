"""Training rows and probe cases made from documents: search-and-answer trajectories, seeded splits, frozen conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import md5_mod
from .validators import CONDITIONS

SYSTEM = "Search the documents, then answer. Say one JSON object at a time: search with a query, or answer with an answer."
TEMPLATES = ("What do the documents say about {title}?", "Tell me about {title}.", "Which facts are there on {title}?", "Look up {title} first, then sum it up.")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _says(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def trajectory(question: Column, docs: Column, answer: Column) -> Column:
    """Messages of a row: system, user, then a search by title and its result for each document (id, title, text), then the answer."""
    search = lambda d: _message("assistant", _says(action=F.lit("search"), query=d["title"]))
    result = lambda d: _message("tool", _says(ok=F.lit(True), result=F.array(F.struct(d["id"].alias("id"), d["title"].alias("title"), d["text"].alias("text"), F.lit(1).alias("score")))))
    turns = F.flatten(F.transform(docs, lambda d: F.array(search(d), result(d))))
    return F.concat(F.array(_message("system", F.lit(SYSTEM)), _message("user", question)), turns, F.array(_message("assistant", _says(action=F.lit("answer"), answer=answer))))


def generated_split(corpus: DataFrame, count: int, split: str, seed: str) -> DataFrame:
    """(task_id, question, messages, gold_answer): ``count`` rows over the documents in id order, round again where they are fewer; the template by hash.

    Only the first ``count`` documents are ordered, so what is numbered in one task is bounded by the rows asked for.
    """
    shift = 0 if split == "train" else 1
    n = corpus.count()
    if not n:
        raise ValueError("the corpus is empty")
    near = corpus.select("id", "title", "text").orderBy("id").limit(count + shift).withColumn("at", F.row_number().over(Window.orderBy("id")) - 1)
    rows = corpus.sparkSession.range(count).select(F.col("id").alias("index"), ((F.col("id") + shift) % n).cast("int").alias("at"))
    picked = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (md5_mod(F.concat_ws(":", F.lit(seed), F.col("index").cast("string")), len(TEMPLATES)) + 1).cast("int"))
    rows = rows.join(near, "at").withColumn("question", F.replace(picked, F.lit("{title}"), F.col("title")))
    doc = F.array(F.struct("id", "title", "text"))
    return rows.select(F.concat(F.lit(f"{split}-"), F.lpad(F.col("index").cast("string"), 5, "0")).alias("task_id"), "question", trajectory(F.col("question"), doc, F.col("text")).alias("messages"), F.col("text").alias("gold_answer"))


def probe_cases(tasks: DataFrame, key: str) -> DataFrame:
    """Each task under each frozen condition, with the id that names both."""
    return tasks.select("*", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition")).withColumn("case_id", F.concat_ws(":", F.col(key).cast("string"), "condition"))
