"""Episodes of a search agent as waves: every step is one pass over all open episodes, and each wave is written before the next.

A policy is any picklable object with ``act(states) -> raw outputs``; a state has qid, question, and the queries and
results so far.  A model's client takes that place; the one here follows a script.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from ..scratch import written
from . import datasets as D
from . import retrieval as R


class Policy(Protocol):
    def act(self, states: list[dict]) -> list[str]: ...


class Scripted:
    """By question number: search and answer with the best document, repeat a search, say no JSON, or go on searching."""

    def act(self, states: list[dict]) -> list[str]:
        import json

        out = []
        for s in states:
            kind, step = s["qid"] % 4, len(s["queries"])
            query = s["question"] if kind != 3 else f"{s['question']} {step}"
            if kind == 2:
                out.append("no action")
            elif kind == 0 and step:
                out.append(json.dumps({"action": "answer", "answer": (list(s["results"][-1]) or ["nothing"])[0]}))
            else:
                out.append(json.dumps({"action": "search", "query": query}))
        return out


STATE = "qid long, question string, queries array<string>, results array<array<string>>, answer string, reason string"


def rollouts(tasks: DataFrame, corpus: DataFrame, policy: Policy, max_steps: int = 5, k: int = 3, repairs: int = 0) -> DataFrame:
    """(qid, queries, results, answer, reason) of each task (qid, question).

    An episode ends with an answer, an invalid action, a search that it made before (after ``repairs`` further tries in
    its place), or the last step.  Searches of a wave are one batch of questions.
    """

    def act(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states = [{"qid": q, "question": t, "queries": list(x), "results": [list(y) for y in r]} for q, t, x, r in zip(b["qid"], b["question"], b["queries"], b["results"], strict=True)]
            yield b.assign(raw=policy.act(states) if states else [])

    empty = F.array().cast("array<string>")
    state = written(tasks.select(F.col("qid").cast("long").alias("qid"), "question", empty.alias("queries"), F.array().cast("array<array<string>>").alias("results"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("reason")))
    for step in range(max_steps):
        if state.filter("reason is null").isEmpty():
            break
        acted = state.filter("reason is null").mapInPandas(act, f"{STATE}, raw string")
        p = D.parsed_action(F.col("raw"))
        acted = acted.withColumns({"action": p["action"], "argument": p["argument"]})
        again = (F.col("action") == "search") & F.exists("queries", lambda q: norm(q) == norm(F.col("argument")))
        tried = F.size(F.filter("queries", lambda q: norm(q) == norm(F.col("argument"))))
        reason = F.when(F.col("action") == "answer", "answer").when(F.col("action") == "invalid", "invalid_action").when(again & (tried > repairs), "repeated_action")
        acted = written(acted.withColumn("reason", reason).withColumn("answer", F.when(F.col("action") == "answer", F.col("argument"))))
        asked = acted.filter("reason is null").select("qid", F.col("argument").alias("question"))
        hits = R.bm25_search(corpus, asked, k, boost=False).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("found"))
        went = acted.join(hits, "qid", "left").select(
            "qid", "question", F.when(F.col("reason").isNull(), F.array_append("queries", F.col("argument"))).otherwise(F.col("queries")).alias("queries"),
            F.when(F.col("reason").isNull(), F.array_append("results", F.coalesce("found", empty))).otherwise(F.col("results")).alias("results"), "answer",
            F.coalesce("reason", F.lit("max_steps") if step == max_steps - 1 else F.lit(None).cast("string")).alias("reason"),
        )
        state = written(state.filter("reason is not null").unionByName(went))
    return state.drop("question")
