"""What a model had in view: context budgets of several encodings, last visible documents, identifiers anywhere in JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import structure as X
from ..functions import text as T
from ..scratch import written
from .retrieval import parts


class Step(NamedTuple):
    """A stage of a ladder: characters of a body by rank (the last one for all further ranks; None: whole), ranks kept (None: all)."""

    caps: tuple[int | None, ...]
    ranks: int | None = None


def _even(*caps: int | None) -> tuple[Step, ...]:
    return tuple(Step((c,)) for c in caps)


#: The stages of each encoding, from the whole texts to the shortest, and whether a text seen before is a reference.
LADDERS: dict[str, tuple[bool, tuple[Step, ...]]] = {
    "legacy": (False, (*_even(None, 256, 160, 96, 64, 48), Step((64,), 2), Step((48,), 1), Step((0,), 1))),
    "compact-v1": (True, _even(None, 256, 160, 96, 64, 48)),
    "compact-v2": (True, _even(None, 320, 192, 128, 96, 64, 48)),
    "compact-v3": (True, tuple(Step((*c, None)) for c in ((None, None, None), (None, None, 320), (None, None, 192), (None, 320, 192), (None, 192, 128), (320, 192, 128), (192, 128, 96), (128, 96, 64), (96, 64, 48)))),
}
#: Tokens that a message, a document and a reference cost beside their texts.
MESSAGE_MARKS, DOCUMENT_MARKS, REFERENCE_MARKS = 4, 4, 2


def word_count(text: Column) -> Column:
    """The length of a text where no tokenizer is given."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n]+")), F.lit(0)).cast("long")


def whole_sentences(text: Column, cap: int | None) -> Column:
    """The longest start of whole sentences within the cap; empty if none ends there."""
    if cap is None:
        return text
    return F.when(F.length(text) <= cap, text).otherwise(F.regexp_extract(F.substring(text, 1, cap), r"(?s)^(.*[.!?])(?:\s|$)", 1))


def context_budget(messages: DataFrame, shown: DataFrame, most: int, encoding: str, length: Callable[[Column], Column] = word_count) -> DataFrame:
    """(case, stage, step, tokens, original, trimmed, references, conflicts, deleted, failure) of each case: the first stage of the encoding's ladder that fits.

    ``messages`` (case, at, role, content) are the texts, ``shown`` (case, at, rank, id, title, text) the documents of tool
    messages.  The first system and user message are mandatory, the history is never cut.  A stage at which a document
    keeps no whole sentence is left out, but for the legacy stages that delete low ranks.  Failures: no system or user
    message; mandatory messages beyond the budget; no stage that fits.  A document's costs at all stages are made in one
    pass and only they are grouped."""
    refers, ladder = LADDERS[encoding]
    cost = length(F.col("content")) + MESSAGE_MARKS
    first = lambda role: F.min_by(F.struct("at", cost.alias("n")), F.when(F.col("role") == role, F.col("at")))
    heads = messages.groupBy("case").agg(F.sum(cost).alias("texts"), first("system").alias("s"), first("user").alias("u"), F.count_if(F.col("role") == "system").alias("ns"), F.count_if(F.col("role") == "user").alias("nu"))
    tools = shown.groupBy("case").agg(F.count_distinct("at").alias("tools"))
    order = ("at", "rank")
    doc = shown.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.md5(F.concat_ws("\x00", F.coalesce("title", F.lit("")), "text")))
    doc = doc.withColumn("same", F.row_number().over(Window.partitionBy("case", "id", "digest").orderBy(*order))).withColumn("named", F.row_number().over(Window.partitionBy("case", "id").orderBy(*order)))
    again = F.lit(refers) & F.col("id").isNotNull() & (F.col("same") > 1)
    base = length(F.col("id")) + length(F.col("title"))

    def stage(step: Step) -> Column:
        caps = [whole_sentences(F.col("text"), c) for c in step.caps]
        body = caps[-1]
        for n in range(len(caps) - 1, 0, -1):
            body = F.when(F.col("rank") == n, caps[n - 1]).otherwise(body)
        gone = (F.col("text") != "") & (body == "")
        beyond = F.lit(False) if step.ranks is None else F.col("rank") > step.ranks
        cut = ~again & (gone | beyond)
        tokens = F.when(beyond, 0).when(again, length(F.col("id")) + REFERENCE_MARKS).when(gone, 0).otherwise(base + length(body) + DOCUMENT_MARKS)
        return F.struct(tokens.cast("long").alias("tokens"), (~again & ~cut & (F.length(body) < F.length("text"))).alias("trimmed"), (again & ~beyond).alias("reference"), cut.alias("deleted"), (~again & gone & F.lit(step.ranks is None)).alias("unsatisfied"))

    conflict = F.lit(refers and encoding != "compact-v1") & F.col("id").isNotNull() & ~again & (F.col("named") > 1)
    staged = doc.select("case", conflict.alias("conflict"), (base + length(F.col("text")) + DOCUMENT_MARKS).alias("whole"), F.posexplode(F.array(*[stage(s) for s in ladder])).alias("step", "c"))
    per = staged.groupBy("case", "step").agg(
        F.sum("c.tokens").alias("docs"), F.sum("whole").alias("whole"), F.count_if("c.trimmed").alias("trimmed"), F.count_if("c.reference").alias("references"), F.count_if("conflict").alias("conflicts"), F.count_if("c.deleted").alias("deleted"), F.count_if("c.unsatisfied").alias("unsatisfied")
    )
    cases = heads.join(tools, "case", "left").withColumn("fixed", F.col("texts") + F.coalesce("tools", F.lit(0)) * MESSAGE_MARKS)
    every = cases.select("case", "fixed", "ns", "nu", (F.col("s.n") + F.col("u.n")).alias("mandatory"), F.explode(F.sequence(F.lit(0), F.lit(len(ladder) - 1))).alias("step")).join(per, ["case", "step"], "left")
    every = every.withColumn("tokens", F.col("fixed") + F.coalesce("docs", F.lit(0)))
    fits = (F.col("tokens") <= most) & (F.coalesce("unsatisfied", F.lit(0)) == 0)
    counts = ("trimmed", "references", "conflicts", "deleted")
    best = every.groupBy("case").agg(
        F.min(F.when(fits, F.struct("step", "tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]))).alias("b"), F.first("fixed").alias("fixed"), F.max("whole").alias("whole"), F.first("ns").alias("ns"), F.first("nu").alias("nu"), F.first("mandatory").alias("mandatory")
    )
    failure = F.when((F.col("ns") == 0) | (F.col("nu") == 0), "no_system_or_question").when(F.col("mandatory") > most, "mandatory_over_budget").when(F.col("b").isNull(), "history_and_evidence_over_budget")
    ok = failure.isNull()
    return best.select(
        "case", F.when(ok, F.when(F.col("b.step") == 0, "none").otherwise("observation_compacted")).alias("stage"), F.when(ok, F.col("b.step")).cast("long").alias("step"), F.when(ok, F.col("b.tokens")).alias("tokens"),
        (F.col("fixed") + F.coalesce("whole", F.lit(0))).alias("original"), *[F.when(ok, F.col(f"b.{c}")).alias(c) for c in counts], failure.alias("failure"),
    )


#: Flags that must be false, and kept, before a legacy input without metadata of its documents counts as whole.
CERTIFIED = ("prompt_truncated", "lossy_body_trimmed", "history_dropped", "context_budget_error")


def last_visible(steps: DataFrame) -> DataFrame:
    """(case, reason, documents: array of (id, texts)): what the last saved input of each case shows, or null where that isn't known.

    ``steps`` (case, step, context, result): context is a struct (presentation, document_changes, observation_encoding,
    truncation_stage, documents_deleted and the CERTIFIED flags), a change a struct (document_id, original_text, visible,
    deleted, visible_segments); result an array of (id, text) that the step returned.  Saved segments are cut out of the
    saved texts by offset; a truncated or unknown context is never taken for a whole one, but for a legacy one that says
    so in every flag, which shows all that earlier steps returned."""
    last = steps.groupBy("case").agg(F.max_by("context", "step").alias("c"), F.max("step").alias("at"))
    changes = F.filter("c.document_changes", lambda d: F.coalesce(d["visible"], F.lit(False)) & ~F.coalesce(d["deleted"], F.lit(False)))
    broken = lambda d: F.when(d["document_id"].isNull() | d["original_text"].isNull(), "visible_document_body_not_saved").when(F.exists(F.coalesce(d["visible_segments"], F.array()), lambda s: (F.size(s) != 2) | F.exists(s, lambda x: x.isNull())), "invalid_visible_segment_metadata")
    fault = F.get(F.filter(F.transform(changes, broken), lambda x: x.isNotNull()), F.lit(0))
    whole = (F.col("c.observation_encoding") == "legacy") & (F.col("c.truncation_stage") == "none") & (F.col("c.documents_deleted") == 0) & F.col("c.document_changes").isNotNull()
    for flag in CERTIFIED:
        whole = whole & (F.col(f"c.{flag}") == F.lit(False))
    saved = F.size(F.coalesce("c.document_changes", F.array())) > 0
    reason = (
        F.when(F.col("c").isNull(), "no_saved_model_input").when(F.col("c.presentation").isNotNull() & (F.col("c.presentation") != "legacy-json"), "nonlegacy_presentation_not_reconstructed")
        .when(saved, F.coalesce(fault, F.lit("saved_document_changes_visible_segments"))).when(F.coalesce(whole, F.lit(False)), "explicit_legacy_no_truncation_all_prior_tools_retained").otherwise("last_input_visibility_not_certified_by_saved_metadata")
    )
    decided = last.select("case", "at", reason.alias("reason"), F.when(reason == "saved_document_changes_visible_segments", changes).alias("changes"))
    cut = lambda d: F.transform(F.coalesce(d["visible_segments"], F.array()), lambda s: F.substring(d["original_text"], s[0] + 1, F.greatest(s[1] - s[0], F.lit(0))))
    parts = decided.select("case", F.posexplode("changes").alias("n", "d")).select("case", F.lit(0).cast("long").alias("step"), "n", F.col("d.document_id").alias("id"), cut(F.col("d")).alias("texts"))
    legacy = decided.filter("reason = 'explicit_legacy_no_truncation_all_prior_tools_retained'").select("case", "at")
    kept = steps.join(legacy, "case").filter("step < at").select("case", "step", F.posexplode("result").alias("n", "d")).filter("d.id IS NOT NULL AND d.text IS NOT NULL")
    rows = parts.unionByName(kept.select("case", "step", "n", F.col("d.id").alias("id"), F.array("d.text").alias("texts")))
    docs = rows.groupBy("case", "id").agg(F.array_sort(F.collect_list(F.struct("step", "n", "texts"))).alias("t")).select("case", F.struct("id", F.flatten(F.transform("t", lambda x: x["texts"])).alias("texts")).alias("doc")).filter(F.size("doc.texts") > 0)
    listed = docs.groupBy("case").agg(F.array_sort(F.collect_list("doc")).alias("documents"))
    known = F.col("reason").isin("saved_document_changes_visible_segments", "explicit_legacy_no_truncation_all_prior_tools_retained")
    none = F.array().cast(listed.schema["documents"].dataType)
    return decided.join(listed, "case", "left").select("case", "reason", F.when(known, F.coalesce("documents", none)).alias("documents"))


#: Keys whose strings are identifiers, and the key of questions.
ID_KEYS, QUESTION_KEY = ("qid", "source_id", "task_id", "id"), "question"


def exposed(records: DataFrame, pattern: str = r"^(?:[a-z]+[-:])?([0-9a-f]{24})$") -> DataFrame:
    """(source, kind, value), distinct: identifiers under ID_KEYS and normalised questions, at any depth of JSON (source, raw).

    Objects and lists are opened level by level until none is left, so the number of passes is the depth of the
    deepest record; a record that is no JSON gives nothing, a value of another type than text neither."""
    spark = records.sparkSession
    level = written(records.select("source", F.try_parse_json("raw").alias("v"), F.lit(None).cast("string").alias("key")))
    out = None
    while True:
        opened = written(spark.sql("SELECT source, e.value AS v, e.key AS key, schema_of_variant(e.value) AS kind FROM {level}, LATERAL variant_explode(v) AS e", level=level))
        text = F.try_variant_get("v", "$", "string")
        found = opened.filter(F.col("kind") == "STRING").select("source", F.when(F.col("key") == QUESTION_KEY, "question").when(F.col("key").isin(*ID_KEYS), "id").alias("kind"), text.alias("t")).filter("kind IS NOT NULL")
        found = found.select("source", "kind", F.when(F.col("kind") == "question", T.norm(F.col("t"))).otherwise(F.regexp_extract(F.lower("t"), pattern, 1)).alias("value")).filter("value <> ''")
        out = found if out is None else out.unionByName(found)
        level = opened.filter(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")).select("source", "v", "key")
        if level.isEmpty():
            return out.distinct()


def byte_pairs(path: str) -> Callable[[], Callable[[list[str]], list[list[tuple[int, int]]]]]:
    """A tokenizer for ``token_spans``: the vocabulary file is read here and sent to the tasks, which give each token's characters."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()

    def make():
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(definition)
        own.encode_special_tokens = True  # their strings in a text are text
        return lambda texts: [e.offsets for e in own.encode_batch(texts, add_special_tokens=False)]

    return make


def rendered(messages: DataFrame, shown: DataFrame) -> DataFrame:
    """(case, text, docs: array of (at, rank, id, start, end)): a case's messages as one input, and where in it each document's escaped body stands.

    A tool message is a JSON object of its documents; all pieces of the input are made by expressions and placed by a
    running sum, so nothing is searched for: a body that stands there twice, or reads like JSON, is no matter."""
    quoted = lambda x: F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("v")))  # noqa: E731  {"v":"..."}
    inner = lambda j: F.substring(j, F.lit(7), F.length(j) - 8)
    none = F.lit(None).cast("struct<rank:int,id:string>")
    piece = lambda text, doc: F.struct(text.alias("text"), doc.alias("doc"))
    texts = messages.select("case", "at", F.array(piece(F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.coalesce("content", F.lit("")), F.lit("\n")), none)).alias("pieces"))
    docs = shown.groupBy("case", "at").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("id").cast("string").alias("id"), inner(quoted(F.col("text"))).alias("body")))).alias("d"))
    opening = lambda d, i: F.concat(F.when(i == 0, '<|tool|>\n{"result":[').otherwise(","), F.lit('{"id":"'), inner(quoted(d["id"])), F.lit('","text":"'))
    each = F.flatten(F.transform("d", lambda d, i: F.array(piece(opening(d, i), none), piece(d["body"], F.struct(d["rank"].alias("rank"), d["id"].alias("id"))), piece(F.lit('"}'), none))))
    tools = docs.select("case", "at", F.concat(each, F.array(piece(F.lit("]}\n"), none))).alias("pieces"))
    parts = texts.unionByName(tools).groupBy("case").agg(F.array_sort(F.collect_list(F.struct("at", "pieces"))).alias("m"))
    flat = parts.select("case", F.flatten(F.transform("m", lambda m: F.transform(m["pieces"], lambda p: F.struct(m["at"].alias("at"), p["text"].alias("text"), p["doc"].alias("doc"))))).alias("p"))
    placed = flat.select("case", "p", X.with_offsets(F.transform("p", lambda p: p["text"])).alias("o"))
    spans = F.filter(F.zip_with("p", "o", lambda p, o: F.struct(p["at"].alias("at"), p["doc"]["rank"].alias("rank"), p["doc"]["id"].alias("id"), o["start"].alias("start"), o["end"].alias("end"), p["doc"].isNotNull().alias("is"))), lambda x: x["is"])
    return placed.select("case", F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"), F.transform(spans, lambda s: s.dropFields("is")).alias("docs"))


def token_spans(inputs: DataFrame, tokenizer: Callable[[], Callable[[list[str]], list[list[tuple[int, int]]]]]) -> DataFrame:
    """(case, tokens, at, rank, id, start, end, first, last, body) of ``rendered``'s documents: the tokens that touch a body, the last one behind; 0, 0 for none.

    Each input is tokenised once, whole; a body's tokens are found by bisection of the tokens' ends and starts."""
    case = inputs.schema["case"].dataType.simpleString()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets_of = tokenizer()
        for batch in parts(batches):
            counts, spans = [], []
            for text, own in zip(batch.column("text"), batch.column("spans"), strict=True):
                own, (offsets,) = own.as_py(), offsets_of([text.as_py() or ""])  # one input's tokens at a time
                starts, ends = np.array(offsets, dtype=np.int64).reshape(-1, 2).T
                counts.append(len(starts))
                both = [(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))) if b > a else (0, 0) for a, b in ((s["start"], s["end"]) for s in own)]
                spans.append([{"first": f, "last": n} if f < n else {"first": 0, "last": 0} for f, n in both])
            yield pa.RecordBatch.from_arrays([batch.column("case"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], names=["case", "tokens", "spans"])

    stored = written(inputs)
    found = stored.select("case", "text", F.transform("docs", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"))).alias("spans")).mapInArrow(mapped, f"case {case}, tokens long, spans array<struct<first:long,last:long>>")
    each = stored.join(found, "case").select("case", "text", "tokens", F.explode(F.arrays_zip("docs", "spans")).alias("z"))
    body = F.substring("text", (F.col("z.docs.start") + 1).cast("int"), (F.col("z.docs.end") - F.col("z.docs.start")).cast("int"))
    return each.select("case", "tokens", "z.docs.*", "z.spans.*", body.alias("body"))


def user_rewards(steps: DataFrame, key: str, order: str, functions: dict[str, Callable]) -> DataFrame:
    """(key, one column for each function, total): rewards that a user wrote, each called with a trajectory's steps in order as a pandas frame.

    A trajectory's steps meet in one task, which is what such a function is about; the shipped rewards
    (``operators.rewards``) are expressions and need no such meeting.  A null or missing reward counts as nothing.

    Spark sorts and numbers the steps, and a batch of many trajectories becomes one pandas frame, which is cut where a number
    is 1.  A column of whole numbers or booleans comes twice, the second time without nulls, so that a trajectory without
    nulls has the column's own kind whatever others have."""
    kinds = dict(steps.dtypes)
    names, columns = list(functions), steps.columns
    exact = {c: f"_exact_{n}" for n, c in enumerate(columns) if kinds[c] in ("tinyint", "smallint", "int", "bigint", "boolean")}
    numbered = steps.select(
        "*", *[F.coalesce(F.col(f"`{c}`"), F.lit(0).cast(kinds[c])).alias(x) for c, x in exact.items()],
        F.row_number().over(Window.partitionBy(f"`{key}`").orderBy(F.col(f"`{order}`").asc_nulls_last())).alias("_number"),
    )

    def scored(frames):
        import pandas as pd

        def rows(frame):
            at = (frame["_number"].to_numpy() == 1).nonzero()[0]
            at = at if len(at) else np.zeros(1, np.int64)
            plain = frame[columns]
            nulls = {c: np.logical_or.reduceat(plain[c].isna().to_numpy(), at).tolist() for c, x in exact.items() if plain[c].dtype != frame[x].dtype}
            full = plain.assign(**{c: frame[exact[c]] for c in nulls})
            found = []
            for n, (a, b) in enumerate(zip(at.tolist(), [*at[1:].tolist(), len(frame)], strict=True)):
                lacking = [c for c in nulls if nulls[c][n]]
                part = (plain if len(lacking) == len(nulls) else full).iloc[a:b]
                part.index = pd.RangeIndex(b - a)
                if 0 < len(lacking) < len(nulls):
                    part = part.assign(**{c: plain[c].to_numpy()[a:b] for c in lacking})
                own = [functions[n](part) for n in names]
                found.append([part[key].iloc[0], *[None if x is None else float(x) for x in own], float(sum(x for x in own if x is not None))])
            out = pd.DataFrame(found, columns=[key, *names, "total"])
            if key in exact:
                out[key] = pd.Series([None if x[0] != x[0] else x[0] for x in found], dtype=object)
            return out

        joined = lambda pieces: pd.concat(pieces, ignore_index=True) if len(pieces) > 1 else pieces[0]
        held = []  # pieces of the trajectory that may go on in the next frame
        for frame in frames:
            starts = (frame["_number"].to_numpy() == 1).nonzero()[0]
            if not len(starts):
                held.append(frame)
                continue
            if held and starts[0]:
                held.append(frame.iloc[: starts[0]])
            if held:
                yield rows(joined(held))
            if starts[-1] > starts[0]:
                yield rows(frame.iloc[starts[0] : starts[-1]])
            held = [frame.iloc[starts[-1] :]]
        if held:
            yield rows(joined(held))

    return numbered.mapInPandas(scored, ", ".join([f"`{key}` {kinds[key]}", *[f"`{n}` double" for n in names], "total double"]))
