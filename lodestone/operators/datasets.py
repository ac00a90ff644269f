"""Dataset engineering: splits, dedup, leakage, lineage, chunking, rendering, selection, reconciliation, constraints."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.json import is_object
from ..scratch import checkpointed


def split_of(key: Column) -> Column:
    """70 / 15 / 15 by sha256(key) mod 100."""
    bucket = T.hash_mod(key, 100)
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")


def agreed_split(df: DataFrame, key: str, title: str) -> DataFrame:
    """A record's split, if all its titles fall in one split."""
    s = df.select(key, split_of(F.col(title)).alias("split"))
    return s.groupBy(key).agg(F.min("split").alias("split"), F.max("split").alias("other")).filter("split = other").select(key, "split")


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in several splits, counted by the pair of splits; one aggregation, no self-join."""
    s = df.select(key, split).distinct().groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return s.select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("shared"))


def first_by_content(df: DataFrame, content: Column, order: str) -> DataFrame:
    """The first row of each content digest; sizes of its group."""
    d = df.withColumn("digest", F.sha2(content, 256))
    return d.groupBy("digest").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def canonical(*columns: tuple[str, Column]) -> Column:
    """Digest of canonical JSON: keys in alphabetical order, compact."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(columns, key=lambda x: x[0])])), 256)


def chained_digests(messages: Column) -> Column:
    """Digests of a list's prefixes, each made from the one before and the next message: linear in the list."""
    step = lambda acc, m: F.struct(F.sha2(F.concat(acc["last"], F.to_json(m)), 256).alias("last"), F.array_append(acc["all"], F.sha2(F.concat(acc["last"], F.to_json(m)), 256)).alias("all"))
    return F.aggregate(messages, F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")), step, lambda acc: acc["all"])


def prefix_links(turns: DataFrame, key: str) -> DataFrame:
    """Pairs of message lists of one key where one is a proper prefix of the other (columns id, messages).

    Each list is joined to its own prefixes by the prefix's chained digest, so no pairs of a key are made.
    """
    lists = turns.select(key, "id", chained_digests(F.col("messages")).alias("digests"))
    whole = lists.select(key, F.col("id").alias("prefix_id"), F.try_element_at("digests", F.lit(-1)).alias("digest"))
    cut = lists.select(key, F.col("id").alias("full_id"), F.posexplode(F.slice("digests", 1, F.size("digests") - 1)).alias("n", "digest"))
    return cut.join(whole, [key, "digest"]).select(key, "prefix_id", "full_id", (F.col("n") + 1).cast("long").alias("n"))


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """(src, target, hops, cycle) of redirects (src, dst), one for each src, followed to their ends however long.

    A walk stops where no redirect goes on, or where it comes to a name for the second time: that name is the target
    then, and cycle is true.  Each round doubles the length of all walks, so there are as many rounds as the logarithm
    of the longest; walks that outlast the number of redirects stand on a cycle, whose length is the number of its names.
    """
    n = redirects.count()

    def walked(edges: DataFrame) -> DataFrame:
        s, span = checkpointed(edges.select("src", F.col("dst").alias("at"), F.lit(1).cast("long").alias("hops"), F.least("src", "dst").alias("low"))), 1
        while span <= n and not s.join(s.select(F.col("src").alias("at")), "at", "left_semi").isEmpty():
            on = s.select(F.col("src").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("low").alias("lower"))
            s = s.join(on, "at", "left").select("src", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.least("low", "lower").alias("low"))
            s, span = checkpointed(s), span * 2
        return s

    s = walked(redirects)
    endless = checkpointed(s.join(s.select(F.col("src").alias("at")), "at", "left_semi").select("src", "at", "low"))
    ended = s.join(endless.select("src"), "src", "left_anti").select("src", F.col("at").alias("target"), "hops", F.lit(False).alias("cycle"))
    if endless.isEmpty():
        return ended
    round_ = endless.join(endless.select(F.col("at").alias("src")).distinct(), "src", "left_semi").select("src", "low")
    length = round_.groupBy("low").agg(F.count("*").alias("length"))
    round_ = checkpointed(round_.join(length, "low").select("src", "length"))
    tails = walked(redirects.join(endless.select("src"), "src", "left_semi").join(round_.select("src"), "src", "left_anti"))
    tails = tails.join(round_.withColumnRenamed("src", "at"), "at").select("src", F.col("at").alias("target"), (F.col("hops") + F.col("length")).alias("hops"))
    return ended.unionByName(tails.unionByName(round_.select("src", F.col("src").alias("target"), F.col("length").alias("hops"))).withColumn("cycle", F.lit(True)))


def manifest_join(manifest: DataFrame, results: DataFrame, key: str, payload: Column) -> DataFrame:
    """Manifest order kept; ok, missing, duplicate (equal results) or conflict, with the answer only where it is certain."""
    g = results.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(payload).alias("kinds"), F.min(payload).alias("answer"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("kinds") > 1, "conflict").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return manifest.join(g, key, "left").select(*manifest.columns, status.alias("status"), F.when(status.isin("ok", "duplicate"), F.col("answer")).alias("answer"))


def overlay(base: DataFrame, corrections: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Base rows with the last correction of each key applied."""
    last = corrections.groupBy(key).agg(F.max_by(value, order).alias("_v"), F.count("*").alias("corrections"))
    return base.join(last, key, "left").select(key, F.coalesce("_v", value).alias(value), F.coalesce("corrections", F.lit(0)).alias("corrections"))


def chunks(body: Column, size: int = 220, overlap: int = 32) -> Column:
    """[start, end) token windows that cover a token array to its end; one window for an empty body.

    The windows are laid over an array of the one length, so the body's expression is evaluated once and not for each window.
    """
    stride = size - overlap
    last = lambda n: F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("long")
    windows = lambda n: F.transform(F.sequence(F.lit(0).cast("long"), last(n)), lambda i: F.struct((i * stride).alias("start"), F.least(n, i * stride + size).alias("end")))
    return F.get(F.transform(F.array(F.size(body).cast("long")), windows), F.lit(0))


def spans(body: Column, width: int = 800) -> Column:
    """Paragraph segments of at most ``width`` characters with their offsets: joined by line ends they give the body back.

    One running sum over the paragraphs, as an Arrow batch function.
    """

    def cut(bodies: pa.Array) -> pa.Array:
        out = []
        for text in bodies.to_pylist():
            at, own = 0, []
            for p in text.split("\n") if text is not None else ():
                own += [(at + j, at + min(len(p), j + width)) for j in range(0, max(1, len(p)), width)]
                at += len(p) + 1
            out.append(None if text is None else [{"start": x, "end": y} for x, y in own])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    return F.arrow_udf(cut, "array<struct<start:bigint,end:bigint>>")(body)


#: Marks of a block's head and what stands for them, undone in reverse order.
ESCAPES = (("\\", "\\e"), ("|", "\\p"), (">", "\\g"), ("\n", "\\n"))
#: What stands for a null title, and behind the title for a null text.
NO_TITLE, NO_TEXT = "\\0", "\\z"


def _escaped(x: Column) -> Column:
    for mark, code in ESCAPES:
        x = F.replace(x, F.lit(mark), F.lit(code))
    return x


def _unescaped(x: Column) -> Column:
    for mark, code in reversed(ESCAPES):
        x = F.replace(x, F.lit(code), F.lit(mark))
    return x


def fresh_nonce(docs: Column, tries: int = 8) -> Column:
    """The first of some nonces made from the documents' ids that no text holds; an error if all are held."""
    ids = F.array_join(F.transform(docs, lambda d: d["id"]), ",")
    candidates = F.array(*[F.substring(F.md5(F.concat(ids, F.lit(f":{i}"))), 1, 8) for i in range(tries)])
    free = F.filter(candidates, lambda c: ~F.exists(docs, lambda d: F.coalesce(F.contains(d["text"], c), F.lit(False))))
    return F.coalesce(F.get(free, F.lit(0)), F.raise_error(F.lit("every nonce is held")).cast("string"))


def blocks(docs: Column, nonce: str | Column) -> Column:
    """Documents (id, title, text) rendered as blocks that a nonce sets off, so that bodies can hold anything else.

    Ids and titles can hold anything: marks of the head are escaped in them. Null titles and texts come back as nulls.
    """
    title = lambda d: F.concat(F.coalesce(_escaped(d["title"]), F.lit(NO_TITLE)), F.when(d["text"].isNull(), NO_TEXT).otherwise(""))
    nonce = F.lit(nonce) if isinstance(nonce, str) else nonce
    one = lambda d: F.concat(F.lit("<<"), nonce, F.lit(" "), _escaped(d["id"]), F.lit("|"), title(d), F.lit(">>\n"), F.coalesce(d["text"], F.lit("")), F.lit("\n<</"), nonce, F.lit(">>\n"))
    return F.array_join(F.transform(docs, one), "")


def parse_blocks(rendered: Column, nonce: str | Column) -> Column:
    """The documents of ``blocks`` read back; a nonce has letters and digits only."""
    nonce = F.lit(nonce) if isinstance(nonce, str) else nonce
    heads = F.filter(F.split(rendered, F.concat(F.lit(r"(?:^|(?<=\n<</"), nonce, F.lit(r">>\n))<<"), nonce, F.lit(" "))), lambda x: x != "")

    def one(b: Column) -> Column:
        raw = F.regexp_extract(b, r"^[^|]*\|([^>]*)>>\n", 1)
        bare = F.when(F.endswith(raw, F.lit(NO_TEXT)), F.substring(raw, F.lit(1), F.length(raw) - len(NO_TEXT))).otherwise(raw)
        text = F.when(~F.endswith(raw, F.lit(NO_TEXT)), F.call_function("regexp_extract", b, F.concat(F.lit(r"(?s)^[^\n]*>>\n(.*)\n<</"), nonce, F.lit(r">>\n$")), F.lit(1)))
        return F.struct(_unescaped(F.substring_index(b, "|", 1)).alias("id"), F.when(bare != NO_TITLE, _unescaped(bare)).alias("title"), text.alias("text"))

    return F.transform(heads, one)


def hash_order(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)


def round_robin(df: DataFrame, category: str, key: str, seed: str, n: int) -> DataFrame:
    """n rows, one of each category in turn, in hash order within it."""
    w = Window.partitionBy(category).orderBy(hash_order(seed, F.col(key)), key)
    turned = df.select(category, key).withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n)
    first = turned.orderBy("turn", category).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy("turn", category)).cast("long")).select("place", category, key)


def bottom_k(df: DataFrame, bucket: str, key: str, seed: str, k: int) -> DataFrame:
    w = Window.partitionBy(bucket).orderBy(hash_order(seed, F.col(key)), key)
    return df.select(bucket, key, F.row_number().over(w).cast("long").alias("rank")).filter(F.col("rank") <= k)


def cross_filled(df: DataFrame, is_first: Column, key: str, seed: str, first: int, other: int) -> DataFrame:
    """Quotas of two buckets; what one lacks, the other fills, all in hash order."""
    w = Window.partitionBy("bucket").orderBy(hash_order(seed, F.col(key)), key)
    ranked = df.select(key, F.when(is_first, "first").otherwise("other").alias("bucket")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= first + other)
    quota = F.when(F.col("bucket") == "first", first).otherwise(other)
    spare = F.when(F.col("r") <= quota, 0).otherwise(1)
    chosen = ranked.select(key, "bucket", spare.alias("spare"), hash_order(seed, F.col(key)).alias("h")).orderBy("spare", "h", key).limit(first + other)
    return chosen.select(key, "bucket", F.col("spare").cast("long").alias("spare"))


def greedy_disjoint(df: DataFrame, shard: str, order: str, sets: str, key: str, most: int | None = None) -> DataFrame:
    """Rows accepted in order if they share no element with an accepted one of their shard.

    Acceptance depends on all earlier rows of the shard, so a shard is one task by the operator's meaning: the shard key
    is the unit of scale, and its accepted elements are what the task holds.
    """

    def accept(rows: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        keep = []
        for r in rows.sort_values(list(dict.fromkeys([order, key]))).itertuples(index=False):
            own = set(getattr(r, sets))
            if own and not own & seen and (most is None or len(keep) < most):
                seen |= own
                keep.append((getattr(r, shard), getattr(r, key)))
        return pd.DataFrame(keep, columns=[shard, key])

    kinds = dict(df.dtypes)
    return df.select(*dict.fromkeys([shard, order, sets, key])).groupBy(shard).applyInPandas(accept, f"{shard} {kinds[shard]}, {key} {kinds[key]}")


def packed(df: DataFrame, shard: str, order: str, size: str, limit: int) -> DataFrame:
    """Next-fit packing in order: a batch is closed when the next group would overflow it."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        batch, used, out = 0, 0, []
        for n in rows[size]:
            if used and used + n > limit:
                batch, used = batch + 1, 0
            used += n
            out.append(batch)
        return rows.assign(batch=out)[[shard, order, size, "batch"]]

    kinds = dict(df.dtypes)
    return df.select(shard, order, size).groupBy(shard).applyInPandas(pack, f"{shard} {kinds[shard]}, {order} {kinds[order]}, {size} {kinds[size]}, batch long")


def quote_repairs(df: DataFrame) -> DataFrame:
    """(id, quote, body) -> the body's span that the longest common substring anchors, of the quote's length, and their similarity; a null quote or body has none."""

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, q, t in zip(b["id"], b["quote"], b["body"], strict=True):
                if q is None or t is None:
                    out.append((i, None, None, None))
                    continue
                m = SequenceMatcher(None, q, t, autojunk=False).find_longest_match()
                at = max(0, min(m.b - m.a, len(t) - len(q)))
                found = t[at : at + len(q)]
                out.append((i, at, found, round(SequenceMatcher(None, q, found, autojunk=False).ratio(), 4)))
            yield pd.DataFrame(out, columns=["id", "start", "found", "ratio"]).astype({"start": "Int64"})

    return df.select("id", "quote", "body").mapInPandas(repair, "id long, start long, found string, ratio double")


def nfkc_key(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, question_key): NFKC, case-folded, runs of other characters a space; no JVM function normalises, so Arrow batches do."""
    import re
    import unicodedata

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "question_key": [re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", x or "").casefold()).strip() for x in b[column]]})

    return df.select(key, column).mapInPandas(fold, f"{key} {dict(df.dtypes)[key]}, question_key string")


def context_ladder(df: DataFrame, budget: int, caps: tuple[int, ...] = (4000, 2000, 1000, 500, 250, 120, 60)) -> DataFrame:
    """(id, documents: array<string>, fixed: long): the widest cap of the ladder whose rendering fits, by characters.

    All rungs are lengths of one row, so the choice is an expression and no text is copied.
    """
    length = lambda cap: F.col("fixed") + F.aggregate("documents", F.lit(0).cast("long"), lambda s, d: s + F.least(F.length(d), F.lit(cap)))
    rungs = F.array(*[F.struct(F.lit(c).alias("cap"), length(c).alias("length")) for c in caps])
    fits = F.get(F.filter(rungs, lambda r: r["length"] <= budget), F.lit(0))
    return df.select("id", fits["cap"].cast("long").alias("cap"), fits["length"].alias("length"), F.when(fits.isNull(), F.when(F.col("fixed") > budget, "mandatory_too_long").otherwise("documents_too_long")).alias("failure"))


def ngrams(words: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    one = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[one(n) for n in sizes]))


def parsed_action(raw: Column) -> dict[str, Column]:
    """Strict action parse: code fence off, exactly one JSON object, search with a query or answer with an answer, not blank."""
    body = F.trim(F.regexp_replace(F.trim(raw), r"(?s)^```[^\n]*\n(.*)\n```$", "$1"))
    shaped = is_object(body)
    get = lambda k: F.trim(F.get_json_object(body, f"$.{k}"))
    action = F.when(shaped, get("action"))
    query, answer = F.coalesce(get("query"), get("text")), get("answer")
    ok = F.when((action == "search") & (F.length(query) > 0), "search").when((action == "answer") & (F.length(answer) > 0), "answer").otherwise("invalid")
    return {"action": ok, "argument": F.when(ok == "search", query).when(ok == "answer", answer)}


def constraints(df: DataFrame, **rules: Column) -> DataFrame:
    """One row for each rule: rows seen and rows that break it (null counts as broken); a single pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return row.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("r")).select("r.rule", F.col("n").alias("rows"), "r.violations", (F.col("r.violations") == 0).alias("passed"))
