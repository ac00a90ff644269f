"""Searches that follow from what earlier ones found: query variants, titles named in texts, greedy paths to stated facts.

Paths of all questions advance together: a hop is one batch of searches for every open path, so the number of jobs is
the number of hops and not of paths.  A path's state (queries asked, documents seen, facts closed) is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..scratch import written
from .retrieval import Counted, bm25_search, few

#: Words that open a question, and words that no content query holds.
OPENERS = "which what who when where how the did is was".split()
FILLERS = "which what who when where how the did does was were are is with from that this same have has their they".split()
#: Words at which a question falls into clauses.
CONJUNCTIONS = "or and but while whereas".split()
PHRASE = r"[A-Z][A-Za-z0-9'’.-]*(?:[ \t\n]+[A-Z][A-Za-z0-9'’.-]*){0,4}"
WORD = r"[A-Za-z0-9'’.-]+"
#: Words of a title that are compared, characters that a linked title has at least.
TITLE_WORDS, LEAST_TITLE = 16, 6
#: Variants of a hop, characters of a query, first queries that are followed, hops.
VARIANTS, QUERY_CHARS, PARTIAL, FULL, HOPS = 56, 500, 4, 1, 4
#: Sentences of a document that a hop asks; ids of documents up to which they are broadcast.
SENTENCES, KNOWN = 4, 1_000_000


def _runs(words: Column, n: int, made) -> Column:
    """``made(place, run)`` of every n words in a row; by places, as slices would copy the array for each run."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: made(i, F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)])))


def question_variants(questions: DataFrame) -> DataFrame:
    """(qid, place, query, key): narrow queries made of a question's own spans; of equal normal forms the first."""
    q = F.col("question")
    phrases = F.filter(F.regexp_extract_all(q, F.lit(f"({PHRASE})"), 1), lambda p: (F.length(p) >= 5) & ~F.lower(p).isin(OPENERS))
    marked = F.array_join(F.transform(F.split(q, "[ \t\n]+"), lambda w: F.when(F.lower(w).isin(CONJUNCTIONS), F.lit("\x01")).otherwise(w)), " ")
    clauses = F.filter(F.transform(F.split(marked, "\x01"), lambda c: F.trim(c, F.lit(" ?.,"))), lambda c: F.length(c) >= 12)
    content = F.filter(F.regexp_extract_all(q, F.lit(f"({WORD})"), 1), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(FILLERS))
    base = questions.filter("question is not null").select("qid", "question", phrases.alias("p"), clauses.alias("c"), content.alias("w"))
    w = F.col("w")
    grams = [_runs(w, n, lambda i, run: run) for n in (2, 3, 4)]
    both = F.flatten(F.transform("p", lambda p: F.array(p, F.concat(q, F.lit(" "), p))))
    rows = base.select("qid", F.posexplode(F.concat(F.array(q), both, "c", *grams, "w")).alias("place", "query")).withColumn("key", T.norm(F.col("query"))).filter("key <> ''")
    return rows.groupBy("qid", "key").agg(F.min(F.struct("place", "query")).alias("f")).select("qid", F.col("f.place").cast("long").alias("place"), "f.query", "key")


def _title_words(x: Column) -> Column:
    return F.regexp_extract_all(T.fold(F.coalesce(x, F.lit(""))), F.lit(f"({T.TOKEN})"), 1)


def title_keys(corpus: DataFrame) -> DataFrame:
    """(title_key, title): the normal forms of all titles, with the first title of each."""
    keyed = corpus.select(F.array_join(F.slice(_title_words(F.col("title")), 1, TITLE_WORDS), " ").alias("title_key"), "title").filter("title_key <> ''")
    return keyed.groupBy("title_key").agg(F.min("title").alias("title"))


def mentioned(texts: DataFrame, titles: DataFrame) -> DataFrame:
    """(columns of texts but text, place, title_key, title): titles that stand anywhere in whole texts, by the word where each first does.

    Runs of words as long as some title are hash-joined with all titles; runs and titles are both shuffled by the run,
    so the dictionary has no bound."""
    lengths = sorted(r["n"] for r in titles.select(F.size(F.split("title_key", " ")).alias("n")).distinct().collect())  # TITLE_WORDS at most
    kept = [c for c in texts.columns if c != "text"]
    words = texts.select(*kept, _title_words(F.col("text")).alias("_w"))
    runs = [_runs(F.col("_w"), n, lambda i, run: F.struct(i.alias("place"), run.alias("title_key"))) for n in lengths]
    if not runs:
        return words.select(*kept, F.lit(0).alias("place"), F.lit("").alias("title_key"), F.lit("").alias("title")).limit(0)
    found = words.select(*kept, F.explode(F.concat(*runs)).alias("_r")).select(*kept, "_r.*")
    return found.join(titles, "title_key").groupBy(*kept, "title_key").agg(F.min("place").alias("place"), F.first("title").alias("title"))


def linked_titles(questions: DataFrame, corpus: DataFrame, hops: int = 2, k: int = 3) -> DataFrame:
    """(qid, hop, title_key, rank, id): searches for titles that the documents found last name, the first that finds something new.

    A title isn't followed if it is short, names a document just found, stands in the question, or was asked before."""
    titles = written(title_keys(corpus))
    asked = questions.select("qid", F.concat(F.lit(" "), F.array_join(_title_words(F.col("question")), " "), F.lit(" ")).alias("question_key"))
    visible = written(bm25_search(corpus, questions, k, boost=False).select("qid", "rank", "id"))
    seen, used, out = visible.select("qid", "id"), None, None
    for hop in range(1, hops + 1):
        shown = corpus.join(few(visible), "id").select("qid", "rank", "id", "title", "text")
        own = shown.select("qid", F.array_join(F.slice(_title_words(F.col("title")), 1, TITLE_WORDS), " ").alias("title_key")).distinct()
        found = mentioned(shown.select("qid", "rank", "text"), titles).filter(F.length(F.replace("title_key", F.lit(" "), F.lit(""))) >= LEAST_TITLE)
        found = found.join(own, ["qid", "title_key"], "left_anti").join(asked, "qid").filter(~F.contains("question_key", F.concat(F.lit(" "), "title_key", F.lit(" "))))
        if used is not None:
            found = found.join(used, ["qid", "title_key"], "left_anti")
        found = written(found.select("qid", "title_key", "title", F.struct("rank", "place", (-F.length("title_key")).alias("n"), "title_key").alias("order")))
        results = written(bm25_search(corpus, found.select(F.col("title_key").alias("qid"), F.col("title").alias("question")).distinct(), k, boost=False).select(F.col("qid").alias("title_key"), "rank", "id"))
        new = found.join(results, "title_key").join(seen, ["qid", "id"], "left_anti")
        chosen = written(new.groupBy("qid").agg(F.min("order").alias("order")).select("qid", F.col("order.title_key").alias("title_key")))
        step = written(chosen.join(results, "title_key").select("qid", F.lit(hop).cast("long").alias("hop"), "title_key", "rank", "id"))
        out = step if out is None else out.unionByName(step)
        visible, seen = step.select("qid", "rank", "id"), seen.unionByName(step.select("qid", "id"))
        used = chosen if used is None else used.unionByName(chosen)
    return out


def _seeds(corpus: DataFrame, most: int | None) -> DataFrame:
    """(id, seed_at, seed): a document's title and its sentences of at least 24 characters, the first ``most`` or all of them."""
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.!?])[ \t\n]+"), lambda s: F.trim(s, F.lit(" \t\n"))), lambda s: F.length(s) >= 24)
    return corpus.select("id", F.posexplode(F.concat(F.array(F.coalesce("title", F.lit(""))), sentences if most is None else F.slice(sentences, 1, most))).alias("seed_at", "seed"))


def oracle_paths(questions: DataFrame, corpus: DataFrame, facts: DataFrame, k: int = 3, hops: int = HOPS, sentences: int | None = SENTENCES, variants: int | None = VARIANTS, chars: int | None = QUERY_CHARS) -> DataFrame:
    """(qid, n_facts, n_closed, n_searches, queries, ids): for each question with facts (qid, title, quote) the shortest search path that shows them all.

    First queries are the question's own spans: the four best that show some facts and the shortest that shows all are
    followed.  A hop asks for the titles and sentences of what a path has seen, alone and behind the question, and
    takes the query that closes most missing facts, then the shortest, then the larger text; a path ends when no query
    closes one.  Of complete paths the one of fewest searches stays, else of the others the one with most facts, then
    the first.  Questions none of whose own queries shows a fact give a row without a path.

    ``sentences`` of a document, ``variants`` of a hop and ``chars`` of a query are all asked with None; the fixed values are
    the reference's.  A query can close a fact only if a document that shows it is among the k best, so also among the k best
    of the few documents that paths have seen or facts need, scored alike: the whole corpus is asked what passes there."""
    numbered = written(facts.select("qid", "title", "quote").distinct())
    fact = F.md5(F.concat_ws("\x00", "title", "quote"))
    support = written(corpus.join(numbered, "title").filter(F.contains("text", "quote")).select("qid", "id", fact.alias("fact")).distinct())
    total = written(numbered.groupBy("qid").agg(F.count("*").alias("n_facts")))
    asked = written(questions.join(total, "qid", "left_semi").select("qid", "question"))
    first = written(question_variants(asked))
    asking = lambda queries: written(queries.select(F.col("query").alias("qid"), F.col("query").alias("question")).distinct())
    shown = first.join(written(bm25_search(corpus, asking(first), k, boost=False).select(F.col("qid").alias("query"), "rank", "id")), "query")
    runs = shown.join(support, ["qid", "id"], "left").groupBy("qid", "query", "key").agg(F.collect_set("fact").alias("facts"), F.array_sort(F.collect_set(F.struct("rank", "id"))).alias("docs")).filter(F.size("facts") > 0)
    runs = runs.join(total, "qid").withColumn("whole", F.size("facts") == F.col("n_facts"))
    order = Window.partitionBy("qid", "whole").orderBy(F.when(F.col("whole"), 0).otherwise(-F.size("facts")), F.length("query"), "key")
    runs = runs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= F.when(F.col("whole"), FULL).otherwise(PARTIAL))
    ids = F.transform("docs", lambda d: d["id"])
    paths = written(runs.select("qid", (F.col("n") + F.when(F.col("whole"), PARTIAL).otherwise(0)).alias("path"), "n_facts", F.array("query").alias("queries"), F.array("key").alias("used"), ids.alias("ids"), "facts", F.lit(True).alias("moved")))
    for _ in range(hops):
        at = paths.filter(F.col("moved") & (F.size("facts") < F.col("n_facts")))
        if at.isEmpty():
            break
        docs = at.select("qid", "path", "used", F.posexplode("ids").alias("doc_at", "id"))
        known = written(docs.select("id").union(support.join(at.select("qid").distinct(), "qid", "left_semi").select("id")).distinct())
        copy = Window.partitionBy(F.md5(F.to_json(F.struct("title", "text")))).orderBy("id")  # of equal documents the first k alone are ever found
        near = written(corpus.join(few(known, KNOWN), "id", "left_semi").withColumn("_n", F.row_number().over(copy)).filter(F.col("_n") <= k).drop("_n"))
        seeded = docs.join(_seeds(near, sentences), "id").join(asked, "qid")
        options = seeded.select("qid", "path", "used", "question", "doc_at", "seed_at", F.posexplode(F.array("seed", F.trim(F.concat("question", F.lit(" "), "seed")))).alias("form", "text"))
        options = options.withColumn("key", T.norm(F.col("text"))).filter((F.col("key") != "") & (F.col("key") != T.norm(F.col("question"))) & ~F.array_contains("used", F.col("key")))
        query = F.col("text") if chars is None else F.substring("text", 1, chars)
        options = options.groupBy("qid", "path", "key").agg(F.min(F.struct("doc_at", "seed_at", "form", query.alias("query"))).alias("o"))
        if variants is not None:
            options = options.withColumn("n", F.row_number().over(Window.partitionBy("qid", "path").orderBy("o"))).filter(F.col("n") <= variants)
        options = written(options.select("qid", "path", "o.query"))
        if options.isEmpty():
            break
        index = Counted(corpus, written(options.select(F.explode(T.tokens(F.col("query")))).distinct()))
        missing = at.join(support, "qid").filter(~F.array_contains("facts", F.col("fact")) & ~F.array_contains("ids", F.col("id"))).select("qid", "path", "id").distinct()
        among = index.search(asking(options), k, written(index.rows.join(few(near.select("id"), KNOWN), "id", "left_semi"))).select(F.col("qid").alias("query"), "id")
        options = written(options.join(among, "query").join(missing, ["qid", "path", "id"], "left_semi").select("qid", "path", "query").distinct())
        if options.isEmpty():
            break
        found = options.join(index.search(asking(options), k).select(F.col("qid").alias("query"), "rank", "id"), "query").join(at.select("qid", "path", "ids", "facts"), ["qid", "path"]).filter(~F.array_contains("ids", F.col("id")))
        closing = found.join(support, ["qid", "id"], "left").groupBy("qid", "path", "query").agg(
            F.collect_set(F.when(~F.array_contains("facts", F.col("fact")), F.col("fact"))).alias("closed"), F.array_sort(F.collect_set(F.struct("rank", "id"))).alias("docs")
        ).filter(F.size("closed") > 0)
        best = closing.groupBy("qid", "path").agg(F.max(F.struct(F.size("closed").alias("n"), (-F.length("query")).alias("l"), "query", "closed", "docs")).alias("b"))
        joined = paths.join(best, ["qid", "path"], "left")
        grown = lambda old, new: F.when(F.col("b").isNull(), F.col(old)).otherwise(F.concat(old, new))
        paths = written(joined.select("qid", "path", "n_facts", grown("queries", F.array("b.query")).alias("queries"), grown("used", F.array(T.norm(F.col("b.query")))).alias("used"), grown("ids", F.transform("b.docs", lambda d: d["id"])).alias("ids"), grown("facts", F.col("b.closed")).alias("facts"), F.col("b").isNotNull().alias("moved")))
    best = F.struct(F.size("facts").alias("n_closed"), (-F.size("queries")).alias("n"), (-F.col("path")).alias("path"), "queries", "ids")
    best = paths.groupBy("qid").agg(F.max(best).alias("p"))
    return total.join(best, "qid", "left").select("qid", "n_facts", F.coalesce("p.n_closed", F.lit(0)).cast("long").alias("n_closed"), F.size(F.coalesce("p.queries", F.array().cast("array<string>"))).cast("long").alias("n_searches"), F.col("p.queries").alias("queries"), F.col("p.ids").alias("ids"))
