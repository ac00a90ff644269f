"""Queries of article parsing over all pages, put into wiki markup, beside their DuckDB statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import articles as A
from ..scratch import written
from ..session import spread, table

#: Page tags and the markup that stands for them: nested templates, links, headings with a repeated paragraph.
MARKUP = [
    ("<nav>", "{{nav|"), ("</nav>", "}}"), ("<ul>", "{{list|"), ("</ul>", "}}"), ('<div class="ad">', "\n\n{{ad|{{place|1}}|"), ("</div>", "}}"),
    ("<h1>", "\n\n== [[heading|"), ("</h1>", "]] ==\n\n"), ("<article>", "\n\n'''Article'''\n\n''Article''\n\n"), ("<p>", "\n\n"), ("<footer>", "\n\n[https://example.org/about About us] [[footer|"), ("</footer>", "]]"),
]


def _pages(spark, sf):
    body = reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), MARKUP, F.col("html"))
    return spread(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "url", F.sha2("html", 256).alias("revision"), body.alias("markup"))


def article_parse(spark, sf):
    """Every page's paragraphs: their number, characters, and the digest of the text."""
    found = A.articles(_pages(spark, sf), "page_id")
    size = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda n, p: n + F.length(p["text"]))
    return found.select("page_id", F.size("paragraphs").cast("long").alias("paragraphs"), size.alias("chars"), "text_sha256")


def _requests(spark, sf):
    """Addresses asked for by two corpora; an address is normalised to host and path, which a mobile host redirects to its main one."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("name"))
    asked = pages.select(F.lit("all").alias("corpus"), F.col("url").alias("title")).unionByName(pages.filter("page_id % 3 = 0").select(F.lit("thirds").alias("corpus"), F.concat("name", F.when(F.col("page_id") % 5 == 0, "/gone").otherwise("")).alias("title")))
    mobile = pages.filter("name LIKE 'm.%'").select(F.col("name").alias("src"), F.substr("name", F.lit(3)).alias("dst"))
    return A.resolved(asked, pages.select(F.col("url").alias("src"), F.col("name").alias("dst")).unionByName(mobile), pages.select("name", F.col("page_id").alias("article")))


def article_index(spark, sf):
    """For each corpus the titles, those that lead nowhere, articles, paragraphs, and the least and largest paragraph id."""
    found = written(A.articles(_pages(spark, sf), "page_id").select(F.col("page_id").alias("article"), "revision", "paragraphs"))
    requests = written(_requests(spark, sf))
    rows, missing = A.paragraph_index(requests, found)
    titles = requests.groupBy("corpus").agg(F.count("*").alias("titles"))
    held = rows.groupBy("corpus", "article").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).groupBy("corpus").agg(F.count("*").alias("articles"), F.sum("n").alias("paragraphs"), F.min("low").alias("first_id"), F.max("high").alias("last_id"))
    return titles.join(missing.groupBy("corpus").agg(F.count("*").alias("missing")), "corpus", "left").join(held, "corpus", "left").select("corpus", "titles", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"), "articles", "paragraphs", "first_id", "last_id")


QUERIES = {f.__name__: f for f in (article_parse, article_index)}

_MARKUP = reduce(lambda c, m: "replace({}, '{}', '{}')".format(c, *(x.replace("'", "''") for x in m)), MARKUP, "html")
_SPACE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RULES = [
    (r"(?m)^[*#:;]+[ \t]*", ""), (r"(?s)<!--.*?-->", ""), (r"(?s)<style>.*?</style>|<script>.*?</script>|<title>.*?</title>", ""),
    (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[https?://\S+ ([^\]]*)\]", r"\1"), (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", r"\1"),
    (r"</?[a-zA-Z!][^<>]*>", ""), (r"(?m)^== (.*) ==$", r"\1"), ("''+", ""), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
_TEXT = reduce(lambda c, r: "regexp_replace({}, '{}', '{}', 'g')".format(c, *(x.replace("'", "''") for x in r)), _RULES, "markup")
_PARSED = f"""pm AS (SELECT page_id, url, sha256(html) AS revision, {_MARKUP} AS markup FROM pages),
pt AS (SELECT page_id, revision, list_filter(list_transform(regexp_split_to_array({_TEXT}, '\\n{_SPACE}*\\n+'), lambda x: trim(regexp_replace(x, '{_SPACE}+', ' ', 'g'))), lambda x: x <> '') AS l FROM pm),
pp AS (SELECT page_id, revision, coalesce(list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x), []) AS p FROM pt)"""

ORACLES = {
    "article_parse": f"WITH {_PARSED} SELECT page_id, len(p) AS paragraphs, coalesce(CAST(list_sum(list_transform(p, lambda x: length(x))) AS BIGINT), 0) AS chars, sha256(array_to_string(p, chr(10) || chr(10))) AS text_sha256 FROM pp",
    "article_index": f"""WITH {_PARSED}, n AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS name FROM pages), f AS (SELECT name, min(page_id) AS article FROM n GROUP BY name),
q AS (SELECT DISTINCT 'all' AS corpus, url AS title, name AS own FROM n UNION SELECT 'thirds', name || CASE WHEN page_id % 5 = 0 THEN '/gone' ELSE '' END, name || CASE WHEN page_id % 5 = 0 THEN '/gone' ELSE '' END FROM n WHERE page_id % 3 = 0),
t AS (SELECT *, CASE WHEN own LIKE 'm.%' AND own IN (SELECT name FROM n) THEN substr(own, 3) ELSE own END AS target FROM q),
r AS (SELECT corpus, title, coalesce(a.article, b.article) AS article FROM t LEFT JOIN f a ON a.name = target LEFT JOIN f b ON b.name = title),
x AS (SELECT corpus, article, revision, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT DISTINCT corpus, article FROM r WHERE article IS NOT NULL) JOIN pp ON page_id = article),
h AS (SELECT corpus, count(DISTINCT article) AS articles, count(*) AS paragraphs, min(id) AS first_id, max(id) AS last_id FROM (SELECT *, substr(sha256(corpus || chr(0) || article || chr(0) || revision || chr(0) || (i - 1) || chr(0) || p[i]), 1, 24) AS id FROM x) GROUP BY corpus),
m AS (SELECT corpus, count(*) AS titles, count(*) FILTER (WHERE coalesce(len(p), 0) = 0) AS missing FROM r LEFT JOIN pp ON page_id = article GROUP BY corpus)
SELECT corpus, titles, missing, articles, paragraphs, first_id, last_id FROM m LEFT JOIN h USING (corpus)""",
}
