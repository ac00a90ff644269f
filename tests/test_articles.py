"""Article parsing: rules by example, places in the source, long and torn markup, corpora of requested titles."""

import random
import time

from lodestone.operators import articles as A


def plain(markup):
    return [t for _, _, t in A.article_paragraphs(markup)]


def test_rules():
    assert plain("a {{x|{{y|[[z]]}}}} b") == ["a b"]
    assert plain("[[Target]] and [[Target|shown ''text'']] and [[File:x.png|thumb|a [[b|c]]]]") == ["Target and shown text and thumb|a c"]
    assert plain("[https://x.y/z label here] and [https://x.y/z]") == ["label here and"]
    assert plain("== Head ==\nbody<ref name=a/> &amp; more<!-- gone\n\n -->!") == ["Head body & more!"]
    assert plain("* one\n\n# two\n\n----\n\nx = y") == ["one", "two", "x = y"]
    assert plain("a<style>p{margin:0}</style>b<script/>c<script>d") == ["abcd"]
    assert plain("p\n \t\n\n  p  \n\nq\n\np") == ["p", "q", "p"]


def test_marks_that_are_never_closed_are_text():
    assert plain("a {{ b [[c|d]] e") == ["a {{ b d e"]
    assert plain("a }} b ]] c") == ["a }} b ]] c"]
    assert plain("{{a [[b}} c]]") == ["c]]"]
    assert plain("x <!-- never closed") == ["x"]
    assert plain("") == plain("\n\n \n") == []


def test_places_read_back():
    draw = random.Random(3)
    pieces = ["{{t|u}}", "[[a|b c]]", "word ", "&amp;", "''", "\n\n", "\n", " ", "<b>", "== H ==\n", "[https://e.x l]", "{{", "]]"]
    for _ in range(500):
        markup = "".join(draw.choices(pieces, k=draw.randint(0, 30)))
        found = A.article_paragraphs(markup)
        assert all(0 <= a < b <= len(markup) for a, b, _ in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        for a, b, text in found:
            first = next(iter(A.MARK.finditer(markup[a:b])), None)
            assert markup[a] == text[0] or first and first.start() == 0


def test_long_markup_is_linear():
    begun = time.monotonic()
    for markup in ("{{" * 300_000, "[[a|" * 200_000, "{{a}}" * 200_000, "[[x|y]] " * 100_000, "<style>" * 100_000, "=" * 500_000, "&amp;" * 200_000, "<!-- " * 200_000, ("{{" * 1000 + "]]" * 1000) * 50):
        A.article_paragraphs(markup)
    assert time.monotonic() - begun < 20


def test_articles_keep_other_columns_and_take_nulls(spark):
    pages = spark.createDataFrame([(1, "a\n\na\n\nb", "x"), (2, None, None), (3, "", "y")], "id int, markup string, text string")
    rows = {r["id"]: r for r in A.articles(pages).collect()}
    assert [p["text"] for p in rows[1]["paragraphs"]] == ["a", "b"] and rows[1]["text"] == "x"
    assert rows[2]["paragraphs"] == rows[3]["paragraphs"] == []
    assert A.articles(pages.limit(0)).count() == 0


def test_requested_titles(spark):
    named = spark.createDataFrame([("A", 1), ("A", 5), ("B", 2), ("Empty", 3)], "name string, article int")
    redirects = spark.createDataFrame([("a", "A"), ("b", "b2"), ("b2", "B"), ("B", "nowhere"), ("l", "m"), ("m", "l"), ("A", "A")], "src string, dst string")
    requests = spark.createDataFrame([("c", "a"), ("c", "A"), ("c", "b"), ("c", "B"), ("c", "l"), ("c", "Empty"), ("d", "A")], "corpus string, title string")
    got = A.resolved(requests, redirects, named)
    assert {(r.corpus, r.title): r.article for r in got.collect()} == {("c", "a"): 1, ("c", "A"): 1, ("c", "b"): None, ("c", "B"): 2, ("c", "l"): None, ("c", "Empty"): 3, ("d", "A"): 1}
    pages = spark.createDataFrame([(1, 7, "p\n\nq\n\np"), (2, 8, "r"), (3, 9, "{{x}}")], "article int, revision int, markup string")
    rows, missing = A.paragraph_index(got, A.articles(pages, "article"))
    rows = rows.collect()
    assert sorted((r.corpus, r.title, r.paragraph_index, r.text) for r in rows) == [("c", "A", 0, "p"), ("c", "A", 1, "q"), ("c", "A", 2, "p"), ("c", "B", 0, "r"), ("d", "A", 0, "p"), ("d", "A", 1, "q"), ("d", "A", 2, "p")]
    assert len({r.id for r in rows}) == len(rows)
    assert sorted((r.corpus, r.title) for r in missing.collect()) == [("c", "Empty"), ("c", "b"), ("c", "l")]
