"""Text normalisation and scoring as Column expressions; two F1 families with different edge cases stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the BM25 tokenizer drops.
STOPWORDS = "a an the of and or to in on for with from by is was were are what which who where when did does do this that it its also called".split()
#: Tokens of the BM25 tokenizer (single CJK characters, or runs of ASCII letters and digits).
TOKEN = r"[㐀-䶿一-鿿豈-﫿]|[a-z0-9]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")


def fold(x: Column) -> Column:
    """Lower case with the one folding that lower() lacks in the test languages."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def norm(x: Column) -> Column:
    """Trimmed, lower case, white space collapsed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[ \t\n\r\f\x0B]+", " "))


query_key = norm


def tokens(x: Column) -> Column:
    """BM25 tokens in order: no stopwords, no single ASCII characters."""
    found = F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit(f"({TOKEN})"), 1)
    return F.filter(found, lambda t: ~t.isin(STOPWORDS) & ((F.length(t) >= 2) | (F.octet_length(t) > 1)))


def token_norm(x: Column) -> Column:
    return F.array_join(tokens(x), " ")


def terms(x: Column) -> Column:
    """Distinct keyword terms: no stopword list, no length filter."""
    return F.array_distinct(F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit(f"({TOKEN})"), 1))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a substring; none of an empty one."""
    return F.when(F.length(term) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long"))


def _words(x: Column) -> Column:
    return F.filter(F.split(x, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def _without_punctuation(x: Column) -> Column:
    return F.translate(x, PUNCTUATION, "")


def _without_articles_first(x: Column) -> Column:
    """Articles that stand between word boundaries, punctuation still in place."""
    return F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " ")


def answer_words(x: Column) -> Column:
    """House order: articles, then punctuation, then white space; the words of the normalised answer."""
    return _words(_without_punctuation(_without_articles_first(F.lower(F.coalesce(x, F.lit(""))))))


def official_words(x: Column) -> Column:
    """Official order: punctuation before articles."""
    return F.filter(_words(_without_punctuation(F.lower(F.coalesce(x, F.lit(""))))), lambda w: ~w.isin(*ARTICLES))


def normalize_answer(x: Column) -> Column:
    return F.array_join(answer_words(x), " ")


def official_answer(x: Column) -> Column:
    return F.array_join(official_words(x), " ")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda arr, w: F.size(F.filter(arr, lambda y: y == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))


def _f1(common: Column, a: Column, b: Column) -> Column:
    p, r = common / F.size(a), common / F.size(b)
    return 2 * p * r / (p + r)


def token_f1(a: Column, b: Column) -> Column:
    """House F1 of word arrays: two empty ones 1, one empty 0."""
    c = overlap(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).when(c == 0, 0.0).otherwise(_f1(c, a, b))


def reward_f1(a: Column, b: Column) -> Column:
    """House F1, but a gold yes or no has to be met exactly."""
    said, gold = F.array_join(a, " "), F.array_join(b, " ")
    return F.when(gold.isin("yes", "no"), (said == gold).cast("double")).otherwise(token_f1(a, b))


def official_f1(a: Column, b: Column) -> Column:
    """Official F1: mismatched yes, no, noanswer 0; nothing in common 0, two empty ones too."""
    said, gold = F.array_join(a, " "), F.array_join(b, " ")
    special = said.isin("yes", "no", "noanswer") | gold.isin("yes", "no", "noanswer")
    c = overlap(a, b)
    return F.when((said != gold) & special, 0.0).when(c == 0, 0.0).otherwise(_f1(c, a, b))


def hash_mod(x: Column, n: int) -> Column:
    """sha256(x) as a 256-bit integer modulo n, digit by digit."""
    value = lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1
    return F.aggregate(F.split(F.sha2(x, 256), ""), F.lit(0), lambda a, d: F.when(d == "", a).otherwise((a * 16 + value(d)) % n))


def md5_mod(x: Column, n: Column | int) -> Column:
    """The first 32 bits of md5(x) modulo n: the draw that both engines can repeat."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % n
