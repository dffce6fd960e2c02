"""Scalar text functions as Spark column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

BLANK = r"[ \t\n\r\f\x0B]"
TOKEN = r"[\p{L}\p{N}]+|[^ \t\n\r\f\x0B\p{L}\p{N}]"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 without stopwords; null gives no token."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = _words(C.STOPWORDS)
    return F.filter(runs, lambda x: ~F.array_contains(stop, x))


def blank_tokens(text: Column) -> Column:
    """Lower-cased words between white space; null and blank texts give none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK + "+"), lambda x: x != "")


def clean(text: Column) -> Column:
    """White-space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def is_fragment(cleaned: Column) -> Column:
    return (F.length(cleaned) == 0) | F.substring(cleaned, 1, 1).rlike(C.FRAGMENT_START)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda x: x != ""))


def token_count(text: Column) -> Column:
    """Runs of letters and digits, and every other mark: the stand-in for a model's sub-word tokens."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1)))


def singular(token: Column) -> Column:
    """Light plural stripping; the first rule that fits."""
    n = F.length(token)
    es = (n > 4) & token.rlike("(s|x|z|ch|sh)es$")
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(token.substr(F.lit(1), n - 3), F.lit("y")))
        .when(es, token.substr(F.lit(1), n - 2))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), token.substr(F.lit(1), n - 1))
        .otherwise(token)
    )


def term_tokens(text: Column) -> Column:
    """Set of normalised tokens."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(runs, singular))


def covers(sentence_tokens: Column, term: Column) -> Column:
    """Whether all tokens of a term stand in a sentence; a term without tokens never does."""
    return (F.size(term) > 0) & (F.size(F.array_except(term, sentence_tokens)) == 0)


def evidential(text: Column, category: str) -> Column:
    return text.rlike("(?i)" + C.EVIDENTIALITY[category])


def evidentiality(text: Column) -> Column:
    """Share of the categories of evidential phrases that occur."""
    return sum((evidential(text, k).cast("int") for k in C.EVIDENTIALITY), F.lit(0)) / F.lit(float(len(C.EVIDENTIALITY)))


def temporal_intent(query: Column) -> Column:
    return F.lower(query).rlike(C.TEMPORAL_INTENT)


def recency(year: Column, current: int = C.CURRENT_YEAR) -> Column:
    age = F.lit(current) - year
    return F.when(age < 0, 0.0).when(age <= 2, 1.0).when(age <= 5, 0.9).when(age <= 10, 0.7).when(age <= 20, 0.5).otherwise(0.3)


def lemma(token: Column) -> Column:
    """Plural stripping, then -ed and -ing of words of at least five letters."""
    t = singular(token)
    n = F.length(t)
    return F.when((n > 5) & t.endswith("ing"), t.substr(F.lit(1), n - 3)).when((n > 4) & t.endswith("ed"), t.substr(F.lit(1), n - 2)).otherwise(t)


def hash_bucket(token: Column, dim: int = C.HASH_DIM) -> Column:
    """Bucket of the hashing embedder: the first eight hex digits of the MD5, modulo the dimension."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def doc_id(dataset: Column, row: Column, text: Column) -> Column:
    """dataset, row number filled up to 7 digits (longer ones stay whole) and 8 hex digits of the MD5 of the beginning."""
    number = row.cast("string")
    filled = F.when(F.length(number) >= 7, number).otherwise(F.lpad(number, 7, "0"))
    return F.concat_ws("_", dataset, filled, F.substring(F.md5(F.substring(text, 1, C.ID_PREFIX)), 1, 8))
