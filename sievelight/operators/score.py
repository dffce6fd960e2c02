"""Five signals of a sentence and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1)))


def names(text: Column) -> Column:
    """Runs of capitalised words behind the first word."""
    return _count(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\S+", ""), r"[A-Z][a-z0-9]+(?: [A-Z][a-z0-9]+)*")


def numbers(text: Column) -> Column:
    return _count(text, "[0-9][0-9.,]*")


def capitalised(text: Column) -> Column:
    return _count(text, "[A-Z][a-z0-9]+")


def verbs(text: Column) -> Column:
    """Words in -ed or -ing, and common auxiliaries."""
    return _count(F.lower(text), r"[a-z]+ed\b|[a-z]+ing\b|\b(?:is|are|was|were|has|have|had|be)\b")


def evidence(text: Column) -> Column:
    """Twice the share of names, numbers and factual words among all words and marks, at most 1."""
    n = _count(text, r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
    total = names(text) + numbers(text) + capitalised(text) + numbers(text)
    return F.when(n > 0, F.least(total / n * 2, F.lit(1.0))).otherwise(0.0)


def density(text: Column) -> Column:
    """Names, numbers and verbs for each word, at most 1."""
    n = _count(text, "[A-Za-z0-9]+")
    return F.when(n > 0, F.least((names(text) + numbers(text) + verbs(text)) / n, F.lit(1.0))).otherwise(0.0)


def temporal(query: Column, year: Column) -> Column:
    return F.when(T.temporal_intent(query) & (F.coalesce(year, F.lit(0)) != 0), T.recency(year)).otherwise(0.0)


def weight(query_type: Column, place: int) -> Column:
    """Weight of a signal by query type; null for no type, an error for an unknown one."""
    known = F.coalesce(*[F.when(query_type == k, F.lit(w[place])) for k, w in C.WEIGHTS.items()])
    return F.when(query_type.isNull() | query_type.isin(*C.WEIGHTS), known).otherwise(F.raise_error(F.concat(F.lit("unknown query type "), query_type)).cast("double"))


def combined(query_type: Column, signals: list[Column]) -> Column:
    """The weighted sum to four places, halves up, also those that binary fractions leave just below (by 1e-11 at most)."""
    total = sum((weight(query_type, i) * s for i, s in enumerate(signals)), F.lit(0.0))
    return F.floor(total * 10_000 + 0.5000001) / 10_000


def hash_cosine(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the cosine of the hashing embeddings of left (id ...) and right (id ...); pairs without a shared bucket are left out."""
    x = left.select(F.col("id").alias("a"), "bucket", F.col("n").alias("x"), F.col("norm").alias("xn"))
    y = right.select(F.col("id").alias("b"), "bucket", F.col("n").alias("y"), F.col("norm").alias("yn"))
    met = pairs.join(x, "a").join(y, ["b", "bucket"])
    return met.groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / (F.max("xn") * F.max("yn"))).alias("cosine"))
