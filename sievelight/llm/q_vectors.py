"""Queries of problem 4: most similar sentence embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .knn import nearest, nearest_of

DIM, K, LEAST = 384, 5, 0.8


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of at least 0.8 of which one is among the 5 most similar of the other."""
    near = nearest(table(spark, sf_dir, "sentences"), "sentence_id", "embedding", DIM, K, LEAST)
    a, b = F.least("id", "other"), F.greatest("id", "other")
    return near.select(a.alias("sentence_id_a"), b.alias("sentence_id_b")).distinct()


def p4_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar of every 50th sentence (by the hash of its id), among all sentences."""
    asked = F.pmod(F.xxhash64("sentence_id"), F.lit(50)) == 0
    near = nearest_of(table(spark, sf_dir, "sentences"), asked, "sentence_id", "embedding", DIM, K)
    return near.select(F.col("id").alias("sentence_id"), F.col("other").alias("similar_id"), F.round("cosine", 6).alias("cosine"), "place")


QUERIES = {"p4_found": p4_found, "p4_top5": p4_top5}
SQL: dict[str, str] = {}
