"""Queries of problem 2: slightly changed chunks and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .neardup import NearDuplicates


def near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    chunks = table(spark, sf_dir, "retrieved_chunks").select(F.lit("chunk").alias("field"), F.col("chunk_idx").cast("string").alias("id"), F.col("chunk_text").alias("text"))
    sentences = table(spark, sf_dir, "sentences").select(F.lit("sentence").alias("field"), F.col("sentence_id").alias("id"), "text")
    return NearDuplicates(chunks.unionByName(sentences))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, id_a, id_b): pairs of records with a similarity of at least 0.7."""
    return near(spark, sf_dir).record_pairs().select("field", "id_a", "id_b")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its class of equal texts, the size of the class and the number of classes linked to it."""
    return near(spark, sf_dir).record_classes()


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked pairs of classes with their similarity."""
    return near(spark, sf_dir).links.select("field", F.hex("cls_a").alias("cls_a"), F.hex("cls_b").alias("cls_b"), F.round("similarity", 9).alias("similarity"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_links": p2_links}
SQL: dict[str, str] = {}
