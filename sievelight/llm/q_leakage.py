"""Queries of problem 7: evaluation items inside training documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .leakage import WINDOW, leaks


def found(spark: SparkSession, sf_dir: str, **asked) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), **asked)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): at least 13 consecutive words of the passage, or the whole question."""
    return found(spark, sf_dir, window=WINDOW, exact=True).select("doc_id", "item_id")


def p7_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every aligned document and item, edited copies included, with the scores of the alignment."""
    return found(spark, sf_dir, least=0.5)


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each leaked item."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))


QUERIES = {"p7_found": p7_found, "p7_alignments": p7_alignments, "p7_items": p7_items}
SQL: dict[str, str] = {}
