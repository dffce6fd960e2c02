"""Queries of problem 8: personal information in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .pii import redacted, spans


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, start_char) of every value found."""
    found = spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))
    one = F.explode(F.arrays_zip("kinds", "starts")).alias("v")
    return found.select("doc_id", one).select("doc_id", F.col("v.kinds").alias("kind"), F.col("v.starts").alias("start_char"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders in place of what was found."""
    return redacted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
SQL: dict[str, str] = {}
