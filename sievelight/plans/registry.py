"""Registered queries of the core engine and the SQL they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["corpus_queries", "retrieval_queries", "stream_queries"]


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return found


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to evidence on the tables of a directory."""
    return queries()["full_pipeline"](spark, sf_dir)
