"""Registered queries pN_... of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this subpackage with QUERIES and, where SQL can express a query, SQL.
MODULES = ["q_units", "q_duplicates", "q_ranking", "q_vectors", "q_tokens", "q_leakage", "q_pii"]


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{module}"), name, {})
    return found


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
