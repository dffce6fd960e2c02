"""Checks of what goes into the selection steps: columns and types of a table at once, and rows with faults as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C

QUERY_COLUMNS = {"query": "string", "query_type": "string", "entities": "array<string>", "keywords": "array<string>"}
SENTENCE_COLUMNS = {"sentence_id": "string", "text": "string", "doc_id": "string", "position": "int"}


def require(df: DataFrame, columns: dict[str, str], what: str) -> DataFrame:
    """ValueError names every missing column, TypeError every column of another type."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    missing = [c for c in columns if c not in kinds]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    wrong = [f"{c} is {kinds[c]}, not {k}" for c, k in columns.items() if kinds[c] != k]
    if wrong:
        raise TypeError(f"{what}: {'; '.join(wrong)}")
    return df


def _faults(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, problem): a row for each fault."""
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())
    return df.select(F.col(key).alias("key"), F.explode(found).alias("problem"))


def query_faults(queries: DataFrame) -> DataFrame:
    """Questions that a step would not take as they are: without text, type or lists, or of an unknown type."""
    require(queries, QUERY_COLUMNS, "the table of questions")
    blank = F.col("query").isNull() | (F.trim("query") == "")
    return _faults(queries, "query_id", [
        ("no question", blank), ("no type", F.col("query_type").isNull()), ("unknown type", ~F.col("query_type").isin(*C.TOKEN_BUDGET)),
        ("no entities", F.col("entities").isNull()), ("no keywords", F.col("keywords").isNull()),
    ])


def sentence_faults(sentences: DataFrame, dim: int) -> DataFrame:
    """Sentences without text, document or position, with a count of tokens below one, or with an unusable embedding."""
    require(sentences, SENTENCE_COLUMNS, "the table of sentences")
    v = F.col("embedding")
    unusable = (F.size(v) != dim) | F.exists(v, lambda x: F.isnan(x)) | ~F.exists(v, lambda x: x != 0)
    return _faults(sentences, "sentence_id", [
        ("no text", F.col("text").isNull() | (F.trim("text") == "")), ("no document", F.col("doc_id").isNull()), ("no position", F.col("position").isNull()),
        ("no tokens", F.col("token_count") < 1), ("unusable embedding", v.isNotNull() & unusable),
    ])
