"""Queries of problem 6: encoding with a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import bpe


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document, null and empty texts included."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, ids and longest document in ids by language, for sizing a training run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower(F.coalesce("lang", F.lit("none"))).alias("lang"))
    ids = bpe.encode_corpus(docs, "lang")
    n = F.size("ids")
    return ids.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).cast("bigint").alias("n_ids"), F.max(n).cast("bigint").alias("longest"))


QUERIES = {"p6_ids": p6_ids, "p6_lengths": p6_lengths}
SQL: dict[str, str] = {}
