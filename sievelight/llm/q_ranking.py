"""Queries of problem 3: one ranking of the chunks of each query from three scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .rankwalk import leaders, rank_walk, ranking

SCORES = ["bm25_score", "faiss_score", "rrf_score"]


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "retrieved_chunks").select("query_id", "chunk_idx", *SCORES)
    return rank_walk(chunks, "query_id", "chunk_idx", SCORES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that lead two of the three rankings and are at most second in the third: candidates by their mass in the walk, settled by their ranks."""
    return leaders(walked(spark, sf_dir), SCORES).select("query_id", "chunk_idx")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every query with its stationarity and place."""
    out = ranking(walked(spark, sf_dir), "query_id", "chunk_idx")
    return out.select("query_id", "chunk_idx", F.round("stationarity", 9).alias("stationarity"), "place")


QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}
SQL = {
    "p3_found": """
WITH one AS (
  SELECT query_id, chunk_idx, max(CASE WHEN NOT isnan(bm25_score) THEN bm25_score END) AS b,
         max(CASE WHEN NOT isnan(faiss_score) THEN faiss_score END) AS f, max(CASE WHEN NOT isnan(rrf_score) THEN rrf_score END) AS r
  FROM retrieved_chunks GROUP BY query_id, chunk_idx),
ranked AS (
  SELECT query_id, chunk_idx, rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) AS rb,
         rank() OVER (PARTITION BY query_id ORDER BY f DESC NULLS LAST) AS rf, rank() OVER (PARTITION BY query_id ORDER BY r DESC NULLS LAST) AS rr
  FROM one)
SELECT query_id, chunk_idx FROM ranked
WHERE CAST(rb = 1 AS INT) + CAST(rf = 1 AS INT) + CAST(rr = 1 AS INT) >= 2 AND greatest(rb, rf, rr) <= 2
""",
}
