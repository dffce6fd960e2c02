"""Reciprocal-rank fusion of sparse and dense rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C


def depth(query_type: Column, place: int) -> Column:
    """Ranking depth by query type (0 sparse, 1 dense, 2 final); unknown types count as factoid."""
    out = F.lit(C.DEPTHS["factoid"][place])
    for kind, depths in C.DEPTHS.items():
        out = F.when(query_type == kind, depths[place]).otherwise(out)
    return out


def fuse(sparse: DataFrame, dense: DataFrame, types: DataFrame) -> DataFrame:
    """sparse and dense are (query_id, id, score, rank); gives (query_id, id, rrf_score, rrf_rank, bm25_score, faiss_score).

    Ties keep the sparse hits by rank before hits found by the dense side only.
    """
    s = sparse.select("query_id", "id", F.col("score").alias("bm25_score"), F.col("rank").alias("sr"))
    d = dense.select("query_id", "id", F.col("score").alias("faiss_score"), F.col("rank").alias("dr"))
    both = s.join(d, ["query_id", "id"], "full_outer").join(types.select("query_id", "query_type"), "query_id")
    both = both.withColumn("sr", F.when(F.col("sr") <= depth(F.col("query_type"), 0), F.col("sr"))).withColumn("dr", F.when(F.col("dr") <= depth(F.col("query_type"), 1), F.col("dr")))
    both = both.filter("sr IS NOT NULL OR dr IS NOT NULL")
    part = lambda r: F.coalesce(1.0 / (C.RRF_K + F.col(r)), F.lit(0.0))
    scored = both.withColumn("rrf_score", part("sr") + part("dr"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("sr").asc_nulls_last(), F.col("dr").asc_nulls_last(), "id"))
    ranked = scored.withColumn("rrf_rank", place).filter(F.col("rrf_rank") <= depth(F.col("query_type"), 2))
    zero = lambda c, r: F.when(F.col(r).isNotNull(), F.col(c)).otherwise(0.0).alias(c)
    return ranked.select("query_id", "id", "rrf_score", "rrf_rank", zero("bm25_score", "sr"), zero("faiss_score", "dr"))
