"""Queries of problems 1 and 5: pieces of oversized chunks, sentence units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .sentences import sentence_offsets, sentence_units
from .split import LIMIT, OVERLAP, split_oversized


def distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_idx, chunk_text), one row for each chunk_idx."""
    return table(spark, sf_dir, "retrieved_chunks").select("chunk_idx", "chunk_text").filter(F.col("chunk_text").isNotNull()).dropDuplicates(["chunk_idx"])


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all distinct chunks."""
    return split_oversized(distinct_chunks(spark, sf_dir), ["chunk_idx"], "chunk_text", LIMIT, OVERLAP)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of which the splitter made more than one piece, among the pieces of all chunks."""
    return p1_pieces(spark, sf_dir).filter(F.col("piece_no") == 1).select("chunk_idx")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, record_id, start_char) of every unit but the first of a record."""
    chunks = sentence_offsets(distinct_chunks(spark, sf_dir), ["chunk_idx"], "chunk_text")
    sentences = sentence_offsets(table(spark, sf_dir, "sentences"), ["sentence_id"], "text").filter(F.size("starts") > 1)

    def later(df: DataFrame, field: str, key: str) -> DataFrame:
        start = F.explode(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0)))).alias("start_char")
        return df.filter(F.size("starts") > 1).select(F.lit(field).alias("field"), F.col(key).cast("string").alias("record_id"), start)

    return later(chunks, "chunk", "chunk_idx").unionByName(later(sentences, "sentence", "sentence_id").distinct())


def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of all distinct chunks, with their text."""
    return sentence_units(distinct_chunks(spark, sf_dir), ["chunk_idx"], "chunk_text")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p5_found": p5_found, "p5_units": p5_units}
SQL = {
    "p1_found": f"SELECT DISTINCT chunk_idx FROM retrieved_chunks WHERE length(chunk_text) > {LIMIT}",
}
