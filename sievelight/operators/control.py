"""Batch control: ranges, manifest, integrity, recovery and lookups by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ingest import dense_ids


def batch_ranges(lengths: DataFrame, size: int) -> DataFrame:
    """(dataset, batch_idx, row_start, row_end): half-open ranges of at most `size` rows, the last one clamped; none for an empty dataset."""
    n = F.col("n_rows")
    k = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / size).cast("bigint") - 1))
    rows = lengths.select("dataset", n.alias("n"), F.explode(k).alias("batch_idx"))
    return rows.select("dataset", "batch_idx", (F.col("batch_idx") * size).alias("row_start"), F.least((F.col("batch_idx") + 1) * size, F.col("n")).alias("row_end"))


def exhausted(ranges: DataFrame) -> DataFrame:
    """One row: whether no range holds a row."""
    return ranges.agg(F.coalesce(F.bool_and(F.col("row_end") <= F.col("row_start")), F.lit(True)).alias("exhausted"))


def in_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds pos (0, 1, ... by key) and batch_idx."""
    return dense_ids(df, [key], "pos").withColumn("batch_idx", F.floor(F.col("pos") / size).cast("int"))


def manifest(rows: DataFrame) -> DataFrame:
    """(batch_idx, vec_start, vec_end), half-open."""
    return rows.groupBy("batch_idx").agg(F.min("pos").alias("vec_start"), (F.max("pos") + 1).alias("vec_end"))


def violations(man: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Batches out of number, empty, or not beginning where the one before ends; the last one if it does not end at `n` of total.

    The manifest has one row for each batch, total is one row.
    """
    w = W.orderBy("batch_idx")
    rows = man.withColumn("seq", F.row_number().over(w) - 1).withColumn("prev", F.coalesce(F.lag("vec_end").over(w), F.lit(0)))
    problem = F.when(F.col("batch_idx") != F.col("seq"), "batch number").when(F.col("vec_end") <= F.col("vec_start"), "empty").when(F.col("vec_start") != F.col("prev"), "gap")
    rows = rows.withColumn("last", F.lead("batch_idx").over(w).isNull())
    if total is not None:
        rows = rows.crossJoin(F.broadcast(total.select(F.col("n").alias("total"))))
        problem = F.coalesce(problem, F.when(F.col("last") & (F.col("vec_end") != F.col("total")), "total"))
    return rows.withColumn("problem", problem).filter("problem IS NOT NULL")


def integrity(rows: DataFrame, man: DataFrame, pairs: DataFrame) -> DataFrame:
    """(batch_idx, expected, found, n_pairs, sound): rows by the manifest and in the shards, question pairs of the batch; sound where both sides agree and pairs are there."""
    found = rows.groupBy("batch_idx").agg(F.count("*").alias("n"))
    held = pairs.groupBy("batch_idx").agg(F.count("*").alias("n_pairs"))
    both = man.join(found, "batch_idx", "full_outer").join(held, "batch_idx", "left")
    out = both.select("batch_idx", F.coalesce(F.col("vec_end") - F.col("vec_start"), F.lit(0)).alias("expected"), F.coalesce("n", F.lit(0)).alias("found"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))
    return out.withColumn("sound", (F.col("expected") == F.col("found")) & (F.col("n_pairs") > 0))


def truncate_orphans(rows: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows before the end of the last committed batch, which is one value; fewer rows than were committed are an error at run time."""
    end = committed.agg(F.coalesce(F.max("vec_end"), F.lit(0)).alias("end")).crossJoin(rows.agg(F.count("*").alias("have")))
    lost = F.raise_error(F.concat(F.lit("rows are missing: committed "), F.col("end").cast("string"), F.lit(", found "), F.col("have").cast("string")))
    end = end.select(F.when(F.col("have") < F.col("end"), lost.cast("bigint")).otherwise(F.col("end")).alias("end"))
    return rows.crossJoin(F.broadcast(end)).filter(F.col("pos") < F.col("end")).drop("end")


def shard_of(rows: DataFrame, man: DataFrame, block: int = 128) -> DataFrame:
    """(vec_id, shard): the batch whose range holds a position.

    A range join by blocks: each range is dealt to the blocks it touches, so that positions meet it by an equi-join of any size.
    """
    ranges = man.select(F.col("batch_idx").alias("shard"), "vec_start", "vec_end", F.explode(F.sequence(F.floor(F.col("vec_start") / block), F.floor((F.col("vec_end") - 1) / block))).alias("blk"))
    keyed = rows.withColumn("blk", F.floor(F.col("pos") / block))
    return keyed.join(ranges, "blk").filter((F.col("pos") >= F.col("vec_start")) & (F.col("pos") < F.col("vec_end"))).select("vec_id", "shard")
