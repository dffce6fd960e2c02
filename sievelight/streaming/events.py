"""Event-time counts over a stream of question traffic, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n): works alike on a batch and on a stream."""
    ts = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark(time, late)
    return ts.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")
