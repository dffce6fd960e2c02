"""Queries that run a stream to its end and read what it committed, and one over shards some of which are damaged."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..runtime import checkpoint_dir, table
from ..sources import tables
from ..streaming import events
from ..streaming import ingest as streaming
from .corpus_queries import _DOCS
from .corpus_queries import SQL as CORPUS_SQL


def _ingested(spark, sf):
    """The folder of a stream over the document table, run to its end; one file gives the result of a single batch."""
    path = f"{sf}/documents.parquet"
    out = os.path.join(checkpoint_dir(spark), f"ingest-{uuid.uuid4().hex}")
    streaming.ingest_stream(spark, path, spark.read.parquet(path).schema, out).awaitTermination()
    return out


def stream_ingest(spark, sf):
    """The document table as a stream of its files, committed batch by batch."""
    return streaming.documents(spark, _ingested(spark, sf)).select("doc_id", "document_id")


def stream_manifest(spark, sf):
    """What the stream committed, by batch."""
    return streaming.manifest(spark, _ingested(spark, sf))


def stream_progress(spark, sf):
    """How far the stream has read each dataset."""
    return streaming.progress(spark, _ingested(spark, sf))


def event_windows(spark, sf):
    """Events by hour and type: the stream of the event table, run to its end, and what it wrote."""
    path, name = f"{sf}/events.parquet", f"events_{uuid.uuid4().hex}"
    out = os.path.join(checkpoint_dir(spark), name)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts = events.windowed_counts(rows)
    writer = counts.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(os.path.join(out, "counts")))
    writer.option("checkpointLocation", os.path.join(out, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(os.path.join(out, "counts"))


def shard_rows(spark, sf):
    """The chunk table as shards, beside one that is no table: good rows, rejects and unreadable shards are counted."""
    folder = os.path.join(checkpoint_dir(spark), f"shards-{uuid.uuid4().hex}")
    rows = table(spark, sf, "retrieved_chunks").select("chunk_idx", "chunk_text")
    rows.repartition(4).write.parquet(folder)
    tables.write_bytes(spark, os.path.join(folder, "part-damaged.snappy.parquet"), b"no table")
    good, rejected, unreadable = tables.load_shards(spark, folder, rows.schema, "chunk_text", pattern="part-*")
    counts = good.agg(F.count("*").alias("n_rows"), F.count_if(F.length("chunk_text") > C.CHUNK_SIZE).alias("n_long"))
    return counts.crossJoin(rejected.agg(F.sum("n_rejected").alias("n_rejected"))).crossJoin(unreadable.agg(F.count("*").alias("n_unreadable")))


QUERIES = {f.__name__: f for f in [stream_ingest, stream_manifest, stream_progress, event_windows, shard_rows]}
_WINDOWS = f"SELECT count(*) AS n FROM (SELECT trim(substr(text, k * 700 + 1, {C.CHUNK_SIZE}), ' ') AS chunk FROM (SELECT text, unnest(range(0, CAST(ceil(length(text) / 700.0) AS BIGINT))) AS k FROM docs)) WHERE length(chunk) > 0"
SQL = {
    "stream_ingest": CORPUS_SQL["doc_prefix_dedup"],
    "stream_manifest": f"WITH {_DOCS} SELECT 0 AS batch_idx, 0::BIGINT AS vec_start, n AS vec_end, (SELECT count(*) FROM docs) AS n_documents FROM ({_WINDOWS})",
    "stream_progress": "SELECT dataset, max(row_idx) + 1 AS row_end FROM documents GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "shard_rows": f"SELECT count(*) FILTER (WHERE chunk_text IS NOT NULL) AS n_rows, count(*) FILTER (WHERE length(chunk_text) > {C.CHUNK_SIZE}) AS n_long, count(*) FILTER (WHERE chunk_text IS NULL) AS n_rejected, 1::BIGINT AS n_unreadable FROM retrieved_chunks",
}
