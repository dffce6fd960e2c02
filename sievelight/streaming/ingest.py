"""Incremental ingestion as a stream of files: each micro-batch is one commit of new documents, their chunks and vectors.

A commit goes in order: documents with their hashes, chunks, vectors, a check that all three agree, the manifest, progress.
Every table is written as a partition of its batch, so that a commit that is tried again replaces what it wrote before; a
batch that the manifest lacks counts as not committed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, ingest
from ..runtime import exists
from ..sources.tables import is_folder, read_or_empty, write_batch

DOCUMENTS = "doc_id bigint, document_id string, dataset string, row_idx bigint, title string, text string, hash string"
CHUNKS = "document_id string, char_start int, chunk string"


VECTORS = "document_id string, char_start int, vec array<float>"
MANIFEST = "vec_start bigint, vec_end bigint, n_documents bigint, batch_idx int"
PROGRESS = "dataset string, row_end bigint, batch_idx int"


class AlignmentError(RuntimeError):
    """Documents, chunks and vectors of a batch do not agree."""


def verify(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[int, int]:
    """(documents, chunks) of a batch, or AlignmentError: a vector for each chunk, and each chunk of a document of the batch."""
    n_documents, n_chunks, n_vectors = documents.count(), chunks.count(), vectors.count()
    if n_chunks != n_vectors:
        raise AlignmentError(f"{n_chunks} chunks, but {n_vectors} vectors")
    if strays := chunks.join(documents, "document_id", "left_anti").count():
        raise AlignmentError(f"{strays} chunks belong to no document of the batch")
    return n_documents, n_chunks


def commit(batch: DataFrame, batch_idx: int, out: str) -> None:
    """New documents of a batch, their chunks and vectors, under the number of the batch; nothing for a batch without new ones.

    Hashes are part of the document table, so a crash leaves no document marked as seen that was not written. A batch that
    is tried again sees only the hashes of the batches before it.
    """
    spark = batch.sparkSession
    at = lambda name: os.path.join(out, name)
    part = lambda name, schema: read_or_empty(spark, at(name), schema + ", batch_idx int").filter(F.col("batch_idx") == batch_idx)
    seen = read_or_empty(spark, at("documents"), DOCUMENTS + ", batch_idx int").filter(F.col("batch_idx") < batch_idx)
    new = ingest.new_documents(batch, seen).select("doc_id", "document_id", "dataset", "row_idx", "title", "text", "hash")
    write_batch(new, at("documents"), batch_idx)
    documents_ = part("documents", DOCUMENTS)
    if not exists(documents_):  # an empty batch is never committed
        return
    write_batch(ingest.chunk_windows(documents_, ["document_id"]), at("chunks"), batch_idx)
    chunks = part("chunks", CHUNKS)
    keyed = chunks.select("document_id", "char_start", F.struct("document_id", "char_start").alias("key"), "chunk")
    made = dense.dense_vectors(keyed.withColumn("key", F.to_json("key")), "key", "chunk", every=True)
    key = F.from_json("id", "document_id string, char_start int")
    write_batch(made.select(key.alias("k"), "vec").select("k.document_id", "k.char_start", "vec"), at("vectors"), batch_idx)
    n_documents, n_chunks = verify(documents_, chunks, part("vectors", VECTORS))
    man = read_or_empty(spark, at("manifest"), MANIFEST).filter(F.col("batch_idx") < batch_idx)
    start = man.agg(F.coalesce(F.max("vec_end"), F.lit(0)).alias("end")).first().end
    write_batch(spark.createDataFrame([(start, start + n_chunks, n_documents)], MANIFEST.rpartition(",")[0]), at("manifest"), batch_idx)
    done = batch.groupBy("dataset").agg((F.max("row_idx") + 1).alias("row_end"))
    write_batch(done, at("progress"), batch_idx)


def ingest_stream(spark: SparkSession, source: str, schema: str, out: str, files_per_batch: int = 1):
    """Starts the stream over what lies in `source` now and ends; progress is kept in the checkpoint beside the output."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if not is_folder(spark, source):  # a table of one file: the stream watches its folder for that name
        reader, source = reader.option("pathGlobFilter", os.path.basename(source)), os.path.dirname(source)
    stream = reader.parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, i: commit(df, i, out)).option("checkpointLocation", os.path.join(out, "checkpoint"))
    return writer.trigger(availableNow=True).start()


def documents(spark: SparkSession, out: str) -> DataFrame:
    return read_or_empty(spark, os.path.join(out, "documents"), DOCUMENTS + ", batch_idx int")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(batch_idx, vec_start, vec_end, n_documents) of the committed batches."""
    return read_or_empty(spark, os.path.join(out, "manifest"), MANIFEST).select("batch_idx", "vec_start", "vec_end", "n_documents")


def progress(spark: SparkSession, out: str) -> DataFrame:
    """(dataset, row_end): the row of each dataset up to which batches are committed."""
    return read_or_empty(spark, os.path.join(out, "progress"), PROGRESS).groupBy("dataset").agg(F.max("row_end").alias("row_end"))
