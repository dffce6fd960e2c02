"""Documents, question pairs and chunks from raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..runtime import materialize


def dataset_rank(dataset: Column) -> Column:
    """Position of a dataset in the fixed order; unknown ones come last."""
    order = F.coalesce(*[F.when(dataset == d, F.lit(i)) for i, d in enumerate(C.DATASETS)], F.lit(len(C.DATASETS)))
    return order


def first_rows(df: DataFrame, n: int = C.ROW_CAP) -> DataFrame:
    """The first n rows of each dataset by row index; the limit is the feature, kept by a window group limit."""
    w = W.partitionBy("dataset").orderBy("row_idx", "doc_id")
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def row_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows [start, end) of each dataset; a plain filter that reaches the scan."""
    return df.filter((F.col("row_idx") >= start) & (F.col("row_idx") < end))


def create_documents(df: DataFrame) -> DataFrame:
    """Trimmed texts, empty ones dropped, the first of each 200-character beginning kept in dataset order, with ids."""
    text = F.trim(F.col("text"))
    rows = df.filter(F.length(text) > 0).withColumn("text", text)
    w = W.partitionBy(F.substring("text", 1, C.DEDUP_PREFIX)).orderBy(dataset_rank(F.col("dataset")), "row_idx", "doc_id")
    kept = rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return kept.withColumn("document_id", T.doc_id(F.col("dataset"), F.col("row_idx"), F.col("text")))


def document_hash(dataset: Column, row: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", dataset, row.cast("string"), F.substring(text, 1, C.DEDUP_PREFIX)))


def new_documents(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents of a batch that no earlier batch has: within the batch by beginning, across batches by hash (left anti join)."""
    docs = create_documents(batch).withColumn("hash", document_hash(F.col("dataset"), F.col("row_idx"), F.col("text")))
    return docs.join(seen.select("hash"), "hash", "left_anti")


def flatten_answers(answers: Column) -> Column:
    """Trimmed, non-empty answers in their order; null gives none."""
    return F.filter(F.transform(F.coalesce(answers, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def first_answers(answers: Column) -> Column:
    """Of a struct with the five answer fields the first that yields any answer."""
    found = [flatten_answers(F.array(answers[k]) if k in ("value", "normalized_value") else answers[k]) for k in C.ANSWER_KEYS]
    return F.coalesce(*[F.when(F.size(f) > 0, f) for f in found], F.array().cast("array<string>"))


def qa_pairs(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, question, answers, dataset, document_id) of rows that have both; the document is the first of the same row, or null."""
    question, answers = F.trim(F.col("question")), flatten_answers(F.col("answers"))
    pairs = items.select("dataset", F.col("row_idx"), question.alias("question"), answers.alias("answers")).filter((F.length("question") > 0) & (F.size("answers") > 0))
    first = documents.groupBy("dataset", "row_idx").agg(F.min_by("document_id", "doc_id").alias("document_id"))
    number = F.col("row_idx").cast("string")
    qid = F.concat(F.col("dataset"), F.lit("_q"), F.when(F.length(number) >= 7, number).otherwise(F.lpad(number, 7, "0")))
    return pairs.join(first, ["dataset", "row_idx"], "left").select(qid.alias("question_id"), "question", "answers", "dataset", "document_id")


def passages(df: DataFrame, key: list[str], titles: str, texts: str) -> DataFrame:
    """(key, position, title, text) from parallel lists; a short title list gives empty titles, lists of sentences are joined by a blank."""
    nested = df.schema[texts].dataType.elementType.simpleString().startswith("array")
    exploded = df.select(*key, F.col(titles).alias("__t"), F.posexplode(texts).alias("position", "__x"))
    text = F.array_join("__x", " ") if nested else F.col("__x")
    title = F.coalesce(F.get("__t", F.col("position")), F.lit(""))
    return exploded.select(*key, "position", title.alias("title"), F.trim(text).alias("text")).filter(F.length("text") > 0)


def dataset_passages(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, position, title, text) by the shape of each dataset's rows; blank passages are left out, their positions are kept.

    nq: the column answer, without a title. trivia: the descriptions of search_results, then the contexts of entity_pages,
    and the column context only where neither holds a text. hotpot: the paragraphs of context, whose sentences are joined by
    a blank. Other datasets: the column text. df has dataset and these columns, null where a row has none.
    """
    item = "array<struct<title:string,text:string>>"
    none = F.array().cast(item)

    def zipped(titles: Column, texts: Column) -> Column:
        made = F.transform(texts, lambda x, i: F.struct(F.coalesce(F.get(titles, i), F.lit("")).alias("title"), F.trim(F.coalesce(x, F.lit(""))).alias("text")))
        return F.coalesce(made.cast(item), none)

    solid = lambda rows: F.filter(rows, lambda r: r["text"] != "")
    alone = lambda c: F.array(F.struct(F.lit("").alias("title"), F.trim(F.coalesce(F.col(c), F.lit(""))).alias("text"))).cast(item)
    pages = F.concat(zipped(F.col("search_results.title"), F.col("search_results.description")), zipped(F.col("entity_pages.title"), F.col("entity_pages.wiki_context")))
    trivia = F.when(F.size(solid(pages)) > 0, pages).otherwise(alone("context"))
    hotpot = zipped(F.col("paragraphs.title"), F.transform("paragraphs.sentences", lambda x: F.array_join(x, " ")))
    rows = F.when(F.col("dataset") == "nq", alone("answer")).when(F.col("dataset") == "trivia", trivia).when(F.col("dataset") == "hotpot", hotpot).otherwise(alone("text"))
    out = df.select(*key, F.posexplode(rows).alias("position", "p"))
    return out.select(*key, "position", F.col("p.title").alias("title"), F.col("p.text").alias("text")).filter(F.length("text") > 0)


def chunk_windows(df: DataFrame, key: list[str], text: str = "text", size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """(key, char_start, chunk): windows of `size` characters every size - overlap, trimmed, blank ones dropped."""
    if overlap >= size:
        raise ValueError("overlap must be below size")
    step = size - overlap
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1))
    rows = df.select(*key, F.col(text).alias("__text"), F.explode(starts).alias("k"))
    piece = F.trim(F.col("__text").substr(F.col("k") * step + 1, F.lit(size)))
    return rows.select(*key, (F.col("k") * step).cast("int").alias("char_start"), piece.alias("chunk")).filter(F.length("chunk") > 0)


def dense_ids(df: DataFrame, order: list[str], name: str = "chunk_id", offset: int = 0) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of the columns: range partitions are counted, their offsets summed up, rows numbered inside.

    No task holds more than a range partition; the offsets are one row for each partition.
    """
    sorted_ = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    counts = sorted_.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return sorted_.withColumn("__in", inside).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__in") + offset).cast("bigint")).drop("__part", "__in", "__before")
