"""Sentence objects from retrieved chunks, by a rule splitter that stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T


def sentences(text: Column) -> Column:
    """Parts between a final mark with a blank before a capital, digit or quotation mark, and between lines; not cleaned."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?])[ \\t]+([A-Z0-9\"“])", "$1\u0001$2")
    return F.split(F.regexp_replace(marked, "[\\r\\n]+", "\u0001"), "\u0001")


def split_chunks(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, sentence): every non-blank cleaned part; position numbers all parts, dropped ones included."""
    parts = chunks.select(key, F.posexplode(sentences(F.col(text))).alias("position", "raw"))
    return parts.select(key, "position", T.clean(F.col("raw")).alias("sentence")).filter(F.length("sentence") > 0)


def verdict(sentence: Column, least: int = C.SENTENCE_TOKENS[0], most: int = C.SENTENCE_TOKENS[1]) -> Column:
    """keep, fragment, short or long."""
    n = T.word_count(sentence)
    return F.when(T.is_fragment(sentence), "fragment").when(n < least, "short").when(n > most, "long").otherwise("keep")


NONE = "cast(array() as array<string>)"


def lemmas(sentence: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(sentence), F.lit("([a-z0-9]+)"), F.lit(1)), T.lemma)


def mentions(low: Column, forms: Column, entities: Column, keywords: Column) -> Column:
    """Whether any entity occurs as a part of the lower-cased text, or a keyword equals one of its words' normal forms."""
    by_entity = F.exists(F.coalesce(entities, F.expr(NONE)), lambda e: (e != "") & low.contains(F.lower(e)))
    return by_entity | F.arrays_overlap(F.coalesce(keywords, F.expr(NONE)), forms)


def segment(hits: DataFrame, chunks: DataFrame, queries: DataFrame, signals: dict[str, Column] | None = None) -> DataFrame:
    """Sentence objects of hits (query_id, chunk_idx, rrf_rank, rrf_score, bm25_score, faiss_score, doc_id, dataset, title, year).

    chunks is (chunk_idx, chunk_text), each split once however many queries hit it; queries has entities and keywords.
    signals are further columns made of `sentence`. All that depends on the sentence alone is made before the join.
    """
    kept = split_chunks(chunks, "chunk_idx", "chunk_text").filter(verdict(F.col("sentence")) == "keep")
    kept = kept.select("*", T.word_count(F.col("sentence")).alias("token_count"), F.lower("sentence").alias("__low"), lemmas(F.col("sentence")).alias("__forms"), *[c.alias(k) for k, c in (signals or {}).items()])
    rows = hits.join(kept, "chunk_idx").join(queries.select("query_id", "entities", "keywords"), "query_id")
    return rows.select(
        "query_id", F.concat_ws(":", "dataset", "doc_id", F.col("chunk_idx").cast("string"), F.col("position").cast("string")).alias("sentence_id"), F.col("sentence").alias("text"), "doc_id", "dataset",
        "title", "position", F.col("position").alias("sent_idx"), F.col("rrf_rank").alias("retrieval_rank"), F.col("chunk_idx").alias("chunk_id"), "year", "bm25_score", "faiss_score",
        F.col("rrf_score").alias("retrieval_score"), mentions(F.col("__low"), F.col("__forms"), F.col("entities"), F.col("keywords")).alias("contains_query_entity"), "token_count", *(signals or {}),
    )
