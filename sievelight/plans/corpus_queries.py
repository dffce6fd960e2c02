"""Queries of the corpus side: sources, ingest, tokenisation, index statistics, batch control; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import control, ingest, sparse, validate
from ..runtime import table

_STOP = "[" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + "]"
_RANK = "CASE dataset " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(C.DATASETS)) + f" ELSE {len(C.DATASETS)} END"
_DOCS = f"""
docs AS (SELECT *, dataset || '_' || CASE WHEN length(CAST(row_idx AS VARCHAR)) >= 7 THEN CAST(row_idx AS VARCHAR) ELSE lpad(CAST(row_idx AS VARCHAR), 7, '0') END || '_' || substr(md5(substr(text, 1, {C.ID_PREFIX})), 1, 8) AS document_id
  FROM (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, {C.DEDUP_PREFIX}) ORDER BY {_RANK}, row_idx, doc_id) AS rn
        FROM (SELECT * REPLACE (trim(text, ' ') AS text) FROM documents) WHERE length(text) > 0) WHERE rn = 1)"""
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x))"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def kept_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.create_documents(documents(spark, sf))


def source_counts(spark, sf):
    return documents(spark, sf).groupBy("dataset").agg(F.count("*").alias("n_rows"))


def source_limit(spark, sf):
    return ingest.first_rows(documents(spark, sf)).select("dataset", "row_idx", "doc_id")


def row_range(spark, sf):
    return ingest.row_range(documents(spark, sf), 50, 50 + C.BATCH_ROWS).select("dataset", "row_idx", "doc_id")


def doc_ids(spark, sf):
    rows = documents(spark, sf).filter("text IS NOT NULL")
    return rows.select("doc_id", T.doc_id(F.col("dataset"), F.col("row_idx"), F.col("text")).alias("document_id"))


def doc_prefix_dedup(spark, sf):
    return kept_documents(spark, sf).select("doc_id", "document_id")


def doc_hash_antijoin(spark, sf):
    """Two runs: what arrived on the last day against all that came before."""
    docs = documents(spark, sf)
    w = F.col("ingested_at")
    cut = docs.agg(F.date_trunc("day", F.max(w)).alias("cut"))
    rows = docs.crossJoin(F.broadcast(cut))
    seen = ingest.create_documents(rows.filter("ingested_at < cut")).select(ingest.document_hash(F.col("dataset"), F.col("row_idx"), F.col("text")).alias("hash"))
    return ingest.new_documents(rows.filter("ingested_at >= cut"), seen).select("doc_id", "document_id", "hash")


def qa_pairs(spark, sf):
    items = table(spark, sf, "eval_items").select("dataset", F.col("item_id").alias("row_idx"), "question", "answers")
    out = ingest.qa_pairs(items, kept_documents(spark, sf))
    return out.select("question_id", "question", F.array_join("answers", "|").alias("answers"), "dataset", "document_id")


def flatten_answers(spark, sf):
    """Answers of the items, and the five-field structure on literal rows."""
    items = table(spark, sf, "eval_items").select(F.col("item_id").alias("id"), ingest.flatten_answers(F.col("answers")).alias("a"))
    fields = "value string, normalized_value string, aliases array<string>, normalized_aliases array<string>, human_answers array<string>"
    rows = [(-1, (" x ", "y", ["z"], None, None)), (-2, ("", None, [" ", "b "], None, None)), (-3, (None, None, None, None, ["h1", "", "h2"])), (-4, (None, None, [], [], []))]
    literal = spark.createDataFrame(rows, f"id long, s struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>")
    both = items.unionByName(literal.select("id", ingest.first_answers(F.col("s")).alias("a")))
    return both.select("id", F.size("a").alias("n"), F.array_join("a", "|").alias("answers"))


def passages(spark, sf):
    """Paragraphs as nested lists of sentences, one list for each document under a query, taken apart again."""
    rows = table(spark, sf, "sentences").filter("text IS NOT NULL AND doc_id IS NOT NULL").dropDuplicates(["sentence_id"])
    chunks = rows.groupBy("query_id", "doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("position", "sentence_id", "text"))).alias("s"), F.min("title").alias("title"))
    nested = chunks.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "title", F.col("s.text").alias("texts")))).alias("c"))
    # the last title is left out, as a short title list
    nested = nested.select("query_id", "doc_id", F.slice(F.transform("c.title", lambda t: F.coalesce(t, F.lit(""))), 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("titles"), F.col("c.texts").alias("texts"))
    out = ingest.passages(nested, ["query_id", "doc_id"], "titles", "texts")
    return out.select("query_id", "doc_id", "position", "title", F.md5("text").alias("digest"))


def chunk_windows(spark, sf):
    out = ingest.chunk_windows(documents(spark, sf), ["doc_id"])
    return out.select("doc_id", "char_start", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def chunk_ids(spark, sf):
    docs = kept_documents(spark, sf).withColumn("ds", ingest.dataset_rank(F.col("dataset")))
    rows = ingest.chunk_windows(docs, ["ds", "row_idx", "doc_id"]).select("ds", "row_idx", "doc_id", "char_start")
    return ingest.dense_ids(rows, ["ds", "row_idx", "doc_id", "char_start"]).select("doc_id", "char_start", "chunk_id")


def tokenize_index(spark, sf):
    t = T.index_tokens(F.col("text"))
    return documents(spark, sf).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def tokenize_ws(spark, sf):
    t = T.blank_tokens(F.col("text"))
    return documents(spark, sf).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def token_stats(spark, sf):
    n = F.size(T.index_tokens(F.col("text")))
    return documents(spark, sf).groupBy("dataset").agg(F.count_if(n == 0).alias("n_empty"), F.sum(n).cast("bigint").alias("n_tokens"))


def keyword_split(spark, sf):
    return sparse.keyword_terms(table(spark, sf, "queries"))


def fingerprints(spark, sf):
    return documents(spark, sf).filter("text IS NOT NULL").select("doc_id", ingest.document_hash(F.col("dataset"), F.col("row_idx"), F.col("text")).alias("hash"))


def probe_query(spark, sf):
    """A probe for each dataset: the first sentence, at most 120 characters, of the first chunk of ten words or more."""
    docs = documents(spark, sf).filter(T.word_count(F.col("text")) >= 10)
    first = docs.groupBy("dataset").agg(F.min_by("text", F.struct("row_idx", "doc_id")).alias("text"))
    return first.select("dataset", F.substring(F.substring_index(F.col("text"), ".", 1), 1, 120).alias("probe"))


def bm25_index(spark, sf):
    index = sparse.stored(documents(spark, sf), documents(spark, sf), "doc_id", "text")
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_stats(spark, sf):
    index = sparse.stored(documents(spark, sf), documents(spark, sf), "doc_id", "text")
    return index.terms.agg(F.count("*").alias("n_terms")).crossJoin(F.broadcast(index.corpus.select("n_docs", F.round("avgdl", 6).alias("avgdl"))))


def corpus_stats(spark, sf):
    docs = documents(spark, sf)
    out = docs.rollup("dataset").agg(F.count("*").alias("n_docs"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
    return out.select(F.coalesce("dataset", F.lit("all")).alias("dataset"), "n_docs", "mean_chars")


def vector_memory(spark, sf):
    return table(spark, sf, "embeddings").agg((F.count("*") * F.max(F.size("embedding")) * 4).cast("bigint").alias("n_bytes"))


def batch_ranges(spark, sf):
    lengths = source_counts(spark, sf)
    return control.batch_ranges(lengths, 100)


def batched(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors in committed batches of 128: (batch_idx, vec_id)."""
    return control.in_batches(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 128)


def manifest(spark, sf):
    return control.manifest(batched(spark, sf))


def ranges_exhausted(spark, sf):
    """Whether rows are left: for all ranges, and for those behind the last row of each dataset."""
    ranges = control.batch_ranges(source_counts(spark, sf), 100)
    over = ranges.withColumn("row_start", F.col("row_end"))
    return control.exhausted(ranges).withColumn("ranges", F.lit("all")).unionByName(control.exhausted(over).withColumn("ranges", F.lit("behind")))


def manifest_violations(spark, sf):
    """A sound manifest, a damaged one (a batch moved by two) and one without its last batch, side by side."""
    rows = batched(spark, sf)
    good = control.manifest(rows)
    bad = good.withColumn("vec_start", F.when(F.col("batch_idx") == 1, F.col("vec_start") + 2).otherwise(F.col("vec_start")))
    short = good.join(good.agg(F.max("batch_idx").alias("batch_idx")), "batch_idx", "left_anti")
    total = rows.agg(F.count("*").alias("n"))
    tag = lambda df, name: control.violations(df, total).select(F.lit(name).alias("manifest"), "batch_idx", "problem")
    return tag(good, "good").unionByName(tag(bad, "bad")).unionByName(tag(short, "short"))


def shard_integrity(spark, sf):
    """Shards of which one is lost, beside the manifest and the question pairs of each batch."""
    rows = batched(spark, sf)
    pairs = control.in_batches(table(spark, sf, "eval_items").select("item_id"), "item_id", 128)
    return control.integrity(rows.filter("batch_idx <> 2"), control.manifest(rows), pairs)


def orphan_truncate(spark, sf):
    """Vectors beyond the last committed batch are cut off."""
    rows = batched(spark, sf)
    committed = control.manifest(rows).filter("batch_idx < 3")
    return control.truncate_orphans(rows, committed).select("vec_id", "pos")


def shard_range_lookup(spark, sf):
    return control.shard_of(batched(spark, sf), control.manifest(batched(spark, sf)))


def artifact_alignment(spark, sf):
    """Chunks, metadata and vectors side by side: rows of either that lack the other."""
    chunks = table(spark, sf, "retrieved_chunks").select("chunk_idx").distinct()
    parts = table(spark, sf, "sentences").select(F.col("chunk_id").alias("chunk_idx"), F.lit(1).alias("s")).distinct()
    both = chunks.withColumn("c", F.lit(1)).join(parts, "chunk_idx", "full_outer")
    return both.agg(F.count_if(F.col("c").isNull()).alias("without_chunk"), F.count_if(F.col("s").isNull()).alias("without_sentence"), F.count("*").alias("n"))


def vector_lookup(spark, sf):
    """Text and metadata of the chunk behind each sentence."""
    chunks = table(spark, sf, "retrieved_chunks").groupBy("chunk_idx").agg(F.min("doc_id").alias("doc_id"), F.min("dataset").alias("dataset"), F.min("chunk_text").alias("chunk_text"))
    rows = table(spark, sf, "sentences").select("sentence_id", F.col("chunk_id").alias("chunk_idx")).distinct()
    return rows.join(chunks, "chunk_idx", "left").select("sentence_id", "chunk_idx", "doc_id", "dataset", "chunk_text")


def dataset_passages(spark, sf):
    """The documents in the shapes of their datasets' raw rows, taken apart again."""
    d, three = documents(spark, sf), F.pmod("row_idx", F.lit(3))
    lists = lambda c: F.array(F.col(c))
    raw = d.select(
        "doc_id", "dataset", "text", F.col("text").alias("answer"), F.when(three == 2, F.col("text")).alias("context"),
        F.when(three == 0, F.struct(lists("title").alias("title"), F.array(F.col("text"), F.lit(" ")).alias("description"))).alias("search_results"),
        F.when(three == 1, F.struct(F.array().cast("array<string>").alias("title"), F.array(F.lit(None).cast("string"), F.col("text")).alias("wiki_context"))).alias("entity_pages"),
        F.struct(lists("title").alias("title"), F.array(F.split("text", r"\. "), F.array(F.lit("end"))).alias("sentences")).alias("paragraphs"),
    )
    return ingest.dataset_passages(raw, ["doc_id"]).select("doc_id", "position", "title", F.md5("text").alias("digest"))


def input_faults(spark, sf):
    """Questions and sentences with faults, by table."""
    tag = lambda df, name: df.select(F.lit(name).alias("table_name"), "key", "problem")
    s = table(spark, sf, "sentences").dropDuplicates(["sentence_id"])
    return tag(validate.query_faults(table(spark, sf, "queries")), "queries").unionByName(tag(validate.sentence_faults(s, 384), "sentences"))


def sanity_probes(spark, sf):
    """The three best documents of the index for the probe of each dataset, and whether they are of that dataset."""
    probes = probe_query(spark, sf)
    terms = probes.select(F.col("dataset").alias("query_id"), F.explode(T.index_tokens(F.col("probe"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    docs = documents(spark, sf)
    found = sparse.search(sparse.stored(docs, docs, "doc_id", "text"), terms, 3)
    own = docs.select(F.col("doc_id").alias("id"), F.col("dataset").alias("of"))
    return found.join(own, "id").select(F.col("query_id").alias("dataset"), "rank", F.col("id").alias("doc_id"), F.col("of").eqNullSafe(F.col("query_id")).alias("same_dataset"))


QUERIES = {f.__name__: f for f in [
    source_counts, source_limit, row_range, doc_ids, doc_prefix_dedup, doc_hash_antijoin, qa_pairs, flatten_answers, passages, chunk_windows, chunk_ids, tokenize_index, tokenize_ws,
    token_stats, keyword_split, fingerprints, probe_query, bm25_index, bm25_stats, corpus_stats, vector_memory, batch_ranges, manifest, manifest_violations, shard_integrity, orphan_truncate,
    shard_range_lookup, artifact_alignment, vector_lookup, ranges_exhausted, dataset_passages, input_faults, sanity_probes,
]}

_BATCHED = "batched AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 128 AS INT) AS batch_idx FROM embeddings), man AS (SELECT batch_idx, min(pos) AS vec_start, max(pos) + 1 AS vec_end FROM batched GROUP BY 1)"
_VIOLATIONS = """SELECT '{0}' AS manifest, batch_idx, problem FROM (SELECT batch_idx, CASE WHEN batch_idx <> seq THEN 'batch number' WHEN vec_end <= vec_start THEN 'empty' WHEN vec_start <> prev THEN 'gap' WHEN final AND vec_end <> (SELECT count(*) FROM embeddings) THEN 'total' END AS problem
  FROM (SELECT *, row_number() OVER (ORDER BY batch_idx) - 1 AS seq, coalesce(lag(vec_end) OVER (ORDER BY batch_idx), 0) AS prev, lead(batch_idx) OVER (ORDER BY batch_idx) IS NULL AS final FROM {1})) WHERE problem IS NOT NULL"""
_BM25 = f"""
tok AS (SELECT doc_id AS id, {_TOKENS} AS tokens FROM documents),
len AS (SELECT id, len(tokens) AS dl FROM tok),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM tok) GROUP BY 1, 2),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), corpus),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN {C.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""

SQL = {
    "source_counts": "SELECT dataset, count(*) AS n_rows FROM documents GROUP BY 1",
    "source_limit": f"SELECT dataset, row_idx, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_idx, doc_id) AS rn FROM documents) WHERE rn <= {C.ROW_CAP}",
    "row_range": f"SELECT dataset, row_idx, doc_id FROM documents WHERE row_idx >= 50 AND row_idx < {50 + C.BATCH_ROWS}",
    "doc_ids": f"SELECT doc_id, dataset || '_' || CASE WHEN length(CAST(row_idx AS VARCHAR)) >= 7 THEN CAST(row_idx AS VARCHAR) ELSE lpad(CAST(row_idx AS VARCHAR), 7, '0') END || '_' || substr(md5(substr(text, 1, {C.ID_PREFIX})), 1, 8) AS document_id FROM documents WHERE text IS NOT NULL",
    "doc_prefix_dedup": f"WITH {_DOCS} SELECT doc_id, document_id FROM docs",
    "doc_hash_antijoin": f"""
WITH cut AS (SELECT date_trunc('day', max(ingested_at)) AS cut FROM documents),
t AS (SELECT * REPLACE (trim(text, ' ') AS text), ingested_at >= (SELECT cut FROM cut) AS later FROM documents),
kept AS (SELECT *, row_number() OVER (PARTITION BY later, substr(text, 1, {C.DEDUP_PREFIX}) ORDER BY {_RANK}, row_idx, doc_id) AS rn FROM t WHERE length(text) > 0),
h AS (SELECT doc_id, later, dataset || '_' || lpad(CAST(row_idx AS VARCHAR), 7, '0') || '_' || substr(md5(substr(text, 1, {C.ID_PREFIX})), 1, 8) AS document_id,
        md5(dataset || ':' || CAST(row_idx AS VARCHAR) || ':' || substr(text, 1, {C.DEDUP_PREFIX})) AS hash FROM kept WHERE rn = 1)
SELECT doc_id, document_id, hash FROM h WHERE later AND hash NOT IN (SELECT hash FROM h WHERE NOT later)""",
    "qa_pairs": f"""
WITH {_DOCS}, first AS (SELECT dataset, row_idx, min_by(document_id, doc_id) AS document_id FROM docs GROUP BY 1, 2),
items AS (SELECT dataset, item_id AS row_idx, trim(question, ' ') AS question, list_filter(list_transform(coalesce(answers, []), lambda x: trim(x, ' ')), lambda x: x <> '') AS answers FROM eval_items)
SELECT i.dataset || '_q' || lpad(CAST(i.row_idx AS VARCHAR), 7, '0') AS question_id, question, array_to_string(answers, '|') AS answers, i.dataset, document_id
FROM items i LEFT JOIN first f ON i.dataset = f.dataset AND i.row_idx = f.row_idx WHERE length(question) > 0 AND len(answers) > 0""",
    "flatten_answers": """
WITH items AS (SELECT item_id AS id, list_filter(list_transform(coalesce(answers, []), lambda x: trim(x, ' ')), lambda x: x <> '') AS a FROM eval_items)
SELECT id, CAST(len(a) AS INT) AS n, array_to_string(a, '|') AS answers FROM items
UNION ALL SELECT * FROM (VALUES (-1, 1, 'x'), (-2, 1, 'b'), (-3, 2, 'h1|h2'), (-4, 0, '')) AS v(id, n, answers)""",
    "passages": """
WITH one AS (SELECT sentence_id, any_value(query_id) AS query_id, any_value(doc_id) AS doc_id, any_value(chunk_id) AS chunk_id, any_value(position) AS position, any_value(text) AS text, any_value(title) AS title
  FROM sentences WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
c AS (SELECT query_id, doc_id, chunk_id, trim(string_agg(text, ' ' ORDER BY position, sentence_id), ' ') AS text, min(title) AS title FROM one GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk_id) - 1 AS position, count(*) OVER (PARTITION BY query_id, doc_id) AS n FROM c)
SELECT query_id, doc_id, CAST(position AS INT) AS position, CASE WHEN position < n - 1 THEN coalesce(title, '') ELSE '' END AS title, md5(text) AS digest FROM r WHERE length(text) > 0""",
    "chunk_windows": f"""
WITH w AS (SELECT doc_id, k * 700 AS char_start, trim(substr(text, k * 700 + 1, {C.CHUNK_SIZE}), ' ') AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 700.0) AS BIGINT))) AS k FROM documents WHERE length(text) > 0))
SELECT doc_id, CAST(char_start AS INT) AS char_start, CAST(length(chunk) AS INT) AS n_chars, md5(chunk) AS digest FROM w WHERE length(chunk) > 0""",
    "chunk_ids": f"""
WITH {_DOCS}, w AS (SELECT {_RANK} AS ds, row_idx, doc_id, k * 700 AS char_start, trim(substr(text, k * 700 + 1, {C.CHUNK_SIZE}), ' ') AS chunk
  FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 700.0) AS BIGINT))) AS k FROM docs))
SELECT doc_id, CAST(char_start AS INT) AS char_start, row_number() OVER (ORDER BY ds, row_idx, doc_id, char_start) - 1 AS chunk_id FROM w WHERE length(chunk) > 0""",
    "tokenize_index": f"SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "tokenize_ws": r"SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS t FROM documents)",
    "token_stats": f"SELECT dataset, count(*) FILTER (WHERE len(t) = 0) AS n_empty, CAST(sum(len(t)) AS BIGINT) AS n_tokens FROM (SELECT dataset, {_TOKENS} AS t FROM documents) GROUP BY 1",
    "keyword_split": r"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(k), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS term FROM (SELECT query_id, unnest(keywords) AS k FROM queries)) GROUP BY 1, 2",
    "fingerprints": f"SELECT doc_id, md5(dataset || ':' || CAST(row_idx AS VARCHAR) || ':' || substr(text, 1, {C.DEDUP_PREFIX})) AS hash FROM documents WHERE text IS NOT NULL",
    "probe_query": r"SELECT dataset, substr(split_part(text, '.', 1), 1, 120) AS probe FROM (SELECT dataset, text, row_number() OVER (PARTITION BY dataset ORDER BY row_idx, doc_id) AS rn FROM documents WHERE len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) >= 10) WHERE rn = 1",
    "bm25_index": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_stats": f"WITH {_BM25} SELECT (SELECT count(*) FROM terms) AS n_terms, n_docs, round(avgdl, 6) AS avgdl FROM corpus",
    "corpus_stats": "SELECT coalesce(dataset, 'all') AS dataset, count(*) AS n_docs, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY ROLLUP (dataset)",
    "vector_memory": "SELECT CAST(count(*) * max(len(embedding)) * 4 AS BIGINT) AS n_bytes FROM embeddings",
    "batch_ranges": "SELECT dataset, batch_idx, batch_idx * 100 AS row_start, least((batch_idx + 1) * 100, n) AS row_end FROM (SELECT dataset, n, unnest(range(0, CAST(ceil(n / 100.0) AS BIGINT))) AS batch_idx FROM (SELECT dataset, count(*) AS n FROM documents GROUP BY 1))",
    "manifest": f"WITH {_BATCHED} SELECT * FROM man",
    "manifest_violations": f"WITH {_BATCHED}, bad AS (SELECT batch_idx, CASE WHEN batch_idx = 1 THEN vec_start + 2 ELSE vec_start END AS vec_start, vec_end FROM man) " + _VIOLATIONS.format("good", "man") + " UNION ALL " + _VIOLATIONS.format("bad", "bad") + " UNION ALL " + _VIOLATIONS.format("short", "(SELECT * FROM man WHERE batch_idx < (SELECT max(batch_idx) FROM man))"),
    "shard_integrity": f"""WITH {_BATCHED}, s AS (SELECT batch_idx, count(*) AS n FROM batched WHERE batch_idx <> 2 GROUP BY 1), p AS (SELECT batch_idx, count(*) AS n_pairs FROM (SELECT CAST((row_number() OVER (ORDER BY item_id) - 1) // 128 AS INT) AS batch_idx FROM eval_items) GROUP BY 1),
j AS (SELECT coalesce(man.batch_idx, s.batch_idx) AS batch_idx, coalesce(vec_end - vec_start, 0) AS expected, coalesce(n, 0) AS found FROM man FULL OUTER JOIN s ON man.batch_idx = s.batch_idx)
SELECT j.*, coalesce(n_pairs, 0) AS n_pairs, expected = found AND coalesce(n_pairs, 0) > 0 AS sound FROM j LEFT JOIN p USING (batch_idx)""",
    "orphan_truncate": f"WITH {_BATCHED} SELECT vec_id, pos FROM batched WHERE pos < (SELECT max(vec_end) FROM man WHERE batch_idx < 3)",
    "shard_range_lookup": f"WITH {_BATCHED} SELECT vec_id, man.batch_idx AS shard FROM batched JOIN man ON pos >= vec_start AND pos < vec_end",
    "artifact_alignment": "WITH c AS (SELECT DISTINCT chunk_idx, 1 AS c FROM retrieved_chunks), s AS (SELECT DISTINCT chunk_id AS chunk_idx, 1 AS s FROM sentences) SELECT count(*) FILTER (WHERE c IS NULL) AS without_chunk, count(*) FILTER (WHERE s IS NULL) AS without_sentence, count(*) AS n FROM c FULL OUTER JOIN s USING (chunk_idx)",
    "vector_lookup": "SELECT s.sentence_id, s.chunk_id AS chunk_idx, c.doc_id, c.dataset, c.chunk_text FROM (SELECT DISTINCT sentence_id, chunk_id FROM sentences) s LEFT JOIN (SELECT chunk_idx, min(doc_id) AS doc_id, min(dataset) AS dataset, min(chunk_text) AS chunk_text FROM retrieved_chunks GROUP BY 1) c ON s.chunk_id = c.chunk_idx",
    "ranges_exhausted": "SELECT 'all' AS ranges, count(*) = 0 AS exhausted FROM documents UNION ALL SELECT 'behind', true",
    "dataset_passages": """
WITH p AS (
  SELECT doc_id, 0 AS position, '' AS title, trim(coalesce(text, ''), ' ') AS text FROM documents WHERE dataset NOT IN ('trivia', 'hotpot') OR dataset IS NULL
  UNION ALL SELECT doc_id, CASE WHEN row_idx % 3 = 1 AND trim(coalesce(text, ''), ' ') <> '' THEN 1 ELSE 0 END, CASE WHEN row_idx % 3 = 0 THEN coalesce(title, '') ELSE '' END, trim(coalesce(text, ''), ' ') FROM documents WHERE dataset = 'trivia'
  UNION ALL SELECT doc_id, 0, coalesce(title, ''), trim(replace(text, '. ', ' '), ' ') FROM documents WHERE dataset = 'hotpot' AND text IS NOT NULL
  UNION ALL SELECT doc_id, 1, '', 'end' FROM documents WHERE dataset = 'hotpot')
SELECT doc_id, CAST(position AS INT) AS position, title, md5(text) AS digest FROM p WHERE length(text) > 0""",
    "input_faults": f"""
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id) AS one FROM sentences) WHERE one = 1)
SELECT 'queries' AS table_name, query_id AS key, unnest(list_filter([CASE WHEN query IS NULL OR trim(query, ' ') = '' THEN 'no question' END, CASE WHEN query_type IS NULL THEN 'no type' END,
  CASE WHEN query_type NOT IN ({', '.join(f"'{t}'" for t in C.TOKEN_BUDGET)}) THEN 'unknown type' END, CASE WHEN entities IS NULL THEN 'no entities' END, CASE WHEN keywords IS NULL THEN 'no keywords' END], lambda x: x IS NOT NULL)) AS problem FROM queries
UNION ALL SELECT 'sentences', sentence_id, unnest(list_filter([CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'no text' END, CASE WHEN doc_id IS NULL THEN 'no document' END, CASE WHEN position IS NULL THEN 'no position' END,
  CASE WHEN token_count < 1 THEN 'no tokens' END, CASE WHEN len(embedding) <> 384 OR len(list_filter(embedding, lambda x: isnan(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'unusable embedding' END], lambda x: x IS NOT NULL)) FROM s""",
    "sanity_probes": f"""WITH {_BM25}, probe AS (PROBES), q AS (SELECT dataset, term, count(*) AS qtf FROM (SELECT dataset, unnest({_TOKENS.replace("text", "probe")}) AS term FROM probe) GROUP BY 1, 2),
sc AS (SELECT dataset, id, round(sum(qtf * idf * tf * {C.K1 + 1} / (tf + {C.K1} * ({1 - C.B} + {C.B} * dl / avgdl))), 6) AS score FROM q JOIN terms USING (term) JOIN post USING (term) JOIN len USING (id), corpus GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0)
SELECT rk.dataset, rank, id AS doc_id, d.dataset IS NOT DISTINCT FROM rk.dataset AS same_dataset FROM rk JOIN documents d ON d.doc_id = rk.id WHERE rank <= 3""",
}
SQL["sanity_probes"] = SQL["sanity_probes"].replace("PROBES", SQL["probe_query"])
