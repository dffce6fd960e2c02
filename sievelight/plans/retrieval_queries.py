"""Queries of the online side: analysis, retrieval, fusion, segmentation, scoring, selection; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import analyze, control, dense, fusion, graph, score, segment, select, sparse
from ..runtime import materialize, table
from . import selection_sql as X
from . import sqltext as S

#: Literal questions whose results are known, beside those of the tables.
FIXTURES = [
    "Who invented the telephone?", "What is the capital of France?", "How does photosynthesis work?", "What did Marie Curie and Albert Einstein both contribute to physics?",
    "Which film won the Academy Award for Best Picture in 2020 and who directed it?", "In which year did the Berlin Wall fall?", "What did Einstein publish in Germany in 1905?",
    "Why did the Roman Empire collapse?", "When and where was Nikola Tesla born?", "Who invented C++ and when did it become popular?", "Compare Newton and Einstein on gravity",
    "What is the difference between TCP and UDP?", "What countries are not members of NATO?", "Countries excluding NATO membership", "Neither A nor B is correct", "Who invented telephones?", "Why doesn't it work?",
]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    literal = spark.createDataFrame([(f"f{i:02d}", q) for i, q in enumerate(FIXTURES)], "query_id string, query string")
    return table(spark, sf, "queries").select("query_id", "query").unionByName(literal)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_idx, chunk_text), one row for each chunk."""
    return table(spark, sf, "retrieved_chunks").groupBy("chunk_idx").agg(F.min("chunk_text").alias("chunk_text"))


def one_sentence(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each sentence; repeated deliveries are exact copies."""
    return table(spark, sf, "sentences").dropDuplicates(["sentence_id"])


def query_info(spark, sf):
    out = analyze.analyze(questions(spark, sf))
    joined = lambda c: F.array_join(F.array_sort(c), "|").alias(c)
    return out.select("query_id", "query", "query_type", joined("keywords"), joined("entities"), "has_negation")


def query_type(spark, sf):
    return questions(spark, sf).select("query_id", analyze.query_type(F.col("query")).alias("query_type"))


def query_negation(spark, sf):
    return questions(spark, sf).select("query_id", analyze.has_negation(F.col("query")).alias("has_negation"))


def query_keywords(spark, sf):
    return questions(spark, sf).select("query_id", F.explode(analyze.keywords(F.col("query"))).alias("keyword"))


def query_entities(spark, sf):
    return questions(spark, sf).select("query_id", F.explode(analyze.entities(F.col("query"))).alias("entity"))


def complexities(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    q = table(spark, sf, "queries")
    return q.select("query_id", "query_type", analyze.complexity(F.col("query"), F.size(F.coalesce("entities", none)), F.size(F.coalesce("keywords", none))).alias("complexity"))


def query_complexity(spark, sf):
    return complexities(spark, sf)


def required_evidence(spark, sf):
    return complexities(spark, sf).select("query_id", select.required_evidence(F.col("query_type"), F.col("complexity")).cast("int").alias("required"))


def sentence_clean(spark, sf):
    c = T.clean(F.col("text"))
    return one_sentence(spark, sf).filter("text IS NOT NULL").select("sentence_id", F.md5(c).alias("digest"), T.is_fragment(c).alias("is_fragment"), T.word_count(F.col("text")).alias("n_words"))


def plural_normalise(spark, sf):
    return one_sentence(spark, sf).select("sentence_id", F.md5(F.array_join(F.array_sort(T.term_tokens(F.col("text"))), " ")).alias("digest"))


def evidentiality(spark, sf):
    t = F.col("text")
    return one_sentence(spark, sf).filter("text IS NOT NULL").select("sentence_id", *[T.evidential(t, k).alias(k) for k in C.EVIDENTIALITY], F.round(T.evidentiality(t), 6).alias("share"))


def recency(spark, sf):
    q = table(spark, sf, "queries").select("query_id", "query")
    rows = table(spark, sf, "retrieved_chunks").select("query_id", "chunk_idx", "year").distinct().join(q, "query_id")
    return rows.select("query_id", "chunk_idx", "year", score.temporal(F.col("query"), F.col("year")).alias("signal"))


def segment_sentences(spark, sf):
    parts = segment.split_chunks(chunks(spark, sf), "chunk_idx", "chunk_text")
    return parts.select("chunk_idx", "position", F.md5("sentence").alias("digest"), segment.verdict(F.col("sentence")).alias("verdict"))


def segment_drop_counts(spark, sf):
    parts = segment.split_chunks(chunks(spark, sf), "chunk_idx", "chunk_text")
    return parts.groupBy(segment.verdict(F.col("sentence")).alias("verdict")).agg(F.count("*").alias("n"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """The delivered hits, one row for each query and chunk."""
    rows = table(spark, sf, "retrieved_chunks").dropDuplicates(["query_id", "chunk_idx"])
    return rows.select("query_id", "chunk_idx", "rrf_rank", "rrf_score", "bm25_score", "faiss_score", "doc_id", "dataset", "title", "year")


def sentence_objects(spark, sf):
    """Sentence objects of all hits."""
    out = segment.segment(hits(spark, sf), chunks(spark, sf), table(spark, sf, "queries"))
    return out.select("query_id", "sentence_id", "position", "token_count", "contains_query_entity", F.md5("text").alias("digest"))


def term_coverage(spark, sf):
    rows = select.with_masks(one_sentence(spark, sf).select("query_id", "text"), table(spark, sf, "queries")).withColumn("selected", F.lit(True))
    out = select.coverage(rows)
    return out.select("query_id", "covered_entities", "covered_keywords", F.size("missing_entities").alias("n_missing_entities"), F.size("missing_keywords").alias("n_missing_keywords"))


def bm25_topk(spark, sf):
    index = sparse.stored(table(spark, sf, "retrieved_chunks"), chunks(spark, sf), "chunk_idx", "chunk_text")
    return sparse.search(index, sparse.keyword_terms(table(spark, sf, "queries")), 15).withColumnRenamed("id", "chunk_idx")


def dense_topk(spark, sf):
    """Every 50th vector against all."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = dense.top_k(v.filter("id % 50 = 0"), v, 64, 15)
    return out.select(F.col("id").alias("vec_id"), F.col("other").alias("other_id"), F.round("cosine", 6).alias("cosine"), "rank")


def dense_shard_retrieve(spark, sf):
    """Dense hits with the shard that holds each, in search order."""
    from .corpus_queries import batched

    rows = batched(spark, sf)
    shards = control.shard_of(rows, control.manifest(rows)).withColumnRenamed("vec_id", "other_id")
    return dense_topk(spark, sf).join(shards, "other_id").select("vec_id", "rank", "other_id", "shard")


def in_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Figures of several steps in long form: (query_id, layer, metric, value), numbers and flags as whole numbers; a later step of one name wins."""
    out = None
    for layer, stats in layers.items():
        names = [f.name for f in stats.schema.fields if f.dataType.simpleString() in ("int", "bigint", "boolean")]
        long = stats.unpivot(["query_id"], [F.col(c).cast("bigint").alias(c) for c in names], "metric", "value")
        long = long.select("query_id", F.lit(layer).alias("layer"), "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def layer_stats(spark, sf):
    """Figures of the budget, of the coverage swaps and of sufficiency."""
    return in_layers({"budget": budget_stats(spark, sf), "diversity": diversity_stats(spark, sf), "sufficiency": sufficiency(spark, sf)})


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The delivered scores of either side as rankings; null, NaN and 0.0 mean not retrieved."""
    from pyspark.sql import Window as W

    def side(c: str) -> DataFrame:
        s = F.col(c)
        rows = hits(spark, sf).filter(s.isNotNull() & ~F.isnan(s) & (s > 0))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(s.desc(), "chunk_idx"))
        return rows.select("query_id", F.col("chunk_idx").alias("id"), s.alias("score"), rank.alias("rank"))

    return side("bm25_score"), side("faiss_score")


def hybrid_rrf(spark, sf):
    types = table(spark, sf, "queries").select("query_id", F.coalesce("query_type", F.lit("factoid")).alias("query_type"))
    out = fusion.fuse(*sides(spark, sf), types)
    return out.select("query_id", F.col("id").alias("chunk_idx"), F.round("rrf_score", 9).alias("rrf_score"), "rrf_rank", F.round("bm25_score", 6).alias("bm25_score"), F.round("faiss_score", 6).alias("faiss_score"))


def hash_embed(spark, sf):
    """The hashing embedder on all documents, in its sparse form."""
    out = dense.hash_embedding(table(spark, sf, "documents"), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), "bucket", "n", F.round("norm", 6).alias("norm"))


def similarity(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, sentence_id, cosine) of questions and their sentences by the hashing embedder; a sentence is embedded behind its question."""
    q = table(spark, sf, "queries").select("query_id", "query")
    s = one_sentence(spark, sf).select("query_id", "sentence_id", "text").join(q, "query_id")
    left = dense.hash_embedding(q, "query_id", "query")
    right = dense.hash_embedding(s.withColumn("joint", F.concat_ws(" [SEP] ", "query", "text")), "sentence_id", "joint")
    pairs = s.select(F.col("query_id").alias("a"), F.col("sentence_id").alias("b"))
    return score.hash_cosine(left, right, pairs).select(F.col("a").alias("query_id"), F.col("b").alias("sentence_id"), F.round("cosine", 9).alias("cosine"))


def hash_similarity(spark, sf):
    return similarity(spark, sf)


def evidence_density(spark, sf):
    t = F.col("text")
    return one_sentence(spark, sf).select("sentence_id", F.round(score.evidence(t), 6).alias("evidence"), F.round(score.density(t), 6).alias("density"))


def multi_signal_score(spark, sf):
    t = F.col("text")
    s = one_sentence(spark, sf).select("query_id", "sentence_id", "text", "year")
    rows = s.join(table(spark, sf, "queries").select("query_id", "query", "query_type"), "query_id").join(similarity(spark, sf), ["query_id", "sentence_id"], "left")
    signals = [F.coalesce("cosine", F.lit(0.0)), score.evidence(t), T.evidentiality(t), score.density(t), score.temporal(F.col("query"), F.col("year"))]
    return rows.select("query_id", "sentence_id", score.combined(F.coalesce("query_type", analyze.query_type(F.col("query"))), signals).alias("score"))


def conflicts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (grp, id, prio), all sentences, and conflicts (grp, a, b) of near copies among each query's; without a usable embedding there are none."""
    s = one_sentence(spark, sf).select("query_id", "sentence_id", "doc_id", "embedding", F.coalesce(F.nanvl("final_score", F.lit(0.0)), F.lit(0.0)).alias("score"))
    pairs = dense.close_pairs(s, "query_id", "sentence_id", "embedding", 384, C.DUPLICATE_SOFT)
    doc = s.select(F.col("sentence_id").alias("id"), F.col("doc_id").alias("da")), s.select(F.col("sentence_id").alias("other"), F.col("doc_id").alias("db"))
    bad = pairs.join(doc[0], "id").join(doc[1], "other").filter((F.col("cosine") >= C.DUPLICATE_EXACT) | F.col("da").eqNullSafe(F.col("db")))
    nodes = s.select(F.col("query_id").alias("grp"), F.col("sentence_id").alias("id"), F.struct((-F.col("score")).alias("s"), F.col("sentence_id").alias("i")).alias("prio"))
    return nodes, bad.select("grp", F.col("id").alias("a"), F.col("other").alias("b"))


def cosine_pairs(spark, sf):
    s = one_sentence(spark, sf).select("query_id", "sentence_id", "embedding")
    out = dense.close_pairs(s, "query_id", "sentence_id", "embedding", 384, C.GRAPH_COSINE)
    return out.select(F.col("grp").alias("query_id"), F.col("id").alias("sentence_a"), F.col("other").alias("sentence_b"), F.round("cosine", 6).alias("cosine"))


def greedy_dedup(spark, sf):
    """The sentences that de-duplication keeps; one without a usable embedding is a near copy of none and is kept."""
    nodes, bad = conflicts(spark, sf)
    return select.keep_greedily(nodes, bad).select(F.col("grp").alias("query_id"), F.col("id").alias("sentence_id"))


def concepts(spark, sf):
    return one_sentence(spark, sf).select("query_id", "sentence_id", F.explode(graph.concepts(F.col("text"))).alias("concept"))


def query_concepts(q: DataFrame) -> DataFrame:
    """(grp, concept): the entities and keywords of each question, lower-cased; where it has none, the concepts of the question itself."""
    none = F.array().cast("array<string>")
    listed = F.filter(F.transform(F.concat(F.coalesce("entities", none), F.coalesce("keywords", none)), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    rows = q.select(F.col("query_id").alias("grp"), listed.alias("t"), graph.concepts(F.col("query"), graph.WORD).alias("own"))
    return rows.select("grp", F.explode(F.array_distinct(F.when(F.size("t") > 0, F.col("t")).otherwise(F.col("own")))).alias("concept"))


def sentence_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return one_sentence(spark, sf).select(F.col("query_id").alias("grp"), F.col("sentence_id").alias("node"), "text", "embedding")


def near_pairs(nodes: DataFrame) -> DataFrame:
    return dense.close_pairs(nodes, "grp", "node", "embedding", 384, C.GRAPH_COSINE).select("grp", F.col("id").alias("a"), F.col("other").alias("b"))


def concept_links(spark, sf):
    """The edges of each query's graph by the concept that makes them."""
    return graph.concept_links(graph.incidences(sentence_nodes(spark, sf))).withColumnRenamed("grp", "query_id")


def bridge_paths(spark: SparkSession, sf: str) -> DataFrame:
    s = sentence_nodes(spark, sf)
    links = materialize(graph.incidences(s), "incidences")
    sources = links.join(query_concepts(table(spark, sf, "queries")), ["grp", "concept"], "left_semi").select("grp", "node").distinct()
    return graph.bridges(links, sources, materialize(near_pairs(s), "near_pairs"))


def bridge_nodes(spark, sf):
    return graph.bridge_nodes(bridge_paths(spark, sf)).select(F.col("grp").alias("query_id"), F.col("node").alias("sentence_id"))


def budget_input(spark: SparkSession, sf: str) -> DataFrame:
    s = one_sentence(spark, sf)
    return s.select("query_id", "sentence_id", F.greatest(F.coalesce("token_count", T.token_count(F.col("text"))), F.lit(0)).alias("token_count"), F.coalesce(F.nanvl("final_score", F.lit(0.0)), F.lit(0.0)).alias("score"),
                    F.coalesce("force_include", F.lit(False)).alias("is_bridge"), "text", "doc_id", "position", F.length("text").alias("n_chars"))


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return select.fit_budget(budget_input(spark, sf), table(spark, sf, "queries"))


def budget_fill(spark, sf):
    return filled(spark, sf).select("query_id", "sentence_id", "selected")


def budget_stats(spark, sf):
    return select.budget_stats(filled(spark, sf))


def masked(spark: SparkSession, sf: str) -> DataFrame:
    """The filled budget with cover masks, written once: every later step reads it several times."""
    return materialize(select.with_masks(filled(spark, sf), table(spark, sf, "queries")).drop("text"), "masked")


def missing_terms(spark, sf):
    out = select.coverage(masked(spark, sf))
    return out.select("query_id", F.array_join("missing_entities", "|").alias("missing_entities"), F.array_join("missing_keywords", "|").alias("missing_keywords"))


def best_swap(spark, sf):
    """The first coverage swap of every query that has one."""
    return select.best_swap(masked(spark, sf))


def swap_loop(spark, sf):
    """What the coverage swaps change: sentences that come in or go out."""
    m = masked(spark, sf)
    after = select.swap_for_coverage(m).select("query_id", "sentence_id", F.col("selected").alias("after"), "swaps")
    return m.select("query_id", "sentence_id", "selected").join(after, ["query_id", "sentence_id"]).filter("selected <> after").select("query_id", "sentence_id", "after", "swaps")


def swapped(m: DataFrame) -> DataFrame:
    """The selection after the swaps, and how many there were."""
    after = select.swap_for_coverage(m).select("query_id", "sentence_id", F.col("selected").alias("after"), "swaps")
    return m.join(after, ["query_id", "sentence_id"], "left").withColumn("selected", F.coalesce("after", "selected")).drop("after")


def diversity_stats(spark, sf):
    """Coverage of each query's terms before and after the swaps; counts of terms are those of the lists, repeated ones included."""
    m = masked(spark, sf)
    done = materialize(swapped(m), "swapped")
    before = select.coverage(m).select("query_id", (F.col("covered_entities") + F.col("covered_keywords")).alias("coverage_before"))
    swaps = done.groupBy("query_id").agg(F.coalesce(F.max("swaps"), F.lit(0)).alias("sentence_swaps"))
    none = F.array().cast("array<string>")
    sizes = table(spark, sf, "queries").select("query_id", *[F.size(F.coalesce(k, none)).alias(f"query_{k}") for k in ("entities", "keywords")])
    out = select.coverage(done).join(before, "query_id").join(swaps, "query_id").join(sizes, "query_id").withColumn("coverage_after", F.col("covered_entities") + F.col("covered_keywords"))
    ratio = lambda k: F.when(F.col(f"query_{k}") > 0, F.round(F.col(f"covered_{k}") / F.col(f"query_{k}"), 6)).otherwise(1.0)
    lost = lambda k: F.array_join(f"missing_{k}", "|").alias(f"missing_{k}")
    return out.select("query_id", "query_entities", "covered_entities", ratio("entities").alias("coverage_ratio"), lost("entities"), "query_keywords", "covered_keywords", ratio("keywords").alias("keyword_coverage_ratio"), lost("keywords"),
                      "sentence_swaps", (F.col("coverage_after") > F.col("coverage_before")).alias("coverage_improved"), "coverage_before", "coverage_after", (F.col("coverage_after") - F.col("coverage_before")).alias("coverage_delta"))


def sufficiency(spark, sf):
    return select.expand(swapped(masked(spark, sf)).drop("swaps"), complexities(spark, sf)).withColumn("added", F.array_join("added", "|"))


def without_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scored sentences (query_id, sentence_id, text, score, doc_id ...) that are near copies of no better one, and all close pairs (grp, id, other, cosine)."""
    vectors = dense.dense_vectors(rows.select("sentence_id", "text").dropDuplicates(["sentence_id"]), "sentence_id", "text")
    s = rows.select("query_id", "sentence_id").join(vectors.withColumnRenamed("id", "sentence_id"), "sentence_id")
    pairs = materialize(dense.close_pairs(s, "query_id", "sentence_id", "vec", C.HASH_DIM, min(C.GRAPH_COSINE, C.DUPLICATE_SOFT)), "pairs")
    side = lambda key, doc: rows.select(F.col("query_id").alias("grp"), F.col("sentence_id").alias(key), F.col("doc_id").alias(doc))
    both = pairs.join(side("id", "da"), ["grp", "id"]).join(side("other", "db"), ["grp", "other"])
    bad = both.filter((F.col("cosine") >= C.DUPLICATE_EXACT) | ((F.col("cosine") >= C.DUPLICATE_SOFT) & F.col("da").eqNullSafe(F.col("db"))))
    nodes = rows.select(F.col("query_id").alias("grp"), F.col("sentence_id").alias("id"), F.struct((-F.col("score")).alias("s"), F.col("sentence_id").alias("i")).alias("prio"))
    kept = select.keep_greedily(nodes, bad.select("grp", F.col("id").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"grp": "query_id", "id": "sentence_id"})
    return rows.join(kept, ["query_id", "sentence_id"], "left_semi"), pairs


def evidence_of(rows: DataFrame, q: DataFrame) -> DataFrame:
    """Scored sentences (query_id, sentence_id, text, token_count, score, doc_id, position) to each query's evidence.

    Near copies go out by cosine, then bridges are found, the budget is filled, swapped for coverage and expanded.
    q has query, query_type, entities and keywords, none of them null.
    """
    rows, pairs = without_copies(materialize(rows, "scored"))
    rows = materialize(rows, "distinct")

    links = materialize(graph.incidences(rows.select(F.col("query_id").alias("grp"), F.col("sentence_id").alias("node"), "text")), "incidences")
    sources = links.join(query_concepts(q), ["grp", "concept"], "left_semi").select("grp", "node").distinct()
    ends = pairs.filter(F.col("cosine") >= C.GRAPH_COSINE).select("grp", F.col("id").alias("a"), F.col("other").alias("b"))
    for key in ("a", "b"):
        ends = ends.join(rows.select(F.col("query_id").alias("grp"), F.col("sentence_id").alias(key)), ["grp", key], "left_semi")
    on_path = graph.bridge_nodes(graph.bridges(links, sources, materialize(ends, "ends"))).select(F.col("grp").alias("query_id"), F.col("node").alias("sentence_id"), F.lit(True).alias("is_bridge"))
    rows = rows.join(on_path, ["query_id", "sentence_id"], "left").withColumn("is_bridge", F.coalesce("is_bridge", F.lit(False))).withColumn("n_chars", F.length("text"))

    m = materialize(select.with_masks(select.fit_budget(materialize(rows, "bridged"), q), q), "masked")
    m = materialize(swapped(m).drop("swaps"), "swapped")
    of = analyze.complexity(F.col("query"), F.size("entities"), F.size("keywords"))
    more = select.expand(m, q.select("query_id", "query_type", of.alias("complexity"))).select("query_id", F.explode("added").alias("sentence_id"), F.lit(True).alias("added"))
    out = m.join(more, ["query_id", "sentence_id"], "left").filter(F.col("selected") | F.col("added"))
    return out.select("query_id", "sentence_id", "text", "token_count", "score", "is_bridge")


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    """The questions, what their analysis lacks filled in by rule."""
    q = table(spark, sf, "queries")
    for c, own in (("query_type", analyze.query_type), ("entities", analyze.entities), ("keywords", analyze.keywords)):
        q = q.withColumn(c, F.coalesce(c, own(F.col("query"))))
    return q


def fused(spark: SparkSession, sf: str, q: DataFrame) -> DataFrame:
    """The fused hits of every question, by BM25 and by the hashing embedder."""
    index = sparse.stored(table(spark, sf, "retrieved_chunks"), chunks(spark, sf), "chunk_idx", "chunk_text")
    found = sparse.search(index, sparse.keyword_terms(q), 30)
    asked = q.select(F.col("query_id").alias("id"), T.index_tokens(F.col("query")).alias("tokens"))
    near = dense.hashed_top_k(asked, index.tokens.withColumn("id", F.col("id").cast("string")), 30)
    near = near.select(F.col("id").alias("query_id"), F.col("other").cast("bigint").alias("id"), F.col("cosine").alias("score"), "rank")
    return fusion.fuse(found, near, q).withColumnRenamed("id", "chunk_idx")


def scored(spark: SparkSession, sf: str, q: DataFrame) -> DataFrame:
    """The sentences of the hits with the weighted sum of their signals."""
    meta = table(spark, sf, "retrieved_chunks").groupBy("chunk_idx").agg(F.min("doc_id").alias("doc_id"), F.min("dataset").alias("dataset"), F.min("title").alias("title"), F.min("year").alias("year"))
    own = F.col("sentence")
    signals = {"evidence": score.evidence(own), "evidential": T.evidentiality(own), "density": score.density(own)}
    rows = segment.segment(fused(spark, sf, q).join(meta, "chunk_idx"), chunks(spark, sf), q, signals).join(q.select("query_id", "query", "query_type"), "query_id")
    five = [F.coalesce("faiss_score", F.lit(0.0)), F.col("evidence"), F.col("evidential"), F.col("density"), score.temporal(F.col("query"), F.col("year"))]
    rows = rows.withColumn("score", score.combined(F.col("query_type"), five))
    return rows.select("query_id", "sentence_id", "text", "token_count", "score", "doc_id", "position")


def retrieval_layer(spark, sf):
    """Questions to fused hits: both searches over all chunks, cut to the depths of the question's type."""
    out = fused(spark, sf, analysed(spark, sf))
    return out.select("query_id", "chunk_idx", F.col("rrf_rank").cast("int").alias("rrf_rank"), F.round("rrf_score", 9).alias("rrf_score"), (F.col("bm25_score") > 0).alias("sparse"), (F.col("faiss_score") > 0).alias("dense"))


def scoring_layer(spark, sf):
    """Questions to scored sentences without near copies."""
    rows, _ = without_copies(materialize(scored(spark, sf, analysed(spark, sf)), "scored"))
    return rows.select("query_id", "sentence_id", "token_count", "score")


def full_pipeline(spark, sf):
    """Questions to evidence: sparse and dense retrieval, fusion, sentences, signals, de-duplication, bridges, budget, coverage swaps, expansion."""
    q = analysed(spark, sf)
    return evidence_of(scored(spark, sf, q), q)


def token_counts(spark, sf):
    """Words and marks of every sentence, the count that stands in where no model's tokens are given."""
    return one_sentence(spark, sf).select("sentence_id", T.token_count(F.col("text")).alias("n_tokens"))


QUERIES = {f.__name__: f for f in [
    query_info, query_type, query_negation, query_keywords, query_entities, query_complexity, required_evidence, sentence_clean, plural_normalise, evidentiality, recency, segment_sentences, segment_drop_counts,
    sentence_objects, term_coverage, bm25_topk, dense_topk, hybrid_rrf, hash_embed, hash_similarity, evidence_density, multi_signal_score, cosine_pairs, greedy_dedup, concepts, concept_links, bridge_nodes, budget_fill, budget_stats,
    missing_terms, best_swap, swap_loop, diversity_stats, sufficiency, retrieval_layer, scoring_layer, full_pipeline, dense_shard_retrieve, layer_stats, token_counts,
]}

_Q = "q AS (SELECT query_id, query FROM queries UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('f{i:02d}', '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(FIXTURES)) + ") AS v(query_id, query))"
_NEG = f"({S.among(S.query_tokens('query'), C.NEGATION)} > 0 OR len(list_filter({S.query_tokens('query')}, lambda w: w LIKE '%n''t')) > 0)"
_NAMES = r"len(regexp_extract_all(regexp_replace(coalesce(text, ''), '^\S+', ''), '[A-Z][a-z0-9]+(?: [A-Z][a-z0-9]+)*'))"
_NUMBERS, _CAPS = S.counted("text", "[0-9][0-9.,]*"), S.counted("text", "[A-Z][a-z0-9]+")
_VERBS = r"len(regexp_extract_all(coalesce(lower(text), ''), '[a-z]+ed\b|[a-z]+ing\b|\b(?:is|are|was|were|has|have|had|be)\b'))"
_ALL, _WORDS = S.counted("text", r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"), S.counted("text", "[A-Za-z0-9]+")
_EVIDENCE = f"CASE WHEN {_ALL} > 0 THEN least(({_NAMES} + {_NUMBERS} + {_CAPS} + {_NUMBERS}) / {_ALL} * 2, 1.0) ELSE 0.0 END"
_DENSITY = f"CASE WHEN {_WORDS} > 0 THEN least(({_NAMES} + {_NUMBERS} + {_VERBS}) / {_WORDS}, 1.0) ELSE 0.0 END"
_EVIDENTIAL = {k: f"regexp_matches(text, '(?i){v}')" for k, v in C.EVIDENTIALITY.items()}
_SHARE = "(" + " + ".join(f"CAST({v} AS INT)" for v in _EVIDENTIAL.values()) + ") / 5.0"
_AGE = f"({C.CURRENT_YEAR} - year)"
_TEMPORAL = f"CASE WHEN regexp_matches(lower(query), '{C.TEMPORAL_INTENT}') AND coalesce(year, 0) <> 0 THEN CASE WHEN {_AGE} < 0 THEN 0.0 WHEN {_AGE} <= 2 THEN 1.0 WHEN {_AGE} <= 5 THEN 0.9 WHEN {_AGE} <= 10 THEN 0.7 WHEN {_AGE} <= 20 THEN 0.5 ELSE 0.3 END ELSE 0.0 END"
_HASH = "CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % " + str(C.HASH_DIM)


def _embed(name: str, key: str, text: str, source: str) -> str:
    return f"{name}_c AS (SELECT {key} AS id, {_HASH} AS bucket, count(*) AS n FROM (SELECT {key}, unnest({S.index_tokens(text)}) AS t FROM {source}) GROUP BY 1, 2), {name} AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY id)) AS norm FROM {name}_c)"


_SIM = f"""s AS {S.ONE_SENTENCE}, sj AS (SELECT sentence_id, concat_ws(' [SEP] ', query, text) AS joint FROM s JOIN queries USING (query_id)), {_embed('hq', 'query_id', 'query', 'queries')}, {_embed('hs', 'sentence_id', 'joint', 'sj')},
sim AS (SELECT s.query_id, s.sentence_id, round(sum(hq.n * hs.n) / (max(hq.norm) * max(hs.norm)), 9) AS cosine FROM s JOIN hq ON hq.id = s.query_id JOIN hs ON hs.id = s.sentence_id AND hs.bucket = hq.bucket GROUP BY 1, 2)"""
_VALID = f"v AS (SELECT * FROM {S.ONE_SENTENCE} WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
_BUDGET = f"""b AS (SELECT s.query_id, s.sentence_id, greatest(coalesce(s.token_count, {S.token_count('s.text')}), 0) AS n, CASE WHEN s.final_score IS NULL OR isnan(s.final_score) THEN 0.0 ELSE s.final_score END AS score, coalesce(s.force_include, false) AS br,
  {S.by_type('q.query_type', C.TOKEN_BUDGET)} AS budget FROM {S.ONE_SENTENCE} s JOIN queries q USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY br DESC, score DESC, sentence_id) AS k FROM b WHERE budget IS NOT NULL),
f AS (SELECT query_id, 0::BIGINT AS k, CAST(max(budget) AS BIGINT) AS rest, ''::VARCHAR AS sentence_id, false AS selected FROM r GROUP BY 1
  UNION ALL SELECT f.query_id, r.k, CASE WHEN r.n <= f.rest THEN f.rest - r.n ELSE f.rest END, r.sentence_id, r.n <= f.rest FROM f JOIN r ON r.query_id = f.query_id AND r.k = f.k + 1)"""

_RANKED = f"""tok AS (SELECT chunk_idx AS id, {S.index_tokens('chunk_text')} AS tokens FROM {S.CHUNKS}), len AS (SELECT id, len(tokens) AS dl FROM tok),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM tok) GROUP BY 1, 2), corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), corpus), terms AS (SELECT term, CASE WHEN raw < 0 THEN {C.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
kw AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.WORDS.format('lower(k)')}) AS term FROM (SELECT query_id, unnest(keywords) AS k FROM queries)) GROUP BY 1, 2),
sc AS (SELECT query_id, id, round(sum(qtf * idf * tf * {C.K1 + 1} / (tf + {C.K1} * ({1 - C.B} + {C.B} * dl / avgdl))), 6) AS score FROM kw JOIN terms USING (term) JOIN post USING (term) JOIN len USING (id), corpus GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0)"""

SQL = {
    "query_info": f"WITH {_Q} SELECT query_id, query, {S.query_type('query')} AS query_type, array_to_string(list_sort({S.keywords('query')}), '|') AS keywords, array_to_string(list_sort({S.entities('query')}), '|') AS entities, {_NEG} AS has_negation FROM q",
    "query_type": f"WITH {_Q} SELECT query_id, {S.query_type('query')} AS query_type FROM q",
    "query_negation": f"WITH {_Q} SELECT query_id, {_NEG} AS has_negation FROM q",
    "query_keywords": f"WITH {_Q} SELECT query_id, unnest({S.keywords('query')}) AS keyword FROM q",
    "query_entities": f"WITH {_Q} SELECT query_id, unnest({S.entities('query')}) AS entity FROM q",
    "query_complexity": f"SELECT query_id, query_type, CASE WHEN {S.word_count('query')} <= 5 AND coalesce(len(entities), 0) <= 1 AND coalesce(len(keywords), 0) <= 2 THEN 'low' WHEN {S.word_count('query')} <= 12 AND coalesce(len(entities), 0) <= 3 AND coalesce(len(keywords), 0) <= 5 THEN 'medium' ELSE 'high' END AS complexity FROM queries",
    "required_evidence": f"SELECT query_id, coalesce({S.by_type('query_type', C.MINIMUM_EVIDENCE)}, {C.DEFAULT_MINIMUM}) + CASE WHEN {S.word_count('query')} <= 12 AND coalesce(len(entities), 0) <= 3 AND coalesce(len(keywords), 0) <= 5 THEN 0 ELSE 1 END AS required FROM queries",
    "sentence_clean": f"SELECT sentence_id, md5(c) AS digest, length(c) = 0 OR regexp_matches(substr(c, 1, 1), '{C.FRAGMENT_START}') AS is_fragment, CAST({S.word_count('text')} AS INT) AS n_words FROM (SELECT sentence_id, text, {S.clean('text')} AS c FROM {S.ONE_SENTENCE} WHERE text IS NOT NULL)",
    "plural_normalise": f"SELECT sentence_id, md5(array_to_string(list_sort({S.term_set('text')}), ' ')) AS digest FROM {S.ONE_SENTENCE}",
    "evidentiality": f"SELECT sentence_id, {', '.join(f'{v} AS {k}' for k, v in _EVIDENTIAL.items())}, round({_SHARE}, 6) AS share FROM {S.ONE_SENTENCE} WHERE text IS NOT NULL",
    "recency": f"SELECT query_id, chunk_idx, year, {_TEMPORAL} AS signal FROM (SELECT DISTINCT query_id, chunk_idx, year FROM retrieved_chunks) JOIN queries USING (query_id)",
    "segment_sentences": f"SELECT chunk_idx, CAST(position - 1 AS INT) AS position, md5(s) AS digest, {S.verdict('s')} AS verdict FROM (SELECT chunk_idx, position, {S.clean('raw')} AS s FROM (SELECT chunk_idx, unnest(p) AS raw, generate_subscripts(p, 1) AS position FROM (SELECT chunk_idx, {S.parts('chunk_text')} AS p FROM {S.CHUNKS}))) WHERE length(s) > 0",
    "segment_drop_counts": f"SELECT {S.verdict('s')} AS verdict, count(*) AS n FROM (SELECT {S.clean('raw')} AS s FROM (SELECT unnest({S.parts('chunk_text')}) AS raw FROM {S.CHUNKS})) WHERE length(s) > 0 GROUP BY 1",
    "sentence_objects": f"""
WITH p AS (SELECT chunk_idx, position - 1 AS position, {S.clean('raw')} AS s FROM (SELECT chunk_idx, unnest(p) AS raw, generate_subscripts(p, 1) AS position FROM (SELECT chunk_idx, {S.parts('chunk_text')} AS p FROM {S.CHUNKS}))),
k AS (SELECT *, {S.lemmas(S.runs('s'))} AS lem FROM p WHERE length(s) > 0 AND {S.verdict('s')} = 'keep'),
h AS (SELECT query_id, chunk_idx, min(doc_id) AS doc_id, min(dataset) AS dataset FROM retrieved_chunks GROUP BY 1, 2)
SELECT h.query_id, concat_ws(':', h.dataset, h.doc_id, h.chunk_idx, k.position) AS sentence_id, CAST(k.position AS INT) AS position, CAST({S.word_count('k.s')} AS INT) AS token_count,
  len(list_filter(coalesce(q.entities, []), lambda e: e <> '' AND contains(lower(k.s), lower(e)))) > 0 OR list_has_any(coalesce(q.keywords, []), k.lem) AS contains_query_entity, md5(k.s) AS digest
FROM h JOIN k USING (chunk_idx) JOIN queries q ON q.query_id = h.query_id""",
    "term_coverage": f"""
WITH s AS (SELECT query_id, {S.term_set('text')} AS tok FROM {S.ONE_SENTENCE}),
t AS (SELECT DISTINCT query_id, 'e' AS kind, unnest(entities) AS term FROM queries UNION SELECT DISTINCT query_id, 'k', unnest(keywords) FROM queries),
u AS (SELECT query_id, kind, term, {S.term_set('term')} AS tt FROM t),
c AS (SELECT u.query_id, u.kind, u.term, max(CASE WHEN len(tt) > 0 AND list_has_all(s.tok, tt) THEN 1 ELSE 0 END) AS cov FROM u JOIN s USING (query_id) GROUP BY 1, 2, 3)
SELECT g.query_id, CAST(coalesce(sum(cov) FILTER (WHERE kind = 'e'), 0) AS INT) AS covered_entities, CAST(coalesce(sum(cov) FILTER (WHERE kind = 'k'), 0) AS INT) AS covered_keywords,
  CAST(count(*) FILTER (WHERE kind = 'e' AND cov = 0) AS INT) AS n_missing_entities, CAST(count(*) FILTER (WHERE kind = 'k' AND cov = 0) AS INT) AS n_missing_keywords
FROM (SELECT DISTINCT query_id FROM s JOIN queries USING (query_id)) g LEFT JOIN c ON c.query_id = g.query_id GROUP BY 1""",
    "bm25_topk": f"WITH {_RANKED} SELECT query_id, id AS chunk_idx, score, rank FROM rk WHERE rank <= 15",
    "dense_topk": f"""
WITH s AS (SELECT a.vec_id, b.vec_id AS other_id, round({S.cosine('a.embedding', 'b.embedding')}, 9) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, other_id, round(c, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other_id) AS rank FROM s) WHERE rank <= 15""",
    "hybrid_rrf": f"""
WITH h AS (SELECT query_id, chunk_idx, any_value(bm25_score) AS b, any_value(faiss_score) AS f FROM retrieved_chunks GROUP BY 1, 2),
d AS (SELECT query_id, {S.by_type("coalesce(query_type, 'factoid')", {k: v[0] for k, v in C.DEPTHS.items()})} AS ds, {S.by_type("coalesce(query_type, 'factoid')", {k: v[2] for k, v in C.DEPTHS.items()})} AS df FROM queries),
sp AS (SELECT query_id, chunk_idx, b, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, chunk_idx) AS sr FROM h WHERE b > 0 AND NOT isnan(b)),
de AS (SELECT query_id, chunk_idx, f, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, chunk_idx) AS dr FROM h WHERE f > 0 AND NOT isnan(f)),
j AS (SELECT query_id, chunk_idx, CASE WHEN sr <= ds THEN sr END AS sr, CASE WHEN dr <= ds THEN dr END AS dr, b, f, df FROM sp FULL OUTER JOIN de USING (query_id, chunk_idx) JOIN d USING (query_id)),
k AS (SELECT *, coalesce(1.0::DOUBLE / ({C.RRF_K} + sr), 0.0) + coalesce(1.0::DOUBLE / ({C.RRF_K} + dr), 0.0) AS rrf FROM j WHERE sr IS NOT NULL OR dr IS NOT NULL)
SELECT query_id, chunk_idx, round(rrf, 9) AS rrf_score, rrf_rank, round(CASE WHEN sr IS NOT NULL THEN b ELSE 0.0 END, 6) AS bm25_score, round(CASE WHEN dr IS NOT NULL THEN f ELSE 0.0 END, 6) AS faiss_score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, sr NULLS LAST, dr NULLS LAST, chunk_idx) AS rrf_rank FROM k) WHERE rrf_rank <= df""",
    "hash_embed": f"WITH {_embed('h', 'doc_id', 'text', 'documents')} SELECT id AS doc_id, bucket, n, round(norm, 6) AS norm FROM h",
    "hash_similarity": f"WITH {_SIM} SELECT * FROM sim",
    "evidence_density": f"SELECT sentence_id, round({_EVIDENCE}, 6) AS evidence, round({_DENSITY}, 6) AS density FROM {S.ONE_SENTENCE}",
    "multi_signal_score": f"""WITH {_SIM},
x AS (SELECT s.query_id, s.sentence_id, s.text, s.year, q.query, coalesce(q.query_type, {S.query_type('q.query')}) AS qt, coalesce(sim.cosine, 0.0) AS c FROM s JOIN queries q USING (query_id) LEFT JOIN sim USING (query_id, sentence_id)),
y AS (SELECT *, c AS s0, {_EVIDENCE} AS s1, {_SHARE} AS s2, {_DENSITY} AS s3, {_TEMPORAL} AS s4 FROM x)
SELECT query_id, sentence_id, floor(({' + '.join(f"{S.by_type('qt', {k: w[i] for k, w in C.WEIGHTS.items()})}::DOUBLE * s{i}" for i in range(5))}) * 10000 + 0.5000001) / 10000 AS score FROM y""",
    "cosine_pairs": f"WITH {_VALID} SELECT a.query_id, a.sentence_id AS sentence_a, b.sentence_id AS sentence_b, round({S.cosine('a.embedding', 'b.embedding')}, 6) AS cosine FROM v a JOIN v b ON a.query_id = b.query_id AND a.sentence_id < b.sentence_id WHERE {S.cosine('a.embedding', 'b.embedding')} >= {C.GRAPH_COSINE}",
    "greedy_dedup": f"""
WITH RECURSIVE {_VALID}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN final_score IS NULL OR isnan(final_score) THEN 0.0 ELSE final_score END DESC, sentence_id) AS k FROM v),
p AS (SELECT a.query_id, b.sentence_id, a.sentence_id AS other, {S.cosine('a.embedding', 'b.embedding')} AS c, a.doc_id AS da, b.doc_id AS db FROM n a JOIN n b ON a.query_id = b.query_id AND a.k < b.k),
bad AS (SELECT query_id, sentence_id, list(other) AS others FROM p WHERE c >= {C.DUPLICATE_EXACT} OR (c >= {C.DUPLICATE_SOFT} AND da = db) GROUP BY 1, 2),
m AS (SELECT n.query_id, n.k, n.sentence_id, coalesce(bad.others, []) AS others FROM n LEFT JOIN bad ON bad.query_id = n.query_id AND bad.sentence_id = n.sentence_id),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS k, []::VARCHAR[] AS kept FROM m UNION ALL SELECT f.query_id, m.k, CASE WHEN list_has_any(f.kept, m.others) THEN f.kept ELSE list_append(f.kept, m.sentence_id) END FROM f JOIN m ON m.query_id = f.query_id AND m.k = f.k + 1)
SELECT query_id, unnest(kept) AS sentence_id FROM (SELECT query_id, arg_max(kept, k) AS kept FROM f GROUP BY 1)""",
    "concepts": rf"""SELECT query_id, sentence_id, unnest(list_distinct(list_filter(list_concat(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '^\S+', ''), '[A-Z][A-Za-z0-9]+'), lambda x: lower(x)),
  {S.lemmas("regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}')")}), lambda w: NOT list_contains({S.listed(analyze.FUNCTION_WORDS)}, w)))) AS concept FROM {S.ONE_SENTENCE}""",
    "budget_fill": f"WITH RECURSIVE {_BUDGET} SELECT query_id, sentence_id, selected FROM f WHERE k > 0",
    "budget_stats": f"""WITH RECURSIVE {_BUDGET}
SELECT r.query_id, max(r.budget) AS budget, CAST(sum(CASE WHEN f.selected THEN r.n ELSE 0 END) AS BIGINT) AS tokens_used, count(*) AS n_input, count(*) FILTER (WHERE f.selected) AS n_selected, count(*) FILTER (WHERE f.selected AND r.br) AS bridge_selected,
  count(*) FILTER (WHERE f.selected AND NOT r.br) AS non_bridge_selected, CAST(max(r.budget) - sum(CASE WHEN f.selected THEN r.n ELSE 0 END) AS BIGINT) AS tokens_remaining FROM r JOIN f ON f.query_id = r.query_id AND f.k = r.k GROUP BY 1""",
    "missing_terms": f"""
WITH RECURSIVE {_BUDGET}, sel AS (SELECT query_id, sentence_id FROM f WHERE selected), s AS (SELECT x.query_id, {S.term_set('x.text')} AS tok FROM {S.ONE_SENTENCE} x JOIN sel ON sel.query_id = x.query_id AND sel.sentence_id = x.sentence_id),
t AS (SELECT DISTINCT query_id, 'e' AS kind, unnest(entities) AS term FROM queries UNION SELECT DISTINCT query_id, 'k', unnest(keywords) FROM queries), u AS (SELECT query_id, kind, term, {S.term_set('term')} AS tt FROM t),
c AS (SELECT u.query_id, u.kind, u.term, coalesce(max(CASE WHEN len(tt) > 0 AND list_has_all(s.tok, tt) THEN 1 ELSE 0 END), 0) AS cov FROM u LEFT JOIN s USING (query_id) GROUP BY 1, 2, 3)
SELECT g.query_id, coalesce(string_agg(term, '|' ORDER BY term) FILTER (WHERE kind = 'e' AND cov = 0), '') AS missing_entities, coalesce(string_agg(term, '|' ORDER BY term) FILTER (WHERE kind = 'k' AND cov = 0), '') AS missing_keywords
FROM (SELECT DISTINCT query_id FROM r) g LEFT JOIN c ON c.query_id = g.query_id GROUP BY 1""",
}

SQL["greedy_dedup"] = f"SELECT query_id, sentence_id FROM ({SQL['greedy_dedup']}) UNION ALL SELECT query_id, sentence_id FROM {S.ONE_SENTENCE} WHERE sentence_id NOT IN (WITH {_VALID} SELECT sentence_id FROM v)"
SQL["bridge_nodes"] = X.bridge_nodes(X.cosine_edges(_VALID))
SQL["concept_links"] = f"WITH {X.graph(X.cosine_edges(_VALID))} SELECT grp AS query_id, concept, count(*) AS n_sentences, count(*) * (count(*) - 1) // 2 AS n_pairs FROM inc GROUP BY 1, 2 HAVING count(*) > 1"
SQL |= {"best_swap": X.best_swap(_BUDGET), "swap_loop": X.swap_loop(_BUDGET), "diversity_stats": X.diversity_stats(_BUDGET), "sufficiency": X.sufficiency(_BUDGET)}
SQL["dense_shard_retrieve"] = f"WITH top AS ({SQL['dense_topk']}), pos AS (SELECT vec_id AS other_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 128 AS INT) AS shard FROM embeddings) SELECT vec_id, rank, other_id, shard FROM top JOIN pos USING (other_id)"
_FIGURES = {
    "budget": ["budget", "tokens_used", "n_input", "n_selected", "bridge_selected", "non_bridge_selected", "tokens_remaining"],
    "diversity": ["query_entities", "covered_entities", "query_keywords", "covered_keywords", "sentence_swaps", "coverage_improved", "coverage_before", "coverage_after", "coverage_delta"],
    "sufficiency": ["sufficient", "coverage_complete", "minimum_met", "bridge_met", "required", "n_selected", "n_added", "expansion_limit", "n_terms"],
}
SQL["layer_stats"] = " UNION ALL ".join(
    f"SELECT query_id, '{layer}' AS layer, metric, value FROM (SELECT query_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in names)} FROM ({SQL[query]})) UNPIVOT (value FOR metric IN ({', '.join(names)}))"
    for (layer, names), query in zip(_FIGURES.items(), ["budget_stats", "diversity_stats", "sufficiency"])
)
_PARTS = (_RANKED, _embed, _EVIDENCE.replace("text", "p.text"), _SHARE.replace("text", "p.text"), _DENSITY.replace("text", "p.text"), _TEMPORAL)
SQL |= {"retrieval_layer": X.retrieval_layer(*_PARTS[:2]), "scoring_layer": X.scoring_layer(*_PARTS), "full_pipeline": X.pipeline(_BUDGET, *_PARTS)}
SQL["token_counts"] = f"SELECT sentence_id, CAST({S.token_count('text')} AS INT) AS n_tokens FROM {S.ONE_SENTENCE}"
