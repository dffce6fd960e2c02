import os
import uuid

import pytest
from pyspark.sql import functions as F

from sievelight import runtime
from sievelight.functions import text as T
from sievelight.operators import analyze, control, dense, ingest, segment, sparse, validate
from sievelight.plans.retrieval_queries import FIXTURES
from sievelight.sources import tables
from sievelight.streaming import events
from sievelight.streaming import ingest as streaming


def test_schema_detection(spark):
    df = spark.createDataFrame([("q", "a", "t")], "My_Question string, answer string, page_title string")
    assert tables.inspect_schema(df, ["question", "answers"])["question"] == "My_Question"
    with pytest.raises(tables.SchemaError, match="context"):
        tables.inspect_schema(df, ["question", "context"])
    with pytest.raises(tables.SchemaError):
        tables.require_columns(df, ["answer", "x"])


def test_shards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.discover_shards(spark, str(tmp_path / "none"))
    with pytest.raises(LookupError):
        tables.discover_shards(spark, str(tmp_path))
    spark.createDataFrame([(1, "a"), (2, None)], "id int, chunk string").coalesce(1).write.parquet(str(tmp_path / "s"))
    (tmp_path / "s" / "broken.parquet").write_bytes(b"no parquet")
    assert len(tables.discover_shards(spark, str(tmp_path / "s"), "*.parquet")) == 2
    rows, rejected, unreadable = tables.load_shards(spark, str(tmp_path / "s"), "id int, chunk string", "chunk")
    assert [r.shard for r in unreadable.collect()] == ["broken.parquet"]
    assert [r.id for r in rows.collect()] == [1] and sum(r.n_rejected for r in rejected.collect()) == 1
    assert tables.read_or_empty(spark, str(tmp_path / "no"), "id int").count() == 0
    with pytest.raises(Exception, match="has not 2 values"):
        tables.with_dimension(spark.createDataFrame([([1.0],)], "v array<double>"), "v", 2).collect()


def test_stream_commits_batches_once(spark, tmp_path):
    schema = "doc_id bigint, text string, dataset string, title string, row_idx bigint"
    first = [(1, "alpha text", "nq", "", 0), (2, "alpha text", "wiki", "", 1), (3, " ", "nq", "", 2)]
    second = [(1, "alpha text", "nq", "", 0), (4, "beta " * 400, "trivia", "", 3)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streaming.ingest_stream(spark, src, schema, out).awaitTermination()
    docs = {r.doc_id: r.batch_idx for r in streaming.documents(spark, out).collect()}
    assert docs == {1: 0, 4: 1}
    streaming.commit(spark.createDataFrame(second, schema), 1, out)  # a retry of a committed batch
    assert streaming.documents(spark, out).count() == 2 and {r.n_documents for r in streaming.manifest(spark, out).collect()} == {1}
    starts = [r.char_start for r in spark.read.parquet(f"{out}/chunks").filter("batch_idx = 1").orderBy("char_start").collect()]
    assert starts == [0, 700, 1400]


def test_windowed_counts_on_a_stream(spark, tmp_path):
    rows = [("2025-01-01 00:10:00", "a"), ("2025-01-01 00:50:00", "a"), ("2025-01-01 01:10:00", "b")]
    df = spark.createDataFrame(rows, "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type")
    batch = {(str(r.window_start), r.kind, r.n) for r in events.windowed_counts(df).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = events.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.window_start), r.kind, r.n) for r in spark.table("counted").collect()} == batch and len(batch) == 2


def test_known_questions(spark):
    rows = {r.query: r for r in analyze.analyze(spark.createDataFrame([(str(i), q) for i, q in enumerate(FIXTURES)], "query_id string, query string")).collect()}
    kinds = ["factoid", "factoid", "descriptive", "multi_hop", "multi_hop", "factoid", "factoid", "descriptive", "multi_hop", "multi_hop", "multi_hop", "multi_hop"]
    assert [rows[q].query_type for q in FIXTURES[:12]] == kinds
    negative = [rows[q].has_negation for q in FIXTURES[12:15]]
    assert negative == [True] * 3 and not rows[FIXTURES[0]].has_negation and rows[FIXTURES[16]].has_negation
    assert "not" not in rows[FIXTURES[12]].keywords and {"telephone", "invent"} & set(rows["Who invented telephones?"].keywords)


def test_segmentation_cases(spark):
    text = "Alexander Graham Bell invented the telephone in Boston. short one. The cat sat on the mat today.\nno capital here at all now"
    chunks = spark.createDataFrame([(42, text)], "chunk_idx long, chunk_text string")
    hits = spark.createDataFrame([("q", 42, 3, 0.05, 1.0, 0.8, "doc_001", "wiki", "T", 2020)], "query_id string, chunk_idx long, rrf_rank int, rrf_score double, bm25_score double, faiss_score double, doc_id string, dataset string, title string, year int")
    q = spark.createDataFrame([("q", ["Alexander Graham Bell"], ["invent"])], "query_id string, entities array<string>, keywords array<string>")
    rows = segment.segment(hits, chunks, q).orderBy("position").collect()
    assert [r.contains_query_entity for r in rows] == [True, False] and rows[0].sentence_id == "wiki:doc_001:42:0" and rows[0].retrieval_rank == 3
    assert [r.f for r in spark.createDataFrame([("A b",), ("lower",), ("• x",), ("– x",), ("",)], "t string").select(T.is_fragment(F.col("t")).alias("f")).collect()] == [False, True, True, True, True]
    with pytest.raises(ValueError):
        ingest.chunk_windows(chunks, ["chunk_idx"], "chunk_text", 10, 10)


def test_chunk_edges_and_ids(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([0, 1, 700, 701, 800, 1500])], "doc_id long, text string")
    got = ingest.chunk_windows(df, ["doc_id"]).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    ids = ingest.dense_ids(df.repartition(3), ["doc_id"], "n", 10).orderBy("doc_id").collect()
    assert [r.n for r in ids] == list(range(10, 16))


@pytest.mark.parametrize("tile", [4096, 7])
def test_pairs_in_tiles(spark, tile):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    rows = [("g", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("h", 100, [1.0] * 5), ("g", 41, [0.0] * 5), ("g", 42, None), ("g", 43, [1.0])]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    got = {(r.id, r.other) for r in dense.close_pairs(df, "g", "id", "v", 5, 0.5, tile).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.5}
    v = df.filter("g = 'g'").selectExpr("id", "v AS vec")
    top = {(r.id, r.other) for r in dense.top_k(v.filter("id < 5"), v, 5, 3, tile).collect()}
    np.fill_diagonal(s, -2)
    assert top == {(i, int(j)) for i in range(5) for j in np.argsort(-s[i])[:3]}


def test_written_tables_are_forgotten_and_values_stored_once(spark):
    rows = runtime.materialize(spark.range(5), "five")
    path = rows.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(path) and rows.count() == 5
    assert runtime.forget(spark) >= 1 and not os.path.exists(path)
    made = []
    make = lambda: made.append(1) or {"a": list(range(3))}
    key = f"value-{uuid.uuid4().hex}"
    assert runtime.stored(spark, key, make) == runtime.stored(spark, key, make) == {"a": [0, 1, 2]} and made == [1]


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://head:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        runtime.checkpoint_dir(Cluster)


def test_a_batch_whose_parts_disagree_is_not_committed(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    chunks = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], streaming.CHUNKS)
    vectors = spark.createDataFrame([("a", 0, [1.0]), ("b", 0, [0.0])], streaming.VECTORS)
    assert streaming.verify(docs, chunks, vectors) == (2, 2)
    with pytest.raises(streaming.AlignmentError, match="vectors"):
        streaming.verify(docs, chunks, vectors.limit(1))
    with pytest.raises(streaming.AlignmentError, match="no document"):
        streaming.verify(docs.filter("document_id = 'a'"), chunks, vectors)


def test_fewer_rows_than_were_committed_are_an_error(spark):
    rows, man = spark.range(5).withColumnRenamed("id", "pos"), spark.createDataFrame([(0, 0, 4)], "batch_idx int, vec_start long, vec_end long")
    assert control.truncate_orphans(rows, man).count() == 4
    with pytest.raises(Exception, match="rows are missing"):
        control.truncate_orphans(rows.limit(3), man).collect()


def test_inputs_are_validated(spark):
    good = "query_id string, query string, query_type string, entities array<string>, keywords array<string>"
    with pytest.raises(ValueError, match="keywords"):
        validate.query_faults(spark.createDataFrame([], good.replace(", keywords array<string>", "")))
    with pytest.raises(TypeError, match="entities"):
        validate.query_faults(spark.createDataFrame([], good.replace("entities array<string>", "entities string")))
    rows = [("a", "Who?", "factoid", [], []), ("b", " ", "odd", None, []), ("c", None, None, [], None)]
    got = {(r.key, r.problem) for r in validate.query_faults(spark.createDataFrame(rows, good)).collect()}
    assert got == {("b", "no question"), ("b", "unknown type"), ("b", "no entities"), ("c", "no question"), ("c", "no type"), ("c", "no keywords")}


def test_search_by_shuffle_equals_search_by_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(["mill", "river", f"w{k % 7}"][: 1 + k % 3] * (1 + k % 2))) for k in range(40)] + [(99, None)], "id int, text string")
    built = sparse.Index.build(docs, "id", "text")
    terms = spark.createDataFrame([("q", "river", 1), ("q", "w3", 2), ("p", "mill", 1), ("p", "w5", 1)], "query_id string, term string, qtf long")
    want = sorted(map(tuple, sparse.search(built, terms, 5).collect()))
    loaded = built.save(str(tmp_path / "index"))
    assert want and want == sorted(map(tuple, sparse.search(loaded, terms, 5, sent_terms=0).collect()))


def test_questions_of_two_clauses_and_entities(spark):
    rows = spark.createDataFrame([("Who painted the hall and repaired it?",), ("Who painted the hall?",), ("What was painted in May?",), ("Name of The Beatles and the BEATLES and Abba",)], "q string")
    q = F.col("q")
    got = rows.select(analyze.query_type(q).alias("t"), analyze.entities(q).alias("e")).collect()
    assert [r.t for r in got[:3]] == ["multi_hop", "factoid", "factoid"] and got[3].e == ["Beatles", "Abba"]


def test_equal_vectors_are_ranked_by_id(spark):
    v = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(60)] + [(k, [0.0, 1.0]) for k in range(60, 70)], "id long, vec array<double>")
    got = dense.top_k(v.filter("id >= 55 AND id < 58"), v, 2, 4).collect()
    assert len(got) == 12 and all(r.other == r["rank"] - 1 for r in got)


def test_close_pairs_in_one_block_and_in_many(spark):
    rows = [("g" if k % 5 else "h", f"i{k:03d}", [1.0, (k % 13) / 10.0, (k % 7) / 5.0]) for k in range(60)] + [("g", "zero", [0.0, 0.0, 0.0]), ("g", "nan", [1.0, float("nan"), 0.0]), ("g", "short", [1.0])]
    df = spark.createDataFrame(rows, "q string, id string, v array<float>")
    one, many = (sorted(map(tuple, dense.close_pairs(df, "q", "id", "v", 3, 0.95, tile=tile).collect())) for tile in (4096, 7))
    assert one == many and len(one) == len(set(r[1:3] for r in one)) > 100 and all(a < b for _, a, b, _ in one)
