"""Both searches in blocks against plain loops, and that pairs of questions and documents are not listed."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight import config as C
from sievelight.operators import dense, sparse


def shuffled(spark) -> int:
    """Records that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def ranked(scores: dict, k: int, places: int) -> list[tuple]:
    rounded = {i: round(s, places) for i, s in scores.items()}
    return [(i, s, r + 1) for r, (i, s) in enumerate(sorted(((i, s) for i, s in rounded.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k])]


def test_a_frequent_term_is_not_met_pair_by_pair(spark):
    docs = spark.range(2000).select("id", F.concat(F.lit("trade "), F.repeat(F.lit("mill "), F.expr("int(id % 7)")), F.concat(F.lit("w"), F.col("id") % 50)).alias("text"))
    terms = spark.range(300).select(F.concat(F.lit("q"), "id").alias("query_id"), F.explode(F.array(F.lit("trade"), F.concat(F.lit("w"), F.col("id") % 50))).alias("term"), F.lit(1).alias("qtf"))
    index = sparse.Index.build(docs, "id", "text")
    before = shuffled(spark)
    got = sparse.search(index, terms, 5).count()
    assert got == 1500 and shuffled(spark) - before < 100_000  # 600,000 pairs


@pytest.mark.parametrize("tile", [sparse.TILE, (3, 40)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_search_equals_a_loop(spark, tile, kind):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)]
    said = {k: [words[i] for i in np.minimum(rng.geometric(0.15, int(rng.integers(0, 25))), 30) - 1] for k in range(90)}
    asked = {f"q{k}": Counter({w: int(rng.integers(1, 3)) for w in rng.choice(words + ["unknown"], 4, replace=False)}) for k in range(20)}
    n, mean = len(said), sum(map(len, said.values())) / len(said)
    df = Counter(w for s in said.values() for w in set(s))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: r if r >= 0 else C.EPSILON * sum(raw.values()) / len(raw) for w, r in raw.items()}
    gain = lambda tf, dl: tf * (C.K1 + 1) / (tf + C.K1 * (1 - C.B + C.B * dl / mean))
    name = (lambda k: k) if kind == "long" else str
    want = {(q, *hit) for q, t in asked.items() for hit in ranked({name(k): sum(m * idf[w] * gain(s.count(w), len(s)) for w, m in t.items() if w in s) for k, s in said.items()}, 6, 6)}
    index = sparse.Index.build(spark.createDataFrame([(name(k), " ".join(s)) for k, s in said.items()], f"id {kind}, text string"), "id", "text")
    got = sparse.search(index, spark.createDataFrame([(q, w, m) for q, t in asked.items() for w, m in t.items()], "query_id string, term string, qtf long"), 6, tile=tile)
    assert {(r.query_id, r.id, r.score, r["rank"]) for r in got.collect()} == want and got.count() == len(want)


def by_loop(asked, said, k, dim):
    of = lambda t: np.bincount(np.asarray(t, int), minlength=dim)
    vectors = [of(t) for t in said]
    for t in asked:
        q = of(t)
        yield ranked({j: float(q @ v / (np.sqrt(q @ q) * np.sqrt(v @ v))) for j, v in enumerate(vectors) if v.any()}, k, 9)


@pytest.mark.parametrize("held", [dense.HELD, 17])
def test_nearest_equals_a_loop(held):
    rng = np.random.default_rng(6)
    dim, k = 24, 7
    said = [rng.integers(0, dim, int(n)) for n in rng.integers(1, 40, 150)] + [np.array([3])] * 12 + [np.repeat([5, 6], [300, 2]), np.repeat(np.arange(dim), 40)]
    asked = [rng.integers(0, dim, int(n)) for n in rng.integers(1, 9, 30)] + [np.array([3]), np.repeat([5], 4), np.repeat(np.arange(dim), 5), rng.integers(0, 2, 200)]
    asked, said = ([np.asarray(t, np.uint8) for t in x] for x in (asked, said))
    texts = np.concatenate(said), np.cumsum([0, *map(len, said)])
    squares = np.array([np.square(np.bincount(t)).sum() for t in said])
    got = dense.nearest(asked, texts, squares, dim, k, held)
    for (at, cosine), want in zip(got, by_loop(asked, said, k, dim)):
        assert [(a, round(c, 9), r + 1) for r, (a, c) in enumerate(zip(at.tolist(), cosine.tolist()))] == want


@pytest.mark.parametrize("tile", [dense.HASHED_TILE, (4, 15)])
def test_hashed_top_k_equals_the_products_of_the_vectors(spark, tile):
    rng = np.random.default_rng(7)
    text = lambda most: " ".join(f"t{i}" for i in rng.integers(0, 60, int(rng.integers(0, most))))
    queries, docs = ([(f"{p}{k}", text(n)) for k in range(m)] for p, m, n in (("q", 14, 6), ("", 70, 30)))
    q, d = (spark.createDataFrame(rows + [("none", None)], "id string, text string") for rows in (queries, docs))
    exact = dense.top_k(dense.dense_vectors(q, "id", "text"), dense.dense_vectors(d, "id", "text"), C.HASH_DIM, 5).filter("cosine > 0")
    tokens = lambda x: x.select("id", dense.T.index_tokens(F.col("text")).alias("tokens"))
    got = dense.hashed_top_k(tokens(q), tokens(d), 5, tile=tile)
    columns = ["id", "other", "cosine", "rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, exact.select(columns).collect())) != []
