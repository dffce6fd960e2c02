import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import knn

DIM = 16


def make(seed=1, n=600):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, DIM))
    for i in range(0, n, 3):  # a near copy for every third
        x[i] = x[(i * 7 + 1) % n] + rng.normal(size=DIM) * 0.15
    x[10] = x[11] = x[12]
    rows = [(f"s{i:04d}", [float(v) for v in r * (1 + i % 5)], "x") for i, r in enumerate(x)]
    bad = [("n1", None, ""), ("n2", [1.0] * (DIM - 1), ""), ("n3", [float("nan")] * DIM, ""), ("n4", [0.0] * DIM, ""), ("n5", [], ""), (None, [1.0] * DIM, "")]
    return rows, bad


def truth(rows, k, least):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out[ids[i]] = [(ids[j], s[i, j]) for j in order if s[i, j] >= least]
    return out


@pytest.mark.parametrize(("tile", "more"), [(4096, {}), (150, {}), (4096, {"cells": 24, "first_cells": 6})])
def test_near_pairs(spark, tile, more):
    rows, bad = make()
    df = spark.createDataFrame(rows + bad + rows[:40], "id string, v array<double>, cosine string")
    got = {}
    for r in knn.nearest(df, "id", "v", DIM, 5, 0.8, tile=tile, **more).collect():
        got.setdefault(r.id, []).append((r.place, r.other, r.cosine))
    want = {k: v for k, v in truth(rows, 5, 0.8).items() if v}
    pairs = {(a, b) for a, v in want.items() for b, _ in v}
    found = {(a, b) for a, v in got.items() for _, b, _ in v}
    assert len(pairs & found) >= 0.97 * len(pairs) and all(len(v) <= 5 for v in got.values())
    cos = {(a, b): c for a, v in truth(rows, 600, -1).items() for b, c in v}
    assert all(abs(cos[a, b] - c) < 1e-5 and c >= 0.8 - 1e-6 for a, v in got.items() for _, b, c in v)


def test_top_k_of_a_query_set(spark):
    rows, bad = make(2)
    df = spark.createDataFrame(rows + bad, "id string, v array<double>, ask string")
    got = {}
    for r in knn.nearest_of(df, F.col("id").endswith("7"), "id", "v", DIM, 5, tile=200).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = {k: {b for b, _ in v} for k, v in truth(rows, 5, -2).items() if k.endswith("7")}
    assert got.keys() == want.keys()
    assert sum(len(got[k] & want[k]) for k in want) >= 0.9 * 5 * len(want)


def test_nothing_usable(spark):
    _, bad = make()
    df = spark.createDataFrame(bad, "id string, v array<double>, x string")
    assert knn.nearest(df, "id", "v", DIM).collect() == [] and knn.nearest(df.limit(0), "id", "v", DIM).collect() == []
    assert knn.nearest_of(df, F.lit(True), "id", "v", DIM).collect() == []


def test_codes_keep_the_vector():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = knn.Quantiser(x, 16, len(x), 4096)
    codes, norm, fit = model.encode(x)
    sums = sum(b[codes[:, m]] for m, b in enumerate(model.books))
    assert np.allclose(np.linalg.norm(sums, axis=1), norm, atol=1e-4) and fit.mean() > 0.9
    assert np.allclose(model.scores(x[:5], codes, norm), x[:5] @ (sums / norm[:, None]).T, atol=1e-4)


def test_equal_vectors_go_by_their_ids(spark):
    rows = [(f"e{i:03d}", [1.0, 2.0] + [0.0] * (DIM - 2)) for i in range(300)] + [(f"o{i:03d}", [float(i % 7), -3.0] + [1.0] * (DIM - 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    of = {}
    for r in knn.nearest_of(df, F.col("id").startswith("e29"), "id", "v", DIM, 5).collect():
        of.setdefault(r.id, []).append((r.place, r.other))
    assert len(of) == 10 and all([o for _, o in sorted(v)] == [f"e{i:03d}" for i in range(5)] for v in of.values())


def test_highest_scores_of_equal_ones_the_first():
    score = np.array([[3, 5, 5, 5, 1], [-np.inf, 2, -np.inf, 2, -np.inf], [0, 0, 0, 0, 0]], float)
    a, b = knn.best_scored(score, 2)
    assert list(zip(a.tolist(), b.tolist())) == [(0, 1), (0, 2), (1, 1), (1, 3), (2, 0), (2, 1)]


def test_cells_are_parted_by_a_second_codebook():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = knn.Quantiser(x, 64, 100_000, 4096, first_cells=8)
    cells = model.nearest_cells(x, 3)
    assert cells.shape == (3000, 3) and cells.max() < 64 and len(np.unique(cells[:, 0])) > 40
    centre = np.array([model.books[0][c // len(model.parts)] + model.parts[c % len(model.parts)] for c in range(64)])
    exact = ((x[:, None] - centre) ** 2).sum(2).argmin(1)
    assert (exact == cells[:, 0]).mean() > 0.9


def test_many_cells_part_no_near_copies(spark):
    """As many cells as a large table has, in which near copies fall into neighbouring ones."""
    rng, dim = np.random.default_rng(6), 96
    x = rng.normal(size=(2400, dim))
    for i in range(0, 2400, 2):
        x[i] = x[i + 1] + rng.normal(size=dim) * rng.uniform(0.3, 0.6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.triu(x @ x.T, 1)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.8))}
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    found = {(min(r.id, r.other), max(r.id, r.other)) for r in knn.nearest(df, "id", "v", dim, 5, 0.8, cells=400).collect()}
    assert found <= want and len(want) > 1000 and len(found) >= 0.995 * len(want)


def test_more_near_vectors_than_places(spark):
    """The most similar ones come out however many vectors of a tile come near, equal vectors among them."""
    rng, dim = np.random.default_rng(9), 48
    x = np.concatenate([rng.normal(size=dim) + rng.normal(size=(700, dim)) * 0.35, rng.normal(size=(300, dim))])
    x[600:640] = x[600]
    rows = [(f"s{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)]
    got = {}
    for r in knn.nearest(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", dim, 5, 0.8).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    want = truth(rows, 5, 0.8)
    assert sum(len(v) for v in want.values()) > 3000
    missed = sum(len({b for b, _ in v} - {b for _, b in got.get(a, [])}) for a, v in want.items())
    assert missed <= 0.001 * sum(len(v) for v in want.values())
