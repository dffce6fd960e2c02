"""The selection of the whole pipeline against a sequential version on a small fixture."""

import random

import numpy as np
from pyspark.sql import functions as F

from sievelight import config as C
from sievelight.operators import analyze, dense, graph, select
from sievelight.plans.retrieval_queries import evidence_of

QUERY = "Which mill did Arkwright and Strutt build near Cromford?"
COLUMNS = "query_id string, sentence_id string, text string, token_count int, score double, doc_id string, position int"


def fixture():
    rng = random.Random(3)
    names, words = ["Arkwright", "Strutt", "Cromford", "Derwent", "Belper", "Lumford"], ["spinning", "water", "frame", "building", "river", "cotton", "owner", "village", "trade", "bridge", "engine", "market"]
    rows = []
    for k in range(60):
        said = [rng.choice(words) if rng.random() < 0.85 else rng.choice(names) for _ in range(9)]
        rows.append(["q", f"s{k:02d}", "The " + " ".join(said) + ".", rng.choice([60, 90, 140]), round(rng.random(), 3), f"d{k % 5}", k])
    for k in range(0, 20, 2):  # near copies with one word more, some in the same document
        _, i, text, n, _, doc, at = rows[k]
        rows.append(["q", i + "x", text[:-1] + " today.", n, round(rng.random(), 3), doc if k % 4 else "other", at + 100])
    rows.append(["q", "empty", "It is the of and.", 60, 0.99, "d0", 200])
    return [tuple(r) for r in rows]


def sequential(rows, vectors, concepts, q, masks):
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b))) if a is not None and b is not None else 0.0
    vec = lambda r: vectors.get(r["sentence_id"])
    kept = []
    for r in sorted(rows, key=lambda r: (-r["score"], r["sentence_id"])):
        if not any((c := round(cos(vec(r), vec(o)), 9)) >= C.DUPLICATE_EXACT or c >= C.DUPLICATE_SOFT and r["doc_id"] == o["doc_id"] for o in kept):
            kept.append(r)
    ids = sorted(r["sentence_id"] for r in kept)
    near = {a: [b for b in ids if a != b and (set(concepts[a]) & set(concepts[b]) or round(cos(vectors.get(a), vectors.get(b)), 9) >= C.GRAPH_COSINE)] for a in ids}
    wanted = {t.lower().strip() for t in q["entities"] + q["keywords"]}
    sources = [i for i in ids if set(concepts[i]) & wanted]
    bridge = set()
    for src in sources:
        paths, seen = [[src]], {src}
        while paths:
            step = {}
            for p in paths:
                for n in near[p[-1]]:
                    if n not in seen:
                        step[n] = min(step.get(n, p + [n]), p + [n])
            ends = [p for n, p in step.items() if n in sources]
            if ends:
                bridge |= set(min(ends))
                break
            seen |= set(step)
            paths = list(step.values())
    left, chosen = C.TOKEN_BUDGET[q["query_type"]], set()
    for r in sorted(kept, key=lambda r: (r["sentence_id"] not in bridge, -r["score"], r["sentence_id"])):
        if r["token_count"] <= left:
            left -= r["token_count"]
            chosen.add(r["sentence_id"])
    filled = [r | masks[r["sentence_id"]] | {"is_bridge": r["sentence_id"] in bridge, "selected": r["sentence_id"] in chosen, "n_chars": len(r["text"])} for r in kept]
    after = {r["sentence_id"]: r["selected"] for r in select._swaps([dict(r) for r in filled])}
    filled = [r | {"selected": after[r["sentence_id"]]} for r in filled]
    n = sum(after.values())
    added = select._expand([r | {"query_type": q["query_type"], "complexity": q["complexity"], "required": q["required"], "n_selected": n} for r in filled])[0]["added"]
    return {(i, i in bridge) for i in ids if after[i] or i in added}, kept


def test_selection_equals_the_sequential_one(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, COLUMNS)
    q = analyze.analyze(spark.createDataFrame([("q", QUERY)], "query_id string, query string"))
    vectors = {r.id: np.array(r.vec, float) for r in dense.dense_vectors(df, "sentence_id", "text").collect()}
    concepts = {r[1]: [] for r in rows}
    for r in graph.incidences(df.select(F.col("query_id").alias("grp"), F.col("sentence_id").alias("node"), "text")).collect():
        concepts[r.node].append(r.concept)
    masks = {r.sentence_id: {k: r[k] for k in ("emask", "kmask", "entities", "keywords")} for r in select.with_masks(df, q).collect()}
    of = analyze.complexity(F.col("query"), F.size("entities"), F.size("keywords"))
    head = q.select("*", of.alias("complexity"), select.required_evidence(F.col("query_type"), of).alias("required")).first().asDict()
    want, kept = sequential([dict(zip([c.split()[0] for c in COLUMNS.split(", ")], r)) for r in rows], vectors, concepts, head, masks)
    got = evidence_of(df, q).collect()
    assert {(r.sentence_id, r.is_bridge) for r in got} == want and len(got) == len(want)
    assert len(kept) < len(rows) and "empty" in {r["sentence_id"] for r in kept}
