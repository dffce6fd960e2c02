"""Rows that a narrower version would lose."""

import pytest

from sievelight.operators import graph
from sievelight.plans import retrieval_queries as R

SENTENCES = "query_id string, sentence_id string, doc_id string, embedding array<double>, final_score double"


def test_sentences_without_a_usable_embedding_are_kept(spark, tmp_path):
    v = [1.0] + [0.0] * 383
    rows = [("q", "a", "d", v, 0.9), ("q", "b", "d", v, 0.8), ("q", "none", "d", None, 0.7), ("q", "zero", "d", [0.0] * 384, 0.6), ("q", "nan", "d", [float("nan")] * 384, 0.5), ("q", "short", "d", [1.0], 0.4)]
    spark.createDataFrame(rows, SENTENCES).write.parquet(str(tmp_path / "sentences.parquet"))
    got = sorted(r.sentence_id for r in R.greedy_dedup(spark, str(tmp_path)).collect())
    assert got == ["a", "nan", "none", "short", "zero"]


@pytest.mark.parametrize("word", ["mill", "zinc", "1733", "ox"])
def test_short_words_and_numbers_link_sentences(spark, word):
    s = spark.createDataFrame([("q", 1, f"Behind stands the {word} alone."), ("q", 2, f"Then came {word} again.")], "grp string, node int, text string")
    assert word in {r.concept for r in graph.incidences(s).groupBy("concept").count().filter("count = 2").collect()}


def test_far_sources_have_a_path(spark):
    links = spark.createDataFrame([("q", n, f"c{c:02d}") for c in range(18) for n in (c, c + 1)], "grp string, node int, concept string")
    ends = spark.createDataFrame([("q", 0), ("q", 18)], "grp string, node int")
    assert sorted(r.path for r in graph.bridges(links, ends).collect()) == [list(range(19)), list(range(18, -1, -1))]
