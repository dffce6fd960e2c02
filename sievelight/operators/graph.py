"""Concept graph of a query's sentences and its bridge sentences.

Sentences are neighbours if they share a concept, or by cosine. The links are kept as incidences (sentence, concept),
never as pairs: a frontier goes from sentences to concepts and on to sentences, with the smallest path kept at each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import exists, materialize
from .analyze import FUNCTION_WORDS


def concepts(text: Column, word: str = "[a-z]{5,}") -> Column:
    """Capitalised words behind the first word, lower-cased, and the normal forms of the words of a pattern, without function words."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\S+", "")
    words = F.transform(F.regexp_extract_all(rest, F.lit("([A-Z][A-Za-z0-9]+)"), F.lit(1)), lambda w: F.lower(w))
    content = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({word})"), F.lit(1)), T.lemma)
    stop = F.array(*[F.lit(x) for x in FUNCTION_WORDS])
    return F.array_distinct(F.filter(F.concat(words, content), lambda w: ~F.array_contains(stop, w)))


#: Words of two letters or digits and more are concepts of the bridge search.
WORD = "[a-z0-9]{2,}"
#: Parts of a concept's sentences that take its offers apart from each other.
SALTS = 16


def incidences(sentences: DataFrame, text: str = "text") -> DataFrame:
    """(grp, node, concept) from sentences (grp, node, text); words of two letters or digits and more are concepts."""
    return sentences.select("grp", "node", F.explode(concepts(F.col(text), WORD)).alias("concept"))


def concept_links(incident: DataFrame) -> DataFrame:
    """(grp, concept, n_sentences, n_pairs): the edges by shared concepts, counted by concept; the pairs themselves are never listed."""
    n = F.col("n_sentences")
    return incident.groupBy("grp", "concept").agg(F.count_distinct("node").alias("n_sentences")).filter(n > 1).withColumn("n_pairs", (n * (n - 1) / 2).cast("bigint"))


def bridges(incident: DataFrame, sources: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(grp, src, path): from every source the shortest path to the nearest other source, the smallest of those alike.

    incident (grp, node, concept), sources (grp, node), pairs (grp, a, b) further neighbours. A source without another
    source in reach has no path. Every pair is taken as a concept of its own. incident and pairs hold no row twice and are
    read several times, so they should be stored.
    """
    links = incident
    if pairs is not None:
        links = links.unionByName(pairs.select("grp", F.explode(F.array("a", "b")).alias("node"), F.concat_ws("|", F.lit("pair"), F.col("a").cast("string"), F.col("b").cast("string")).alias("concept")))
    sources = materialize(sources.distinct(), "sources")
    # one hop: the smallest other source of a concept is its first or second source
    per = links.join(sources, ["grp", "node"], "left_semi")
    rank = F.row_number().over(W.partitionBy("grp", "concept").orderBy("node"))
    first = per.withColumn("rn", rank).filter("rn <= 2").groupBy("grp", "concept").agg(F.min("node").alias("one"), F.max("node").alias("two"))
    near = per.join(first, ["grp", "concept"]).select("grp", F.col("node").alias("src"), F.when(F.col("one") != F.col("node"), F.col("one")).when(F.col("two") != F.col("node"), F.col("two")).alias("sink"))
    near = near.filter("sink IS NOT NULL").groupBy("grp", "src").agg(F.min("sink").alias("sink"))
    found = [materialize(near.select("grp", "src", F.array("src", "sink").alias("path")), "near")]
    # further hops only where a source shares no concept with another one, and its query has another one
    many = sources.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1").select("grp")
    alone = materialize(sources.join(found[0].select("grp", F.col("src").alias("node")), ["grp", "node"], "left_anti").join(many, "grp", "left_semi"), "alone")
    if not exists(alone):
        return found[0]
    held = alone.select("grp").distinct()
    links = materialize(links.join(held, "grp", "left_semi").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), "open_links")
    # every node holds the best paths to its two nearest sources, found for all sources at once; a source finds itself first
    new = materialize(sources.join(held, "grp", "left_semi").select("grp", "node", F.col("node").alias("origin"), F.array("node").alias("path")), "labels")
    labels, left, hop = new, alone, 0
    while exists(new) and exists(left):
        offers = new.join(links.drop("salt"), ["grp", "node"]).groupBy("grp", "concept", "origin").agg(F.min("path").alias("path"))
        place = F.row_number().over(W.partitionBy("grp", "concept").orderBy("path"))
        # two offers of a concept, once for each salt: a frequent concept is spread over tasks
        offers = offers.withColumn("rn", place).filter("rn <= 2").drop("rn").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        got = offers.join(links, ["grp", "concept", "salt"]).groupBy("grp", "node", "origin").agg(F.min("path").alias("path"))
        have = labels.groupBy("grp", "node").agg(F.count("*").alias("have"))
        got = got.join(labels.select("grp", "node", "origin"), ["grp", "node", "origin"], "left_anti").join(have, ["grp", "node"], "left")
        place = F.row_number().over(W.partitionBy("grp", "node").orderBy("path"))
        got = got.withColumn("rn", place).filter(F.col("rn") + F.coalesce("have", F.lit(0)) <= 2)
        new = materialize(got.select("grp", "node", "origin", F.concat(F.array("node"), "path").alias("path")), f"labels{hop}")
        labels = labels.unionByName(new)
        left = materialize(left.join(new.filter("origin <> node").select("grp", "node"), ["grp", "node"], "left_anti"), f"left{hop}")
        hop += 1
    best = labels.join(alone, ["grp", "node"], "left_semi").filter("origin <> node").groupBy("grp", F.col("node").alias("src")).agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("b"))
    return found[0].unionByName(best.select("grp", "src", F.col("b.path").alias("path")))


def bridge_nodes(paths: DataFrame) -> DataFrame:
    """(grp, node): all sentences on a path, both ends included."""
    return paths.select("grp", F.explode("path").alias("node")).distinct()
