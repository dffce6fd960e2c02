"""Sparse retrieval: an Okapi BM25 index as tables, stored once, and top-k in blocks of queries by blocks of documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import config as C
from ..functions import text as T
from ..runtime import checkpoint_dir, fingerprint, materialize, table_exists, tiling

#: Query terms that are sent to every worker (about 20 MB); more meet the postings in a shuffle, in SALTS parts each.
SENT_TERMS, SALTS = 200_000, 16
#: Queries and postings of a tile at most.
TILE = (65_536, 4_000_000)
TABLES = ["postings", "tokens", "terms", "corpus"]


class Index:
    """postings (term, id, tf, dl), tokens (id, tokens, dl), terms (term, df, idf) and one row of corpus figures (n_docs, avgdl).

    The length of a document stands in its postings, so that a search needs no join with the tokens.
    """

    def __init__(self, postings: DataFrame, tokens: DataFrame, terms: DataFrame, corpus: DataFrame):
        self.postings, self.tokens, self.terms, self.corpus = postings, tokens, terms, corpus

    @classmethod
    def build(cls, corpus: DataFrame, id_col: str, text_col: str) -> Index:
        tokens = corpus.select(F.col(id_col).alias("id"), T.index_tokens(F.col(text_col)).alias("tokens"))
        tokens = materialize(tokens.withColumn("dl", F.size("tokens")), "tokens")  # the corpus is tokenised once
        # counted in part before the shuffle: a document's tokens lie together
        postings = tokens.select("id", "dl", F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").cast("int").alias("tf")).select("term", "id", "tf", "dl")
        return cls.of(postings, tokens)

    @classmethod
    def of(cls, postings: DataFrame, tokens: DataFrame) -> Index:
        """The index with the statistics of its postings and tokens."""
        # documents without tokens count in the number of documents and in the mean length
        figures = tokens.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        raw = df.crossJoin(F.broadcast(figures)).select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw").alias("mean_idf"))
        # negative weights become a small share of the mean weight of the vocabulary; the one-row sides are broadcast
        terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, C.EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
        return cls(postings, tokens, terms, figures)

    def save(self, path: str) -> Index:
        """Writes the four tables; postings lie in the order of their terms, so that a scan for some terms passes most row groups by."""
        spark, at = self.terms.sparkSession, {name: os.path.join(path, name) for name in TABLES}
        self.tokens.write.mode("overwrite").parquet(at["tokens"])
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(at["postings"])
        # the statistics are those of the written tables: postings are not counted again
        done = self.of(spark.read.parquet(at["postings"]), spark.read.parquet(at["tokens"]))
        for name in ("terms", "corpus"):
            getattr(done, name).write.mode("overwrite").parquet(at[name])
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(os.path.join(path, name)) for name in TABLES])


def stored(source: DataFrame, corpus: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of a corpus made of `source`, built once for its files and read afterwards."""
    spark = source.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"bm25-with-tokens-{text_col}-{fingerprint(source)}")
    if table_exists(spark, os.path.join(path, TABLES[-1])):
        return Index.load(spark, path)
    return Index.build(corpus, id_col, text_col).save(path)


def keyword_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): keywords split at white space; repeated terms count."""
    words = F.explode(F.flatten(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), T.blank_tokens)))
    return queries.select("query_id", words.alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, part, id, tf, dl) in the order of term and part: one row for each run of a term and part, with lists."""
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        new[0] = True
        for c in batch.columns[:2]:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(new)
        offsets, first = pa.array(np.append(begins, len(batch)).astype(np.int32)), pa.array(begins)
        yield pa.RecordBatch.from_arrays([c.take(first) for c in batch.columns[:2]] + [pa.ListArray.from_arrays(offsets, c) for c in batch.columns[2:]], ["term", "part", "ids", "tf", "dl"])


def best(scores: np.ndarray, at: np.ndarray, k: int, places: int) -> np.ndarray:
    """Where the k highest scores stand, rounded to so many places; of equal ones those of smaller `at`."""
    kept = np.arange(len(scores))
    if len(scores) > 2 * k:  # first without the ones that no rounding brings among them
        kept = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - 10.0**-places)
    return kept[np.lexsort((at[kept], -np.round(scores[kept], places)))[:k]]


def _searched(batches: Iterator[pa.RecordBatch], k: int, avgdl: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (tile, query_id, terms, ws, ids, tf, dl) of queries and of packed postings, whose ws is null: the k best documents of each query of a tile."""
    held = list(batches)
    rows = pa.Table.from_batches(held).combine_chunks() if held else None
    for tile in np.unique(rows.column("tile").to_numpy()) if rows is not None and len(rows) else []:
        of = rows.filter(pc.equal(rows.column("tile"), pa.scalar(int(tile), pa.int32()))).combine_chunks()
        lists = {c: of.column(c).combine_chunks() for c in ("terms", "ws", "ids", "tf", "dl")}
        asks = pc.is_valid(lists["ws"])
        posts, queries = ({c: x.filter(m) for c, x in lists.items()} for m in (pc.invert(asks), asks))
        if not len(posts["ids"]) or not len(queries["ws"]):
            continue
        ids = posts["ids"].flatten().dictionary_encode()
        order = pc.sort_indices(ids.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[ids.indices.to_numpy()]  # documents in the order of their ids
        tf, dl = (posts[c].flatten().to_numpy() for c in ("tf", "dl"))
        gain = tf * (C.K1 + 1) / (tf + C.K1 * (1 - C.B + C.B * dl / avgdl))

        words = posts["terms"].flatten().dictionary_encode()
        word = np.repeat(words.indices.to_numpy(), pc.list_value_length(posts["ids"]).to_numpy())
        order_of = np.lexsort((at, word))
        word, at, gain = word[order_of], at[order_of], gain[order_of]
        new = np.ones(len(at), bool)
        new[1:] = (word[1:] != word[:-1]) | (at[1:] != at[:-1])
        if not new.all():
            word, at, gain = word[new], at[new], np.add.reduceat(gain, np.flatnonzero(new))
        ends = np.searchsorted(word, np.arange(len(words.dictionary) + 1))
        spans = {w: slice(a, b) for w, a, b in zip(words.dictionary.to_pylist(), ends, ends[1:])}

        total = np.zeros(len(order))
        asked, names, weights = queries["ws"].offsets.to_numpy(), queries["terms"].flatten().to_pylist(), queries["ws"].flatten().to_numpy()
        found: dict[tuple, tuple] = {}
        row, doc, score = [], [], []
        for q, (a, b) in enumerate(zip(asked - asked[0], asked[1:] - asked[0])):
            key = tuple(sorted((t, w) for t, w in zip(names[a:b], weights[a:b].tolist()) if t in spans))
            if key not in found:  # queries of the same known terms have the same hits
                for t, w in key:
                    total[at[spans[t]]] += w * gain[spans[t]]
                docs, sums = [], []
                for t, _ in key:
                    docs.append(at[spans[t]])
                    sums.append(total[docs[-1]])
                    total[docs[-1]] = 0.0  # a document counts once, with its first term
                docs, sums = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (docs, sums))
                some = np.flatnonzero(sums > 0)
                top = some[best(sums[some], docs[some], k, 6)]
                found[key] = docs[top], sums[top]
            d, s = found[key]
            row.append(np.full(len(d), q))
            doc.append(d)
            score.append(s)
        row, doc = np.concatenate(row), order[np.concatenate(doc)]
        query = of.column("query_id").combine_chunks().filter(asks)
        yield pa.RecordBatch.from_arrays([query.take(pa.array(row)), ids.dictionary.take(pa.array(doc)).cast(kind), pa.array(np.concatenate(score))], ["query_id", "id", "score"])


def search(index: Index, terms: DataFrame, k: int, sent_terms: int = SENT_TERMS, tile: tuple[int, int] = TILE) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents with a positive score; ties go to the smaller id.

    Blocks of queries meet the postings of their terms, in blocks of documents; only the k best of a tile leave it.
    """
    spark = terms.sparkSession
    # the statistics are attached to the few query terms first, so postings are met once
    weighted = materialize(terms.join(index.terms, "term").select("query_id", "term", "df", (F.col("qtf") * F.col("idf")).alias("w")), "weighted")
    queries = weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("t"))
    n_terms, n_postings = weighted.select("term", "df").distinct().agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    rows, parts = tiling(spark, queries.count(), n_postings, *tile)
    block = F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int")
    wanted = weighted.groupBy("term").agg(F.collect_set(block).alias("blocks"))
    postings = index.postings.select("term", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "tf", "dl")
    if n_terms <= sent_terms:  # no shuffle of postings, and no task for a frequent term
        wanted = F.broadcast(wanted)
        met = postings.join(wanted, "term", "left_semi")
    else:  # a frequent term is dealt to parts by its documents
        dealt = wanted.select("term", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(dealt, ["term", "salt"], "left_semi").drop("salt")
    kind, avgdl = index.postings.schema["id"].dataType, index.corpus.first().avgdl
    packed = met.sortWithinPartitions("term", "part").mapInArrow(_packed, f"term string, part int, ids array<{kind.simpleString()}>, tf array<int>, dl array<int>")
    tile_of = lambda i, j: (i * F.lit(parts) + j).cast("int").alias("tile")
    sent = packed.join(wanted, "term").select(F.explode("blocks").alias("i"), "*").select(tile_of(F.col("i"), F.col("part")), F.array("term").alias("terms"), "ids", "tf", "dl")
    asked = queries.select("query_id", "t", block.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"))
    asked = asked.select(tile_of(F.col("i"), F.col("j")), "query_id", F.col("t.term").alias("terms"), F.col("t.w").alias("ws"))
    both = asked.unionByName(sent, allowMissingColumns=True).select("tile", "query_id", "terms", "ws", "ids", "tf", "dl").repartitionById(rows * parts, F.col("tile"))
    arrow = to_arrow_type(kind)
    out = both.mapInArrow(lambda it: _searched(it, k, avgdl, arrow), f"query_id {terms.schema['query_id'].dataType.simpleString()}, id {kind.simpleString()}, score double")
    scored = out.withColumn("score", F.round("score", 6)).filter("score > 0")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
