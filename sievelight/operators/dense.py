"""Exact dense retrieval, in blocks of queries by blocks of vectors, and the hashing embedder."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..runtime import materialize, tiling
from . import sparse

#: Rows of a side of a tile: a task holds two blocks of vectors and their products.
TILE = 4096
#: Of texts whose tokens are hashed, which are small: questions and texts of a tile at most, texts whose counts are held at once.
HASHED_TILE, HELD = (65_536, 524_288), 16_384


def unit(vec: Column, dim: int) -> Column:
    """The vector, null unless it has `dim` values, none of them null or NaN, and a length."""
    return F.when((F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)) & F.exists(vec, lambda x: x != 0), vec)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row; of equal ones (to nine places) those that come first."""
    if k >= scores.shape[1]:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    scores = np.round(scores, 9)
    least = np.partition(scores, -k, axis=1)[:, -k, None]
    above, equal = scores > least, scores == least
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True))))


def _tiles(batches: Iterator[pa.RecordBatch], k: int | None, least: float | None) -> Iterator[pa.RecordBatch]:
    """Rows (tile, grp, side, id, vec) in the order of tile and id: the products of side 0 with side 1 of each tile, and of all pairs of side 2."""
    held: list[pa.RecordBatch] = []

    def run() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        side = table.column("side").to_numpy()
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if not len(flat):
            return
        x = flat.reshape(len(side), -1)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        ids = table.column("id")
        for begin in range(0, len(a), 512):
            q = a[begin : begin + 512]
            s = x[q] @ x[b].T
            if least is not None:
                i, j = np.nonzero((s >= least - 1e-12) & ((side[q][:, None] != 2) | (q[:, None] < b)))
            else:
                i, j = best(s, k + 1)  # the query itself may be among them
            grp = table.column("grp").take(pa.array(q[i]))
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (grp, ids.take(pa.array(q[i])), ids.take(pa.array(b[j])), pa.array(s[i, j]))], ["grp", "id", "other", "cosine"])

    for batch in batches:
        tile = batch.column(0)
        new = pc.not_equal(tile.slice(1), tile.slice(0, max(0, len(tile) - 1))).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(tile)]
        for a, b in zip(edges, edges[1:]):
            if held and held[-1].column(0)[0] != tile[a]:
                yield from run()
                held.clear()
            held.append(batch.slice(a, b - a))
    if held:
        yield from run()


def _dealt(left: DataFrame, right: DataFrame, tile: int) -> DataFrame:
    """Both sides (grp, id, vec) dealt to tiles: blocks by the hash of the id, as many as a group's size asks for."""
    sizes = left.groupBy("grp").agg(F.count("*").alias("n")).join(right.groupBy("grp").agg(F.count("*").alias("m")), "grp")
    sizes = sizes.select("grp", F.ceil(F.col("n") / tile).cast("int").alias("nb"), F.ceil(F.col("m") / tile).cast("int").alias("mb"))
    mine = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    theirs = F.pmod(F.xxhash64("id"), F.col("mb")).cast("int")
    a = left.join(sizes, "grp").select("*", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j")).select(F.concat_ws("|", "grp", mine, "j").alias("tile"), "grp", F.lit(0).alias("side"), "id", "vec")
    b = right.join(sizes, "grp").select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i")).select(F.concat_ws("|", "grp", "i", theirs).alias("tile"), "grp", F.lit(1).alias("side"), "id", "vec")
    return a.unionByName(b).repartition("tile").sortWithinPartitions("tile", "id")


def _dealt_self(rows: DataFrame, tile: int) -> DataFrame:
    """One side (grp, id, vec) for its own pairs: a group of one block goes once, of more blocks every pair of blocks is a tile."""
    sizes = rows.groupBy("grp").agg(F.ceil(F.count("*") / tile).cast("int").alias("nb"))
    mine = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    dealt = rows.join(sizes, "grp").withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    key = F.concat_ws("|", "grp", F.least("i", "j"), F.greatest("i", "j"))
    return dealt.select(key.alias("tile"), "grp", side.alias("side"), "id", "vec").repartition("tile").sortWithinPartitions("tile", "id")


def close_pairs(df: DataFrame, group: str, id_col: str, vec: str, dim: int, least: float, tile: int = TILE) -> DataFrame:
    """(grp, id, other, cosine) of pairs of one group with a cosine of at least `least`, id < other; ids are unique in a group."""
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(id_col).alias("id"), unit(F.col(vec), dim).alias("vec")).filter("vec IS NOT NULL AND grp IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    out = _dealt_self(rows, tile).mapInArrow(lambda it: _tiles(it, None, least), f"grp string, id {kind}, other {kind}, cosine double")
    return out.select("grp", F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), F.round("cosine", 9).alias("cosine"))


def top_k(queries: DataFrame, vectors: DataFrame, dim: int, k: int, tile: int = TILE) -> DataFrame:
    """(id, other, cosine, rank): exact k best of `vectors` for each of `queries`, both (id, vec) with unique ids; equal ids are left out, ties go to the smaller id."""
    a, b = (d.select(F.lit("all").alias("grp"), "id", unit(F.col("vec"), dim).alias("vec")).filter("vec IS NOT NULL") for d in (queries, vectors))
    kind = a.schema["id"].dataType.simpleString()
    out = _dealt(a, b, tile).mapInArrow(lambda it: _tiles(it, k, None), f"grp string, id {kind}, other {kind}, cosine double")
    out = out.filter("id <> other").select("id", "other", F.round("cosine", 9).alias("cosine"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("cosine").desc(), "other"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def hash_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = C.HASH_DIM) -> DataFrame:
    """(id, bucket, n, norm): the sparse form of the hashing embedder, whose counts stay exact integers."""
    tokens = df.select(F.col(id_col).alias("id"), F.explode(T.index_tokens(F.col(text_col))).alias("t"))
    counts = tokens.groupBy("id", T.hash_bucket(F.col("t"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, "id")


def _counted(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        n = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(row * dim + lists.flatten().to_numpy(), minlength=len(n) * dim).astype(np.float32)
        offsets = pa.array(np.arange(len(n) + 1) * dim, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(counts))], ["id", "vec"])


def dense_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = C.HASH_DIM, every: bool = False) -> DataFrame:
    """(id, vec): the hashing embedder as dense vectors; texts without tokens have none, or with `every` one of zeros."""
    tokens = F.transform(T.index_tokens(F.col(text_col)), lambda t: T.hash_bucket(t, dim))
    rows = df.select(F.col(id_col).alias("id"), tokens.alias("b"))
    rows = rows if every else rows.filter(F.size("b") > 0)
    return rows.mapInArrow(lambda it: _counted(it, dim), f"id {df.schema[id_col].dataType.simpleString()}, vec array<float>")


def _buckets(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, tokens): the buckets of the tokens as bytes, and the sum of the squares of their counts."""
    kind = np.dtype(np.min_scalar_type(dim - 1))
    for batch in batches:
        lists = batch.column(1)
        words = lists.flatten().dictionary_encode()
        bucket = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % dim for w in words.dictionary.to_pylist()], kind)
        b = bucket[words.indices.to_numpy()]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        row = np.repeat(np.arange(len(batch)), np.diff(offsets))
        squares = np.square(np.bincount(row * dim + b, minlength=len(batch) * dim).reshape(-1, dim)).sum(1)
        made = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((offsets * kind.itemsize).astype(np.int32)), pa.py_buffer(b.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), made, pa.array(squares, pa.int64())], ["id", "b", "squares"])


def nearest(asked: list[np.ndarray], texts: tuple[np.ndarray, np.ndarray], squares: np.ndarray, dim: int, k: int, held: int = HELD) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each question, buckets of tokens, the places and cosines of the k texts of the highest positive cosine to nine places; of equal ones those that come first.

    texts: the buckets of all texts in a row, and where each begins and ends; squares: the sums of the squares of their counts.
    Products of counts are whole numbers, added up bucket by bucket. Texts are met by length: from what the k best so far
    have, it follows which product a text of the next ones must reach.
    """
    flat, offsets = texts
    order = np.argsort(squares, kind="stable")
    lengths = [math.sqrt(int(np.square(np.bincount(t)).sum())) for t in asked]
    counts = [np.unique(t, return_counts=True) for t in asked]
    least, size = [0.0] * len(asked), [0] * len(asked)
    found: list[list] = [[] for _ in asked]

    def merge(q: int) -> None:
        at, cosine = (np.concatenate(x) for x in zip(*found[q]))
        top = sparse.best(cosine, at, k, 9)
        found[q], size[q] = [(at[top], cosine[top])], 0
        if len(top) == k:
            least[q] = float(np.round(cosine[top[-1]], 9))

    for begin in range(0, len(order), held):
        rows = order[begin : begin + held]
        n = offsets[rows + 1] - offsets[rows]
        token = np.arange(n.sum()) + np.repeat(offsets[rows] - np.cumsum(n) + n, n)
        m = np.bincount(flat[token].astype(np.int64) * len(rows) + np.repeat(np.arange(len(rows)), n), minlength=dim * len(rows)).reshape(dim, len(rows))
        m = m.astype(np.min_scalar_type(int(m.max(initial=0))))
        most, norm = m.max(1).astype(np.int64), np.sqrt(squares[rows])
        total, room = np.empty(len(rows), m.dtype), np.iinfo(m.dtype).max
        for q, (bucket, count) in enumerate(counts):
            bound = int(most[bucket] @ count)
            need = max(1, math.ceil((least[q] - 1e-9) * lengths[q] * norm[0] - 1e-6))
            if bound < need:
                continue
            if bound <= room and len(asked[q]) <= 64:
                np.copyto(total, m[asked[q][0]])
                for t in asked[q][1:]:
                    np.add(total, m[t], out=total)
                product = total
            else:
                product = count @ m[bucket].astype(np.int64)
            hit = np.flatnonzero(product >= need)
            cosine = product[hit] / (lengths[q] * norm[hit])
            if least[q]:
                near = cosine >= least[q] - 1e-9
                hit, cosine = hit[near], cosine[near]
            if len(hit):
                found[q].append((rows[hit], cosine))
                size[q] += len(hit)
                if not least[q] or size[q] > 2 * k:
                    merge(q)
    for q in range(len(asked)):
        if size[q]:
            merge(q)
    return [f[0] if f else (np.empty(0, np.int64), np.empty(0)) for f in found]


def _hashed_tiles(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, id, b, squares) in the order of tile and id: the k best of side 1 for each of side 0 of a tile."""
    kind = np.dtype(np.min_scalar_type(dim - 1))
    held = list(batches)
    rows = pa.Table.from_batches(held) if held else None
    for tile in np.unique(rows.column("tile").to_numpy()) if rows is not None and len(rows) else []:
        sides = []
        for side in (0, 1):
            of = rows.filter(pc.and_(pc.equal(rows.column("tile"), int(tile)), pc.equal(rows.column("side"), side))).combine_chunks()
            b = pa.concat_arrays(of.column("b").chunks) if len(of) else pa.array([], pa.binary())
            ends = np.frombuffer(b.buffers()[1], np.int32)[b.offset : b.offset + len(b) + 1].astype(np.int64) if len(b) else np.zeros(1, np.int64)
            flat = np.frombuffer(b.buffers()[2], kind, ends[-1] // kind.itemsize) if len(b) else np.empty(0, kind)
            sides.append((of.column("id"), (flat, ends // kind.itemsize), of.column("squares").to_numpy()))
        (ids, (said, ends), _), (others, texts, squares) = sides
        if not len(ids) or not len(others):
            continue
        got = nearest([said[a:b] for a, b in zip(ends, ends[1:])], texts, squares, dim, k)
        row = np.repeat(np.arange(len(got)), [len(at) for at, _ in got])
        at, cosine = (np.concatenate(x) for x in zip(*got))
        out = ids.take(pa.array(row)), others.take(pa.array(at)), pa.array(cosine)
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], ["id", "other", "cosine"])


def hashed_top_k(queries: DataFrame, texts: DataFrame, k: int, dim: int = C.HASH_DIM, tile: tuple[int, int] = HASHED_TILE) -> DataFrame:
    """(id, other, cosine, rank): exact k best of `texts` with a positive cosine by the hashing embedder for each of `queries`, both (id, tokens) with unique ids; ties go to the smaller id.

    Only the k best of a tile leave it.
    """
    kind = queries.schema["id"].dataType.simpleString()
    a, b = (materialize(d.select("id", "tokens").filter(F.size("tokens") > 0).mapInArrow(lambda it: _buckets(it, dim), f"id {kind}, b binary, squares bigint"), "buckets") for d in (queries, texts))
    rows, columns = tiling(queries.sparkSession, a.count(), b.count(), *tile)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dealt = []
    for side, d, i, j in ((0, a, block(rows), F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))), (1, b, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))), block(columns))):
        dealt.append(d.select("*", i.alias("i"), j.alias("j")).select((F.col("i") * F.lit(columns) + F.col("j")).cast("int").alias("tile"), F.lit(side).alias("side"), "id", "b", "squares"))
    both = dealt[0].unionByName(dealt[1]).repartitionById(rows * columns, F.col("tile")).sortWithinPartitions("tile", "id")
    out = both.mapInArrow(lambda it: _hashed_tiles(it, dim, k), f"id {kind}, other {kind}, cosine double").withColumn("cosine", F.round("cosine", 9)).filter("cosine > 0")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("cosine").desc(), "other"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)
