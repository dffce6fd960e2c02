"""Near-duplicate texts by covering locality-sensitive hashing.

Similarity is the share of distinct 5-character substrings of the normalised texts (lower case, white-space runs as one
blank, trimmed) that both have. Equal texts are one class. Each class gets a sketch of minhash symbols. In each of
several repetitions 7 symbols stand at the 7 points of the binary projective plane; the 7 masks of its dual (mask v keeps
point p where <v, p> = 1, 4 points each) make a covering code of radius 2: whichever 2 symbols differ, some mask keeps
none of them, so classes whose symbols differ in at most 2 places collide in a table for certain. At a similarity of 0.7
one repetition finds 69 % of pairs, `REPEATS` find 99.1 %; at 0.8 they find 99.98 %. Rows of a table carry a 128-bit
fingerprint of 32 symbols that settles most collisions inside the buckets of a table; 64 symbols settle most of the
rest, and what passes is compared exactly, text by text. A bucket of more than `BUCKET` classes (boilerplate) is dealt to
blocks, and every pair of blocks is a tile of its own, so that no task holds a whole bucket and no pair is left out.

The work is in classes, told apart by 128 bits of their text: pairs are between class representatives, records are
members of a class. Tables carry half of these bits; where two classes agree in that half, both are compared. Records are only paired
one by one where a caller asks for that (`record_pairs`).

Defined results: null texts and texts without a character other than white space take no part; a text under 5 characters
is its own only substring; repeated rows of one id count once, an id with two texts belongs to both classes; texts of any
length are compared whole; other columns are ignored; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import exists, materialize
from . import flat

SHINGLE, THRESHOLD = 5, 0.7
#: Repetitions of the 7 masks; symbols of the fingerprints; how many must agree (at similarity 0.7 fewer agree in 0.2 and 0.1 % of pairs).
REPEATS, SYMBOLS, AGREE, WIDE_SYMBOLS, WIDE_AGREE = 4, 32, 16, 64, 34
#: Classes of a bucket that are compared in place; keys of larger buckets that may be sent to every worker (1.6 MB).
BUCKET, BROADCAST_BUCKETS = 2048, 100_000
#: Pairs whose class keys may be sent to every worker (16 MB); more are met in a shuffle.
BROADCAST_PAIRS = 500_000
POINTS = range(1, 8)
MASKS = [[p - 1 for p in POINTS if (p & v).bit_count() % 2] for v in POINTS]
BATCH_CHARS = 2_000_000
_rng = np.random.default_rng(20)
ODD = _rng.integers(0, 1 << 63, WIDE_SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _rng.integers(0, 1 << 63, WIDE_SYMBOLS, dtype=np.uint64)


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-character substrings of all texts, one after the other, and their offsets; short texts are filled up."""
    texts = [t if len(t) >= SHINGLE else t.ljust(SHINGLE, "\0") for t in texts]
    cp, offsets = flat.joined(texts)
    wide = np.concatenate([cp.astype(np.uint64), np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(cp), np.uint64)
    for k in range(SHINGLE):
        h = (h ^ wide[k : k + len(cp)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    count = np.diff(offsets) - SHINGLE + 1
    return flat.mix(h[flat.ranges(offsets[:-1], count)]), np.append(0, np.cumsum(count))


def sketches(texts: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """One row of minhash symbols for each text."""
    h, offsets = shingles(texts)
    out = np.empty((len(texts), symbols), np.uint64)
    for k in range(symbols):
        out[:, k] = np.minimum.reduceat((h ^ FLIP[k]) * ODD[k], offsets[:-1])
    return flat.mix(out)


def table_keys(sketch: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One key for each text and table; salt keeps fields apart."""
    keys = []
    for repeat in range(REPEATS):
        symbols = sketch[:, 7 * repeat : 7 * repeat + 7]
        for number, mask in enumerate(MASKS):
            key = salt + np.uint64((7 * repeat + number + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
            for p in mask:
                key = (key ^ symbols[:, p]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            keys.append(key)
    return np.stack(keys, 1)


def fingerprints(sketch: np.ndarray) -> list[np.ndarray]:
    """Four bits of each symbol, 16 symbols in a 64-bit number."""
    nibble = sketch & np.uint64(15)
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return [np.bitwise_or.reduce(nibble[:, a : a + 16] << shift, axis=1).view(np.int64) for a in range(0, sketch.shape[1], 16)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _classes(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalise(t) for t in batch.column(2).to_pylist()]
        keep = [i for i, t in enumerate(texts) if t]
        own = [texts[i] for i in keep]
        cls = pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in own], pa.binary())
        rows = pa.array(keep, pa.int64())
        columns = [batch.column(0).take(rows), *([] if with_text else [batch.column(1).take(rows)]), cls, *([pa.array(own, pa.string())] if with_text else [])]
        yield pa.RecordBatch.from_arrays(columns, ["field", "cls", "text"] if with_text else ["field", "id", "cls"])


def halves(cls: pa.Array) -> np.ndarray:
    """The first 64 bits of each class."""
    return np.frombuffer(b"".join(c[:8] for c in cls.to_pylist()), np.int64)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_tables = REPEATS * len(MASKS)
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in flat.slices(np.array([len(t) for t in texts], np.int64), BATCH_CHARS):
            sketch = sketches(texts[a:b])
            salt = np.array([xxhash.xxh3_64_intdigest(f) for f in batch.column(0).slice(a, b - a).to_pylist()], np.uint64)
            keys = table_keys(sketch, salt).ravel().view(np.int64)
            cls = np.repeat(halves(batch.column(1).slice(a, b - a)), n_tables)
            low, high = (np.repeat(x, n_tables) for x in fingerprints(sketch))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, cls, low, high)], ["key", "cls", "low", "high"])


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in flat.slices(np.array([len(t) for t in texts], np.int64), BATCH_CHARS):
            marks = fingerprints(sketches(texts[a:b], WIDE_SYMBOLS))
            own = batch.column(1).slice(a, b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), own, pa.array(halves(own)), *[pa.array(m) for m in marks]], ["field", "cls", "half", *WIDE])


LOWEST = np.int64(0x1111111111111111)


def agreeing(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """In how many of the 32 symbols two fingerprints agree."""
    out = np.full(np.broadcast(low_a, low_b).shape, SYMBOLS, np.int64)
    for x in (low_a ^ low_b, high_a ^ high_b):
        out -= np.bitwise_count((x | x >> 1 | x >> 2 | x >> 3) & LOWEST)
    return out


MET = ["key", "cls_a", "cls_b", "low", "high"]


def _met(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs of classes, the smaller half first; equal halves are no pair."""
    apart = a != b
    a, b = a[apart], b[apart]
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none], MET)


def _bucket_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs inside the buckets of rows ordered by key; the rows of a bucket larger than `most` go out as they are, with their key."""
    held = [np.zeros(0, np.int64)] * 4
    large = None  # key of the bucket whose rows go out
    again = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.nulls(len(rows[0]), pa.int64()), pa.array(rows[2]), pa.array(rows[3])], MET)

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Each row with the one `apart` places on, as long as any two of them share a bucket."""
        key, cls, low, high = rows
        at = np.arange(len(key))
        for apart in range(1, len(key)):
            at = at[: np.searchsorted(at, len(key) - apart)]
            at = at[key[at] == key[at + apart]]
            if not len(at):
                break
            near = at[agreeing(low[at], high[at], low[at + apart], high[at + apart]) >= AGREE]
            if len(near):
                yield _met(cls[near], cls[near + apart])

    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
        if large is not None:
            n = int(np.searchsorted(rows[0], large, side="right"))
            if n:
                yield again([r[:n] for r in rows])
            rows = [r[n:] for r in rows]
            if len(rows[0]):
                large = None
        if not len(rows[0]):
            held = rows
            continue
        edges = np.append(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])), len(rows[0]))
        size = np.diff(edges)
        beyond = np.repeat(size > most, size)
        if beyond.any():
            yield again([r[beyond] for r in rows])
            large = rows[0][-1] if beyond[-1] else None
        last = 0 if large is not None else int(size[-1])  # the last bucket may go on in the next batch
        end = len(rows[0]) - last
        yield from pairs([r[:end][~beyond[:end]] for r in rows])
        held = [r[end:] for r in rows]
    yield from pairs(held)


def _tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the tiles of large buckets, rows (tile, side, cls, low, high) ordered by tile: side 0 with side 1, and all of side 2."""
    held: list[pa.RecordBatch] = []

    def run() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        side, cls, low, high = (table.column(k).to_numpy() for k in range(1, 5))
        for one, two in ((0, 1), (2, 2)):
            b = np.flatnonzero(side == two)
            a = np.flatnonzero(side == one)
            for begin in range(0, len(a) if len(b) else 0, 256):
                own = a[begin : begin + 256, None]
                i, j = np.nonzero((agreeing(low[own], high[own], low[b], high[b]) >= AGREE) & ((one != two) | (own < b)))
                yield _met(cls[own[i, 0]], cls[b[j]])

    for batch in batches:
        tile = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for a, b in zip(edges, edges[1:]):
            if held and held[-1].column(0)[0].as_py() != tile[a]:
                yield from run()
                held.clear()
            held.append(batch.slice(a, b - a))
    if held:
        yield from run()


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        texts = list(dict.fromkeys([*a, *b]))
        sets: dict[str, np.ndarray] = {}
        for s, e in flat.slices(np.array([len(t) for t in texts], np.int64), BATCH_CHARS):
            h, o = shingles(texts[s:e])
            sets |= {t: np.unique(h[o[i] : o[i + 1]]) for i, t in enumerate(texts[s:e])}
        share = np.array([similarity(sets[x], sets[y]) for x, y in zip(a, b)])
        keep = np.flatnonzero(share >= least)
        rows = pa.array(keep)
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in range(3)], pa.array(share[keep])], ["field", "cls_a", "cls_b", "similarity"])


WIDE = [f"w{k}" for k in range(WIDE_SYMBOLS // 16)]


def _agreeing(columns: list[str]) -> F.Column:
    """In how many symbols the four bits of the fingerprints of a and b agree."""
    fold = "bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & " + f"{0x1111111111111111}L)"
    return F.expr(f"{16 * len(columns)} - " + " - ".join(fold.format(x=f"(a.{c} ^ b.{c})") for c in columns))


def _tiled(large: DataFrame, bucket: int) -> DataFrame:
    """The rows of large buckets, dealt to blocks, in every tile of their block: (tile, side, cls, low, high) ordered by tile."""
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / bucket).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_BUCKETS else sizes
    own = large.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("cls_a"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return own.select(tile.alias("tile"), side.alias("side"), F.col("cls_a").alias("cls"), "low", "high").repartition("tile").sortWithinPartitions("tile")


class NearDuplicates:
    """members (field, id, cls), and links (field, cls_a, cls_b, similarity) between the classes."""

    def __init__(self, records: DataFrame, least: float = THRESHOLD, bucket: int = BUCKET):
        """records: field, id, text; only records of one field are compared."""
        kind = records.schema["id"].dataType.simpleString()
        src = records.select(F.col("field").cast("string"), "id", F.col("text").cast("string"))
        src = src.filter(F.col("field").isNotNull() & F.col("text").isNotNull())
        self.members = src.mapInArrow(lambda it: _classes(it, False), f"field string, id {kind}, cls binary").distinct()
        texts = src.mapInArrow(lambda it: _classes(it, True), "field string, cls binary, text string")
        self.classes = materialize(texts.dropDuplicates(["field", "cls"]), "classes")
        tables = self.classes.mapInArrow(_tables, "key bigint, cls bigint, low bigint, high bigint")
        met_rows = ", ".join(f"{c} bigint" for c in MET)
        met = tables.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _bucket_batches(it, bucket), met_rows)
        met = materialize(met, "met")
        pairs = met.filter("key IS NULL").select("cls_a", "cls_b")
        large = met.filter("key IS NOT NULL")
        if exists(large):
            pairs = pairs.unionByName(_tiled(large, bucket).mapInArrow(_tile_batches, met_rows).select("cls_a", "cls_b"))
        pairs = pairs.distinct()
        wide = self.classes.mapInArrow(_wide, "field string, cls binary, half bigint, " + ", ".join(f"{w} bigint" for w in WIDE))
        a, b = wide.alias("a"), wide.alias("b")
        close = pairs.join(a, F.col("cls_a") == F.col("a.half")).join(b, F.col("cls_b") == F.col("b.half"))
        close = close.filter((F.col("a.field") == F.col("b.field")) & (_agreeing(WIDE) >= WIDE_AGREE)).select("a.field", F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"))
        close = materialize(close, "close")
        ends = close.select("field", F.explode(F.array("cls_a", "cls_b")).alias("cls"))
        ends = F.broadcast(ends) if close.count() <= BROADCAST_PAIRS else ends.distinct()
        texts = self.classes.join(ends, ["field", "cls"], "left_semi")
        one = texts.select("field", F.col("cls").alias("cls_a"), F.col("text").alias("text_a"))
        two = texts.select("field", F.col("cls").alias("cls_b"), F.col("text").alias("text_b"))
        whole = close.join(one, ["field", "cls_a"]).join(two, ["field", "cls_b"]).select("field", "cls_a", "cls_b", "text_a", "text_b")
        self.links = whole.mapInArrow(lambda it: _compare(it, least), "field string, cls_a binary, cls_b binary, similarity double")

    def record_pairs(self) -> DataFrame:
        """(field, id_a, id_b, similarity), id_a < id_b, of all records, members of one class included."""
        m = self.members
        a, b = m.select("field", F.col("id").alias("id_a"), F.col("cls").alias("cls_a")), m.select("field", F.col("id").alias("id_b"), F.col("cls").alias("cls_b"))
        linked = self.links.join(a, ["field", "cls_a"]).join(b, ["field", "cls_b"])
        linked = linked.select("field", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity").filter("id_a < id_b")
        same = a.withColumnRenamed("cls_a", "cls").join(b.withColumnRenamed("cls_b", "cls"), ["field", "cls"]).filter("id_a < id_b")
        return linked.unionByName(same.select("field", "id_a", "id_b", F.lit(1.0).alias("similarity"))).groupBy("field", "id_a", "id_b").agg(F.max("similarity").alias("similarity"))

    def record_classes(self) -> DataFrame:
        """(field, id, cls, n_copies, n_links): one row for each record and class."""
        ends = self.links.select("field", F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("field", "cls").agg(F.count("*").alias("n_links"))
        copies = self.members.groupBy("field", "cls").agg(F.count("*").alias("n_copies"))
        out = self.members.join(copies, ["field", "cls"]).join(ends, ["field", "cls"], "left")
        return out.select("field", "id", F.hex("cls").alias("cls"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
