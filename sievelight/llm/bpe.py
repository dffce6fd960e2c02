"""Encoding of a corpus with a public byte-level BPE vocabulary, by batched numpy merge rounds.

Words are cut by the vocabulary's published pattern, evaluated over whole batches of code points at once. The distinct
words of a batch lie in one flat symbol array; each round looks up all adjacent pairs by binary search over the sorted
pair keys of the merge list, merges the lowest-ranked pair of every word, and ends words without a further merge.

Defined results: null and empty texts give an empty list; texts of any length are encoded whole; repeated rows and
copies give a row each; columns of the input besides the two named are ignored.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat

#: Where the public vocabulary lies on the machines; a parameter of every entry point.
VOCABULARY = os.environ.get("BYTE_BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
#: Characters encoded at once; bounds the memory of a worker, never the text.
BATCH_CHARS = 3_000_000
NONE = np.uint32(0xFFFFFFFF)


class Merges:
    """Sorted pair keys with rank and result, and the id of each byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.byte_ids = np.array([vocab[names[b]] for b in range(256)], np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.bits, self.kind = (16, np.uint32) if max(vocab.values()) < 1 << 16 else (32, np.uint64)
        keys = (left << np.uint64(self.bits) | right).astype(self.kind)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.uint32)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.uint32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is not in the merge list."""
        keys = left.astype(self.kind) << self.kind(self.bits) | right.astype(self.kind)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank[at], NONE)


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


def word_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True at the first code point of each word of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|space+(?!\\S)|space+."""
    n = len(cp)
    kind = flat.char_classes()[cp]
    first = np.zeros(n + 3, bool)
    first[offsets[:-1]] = True
    first[n:] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    begins = np.flatnonzero(run[:n])
    # the last white-space character before a word stands alone or, if a blank, opens the word
    solid = begins[(kind[begins] != flat.SPACE) & ~first[begins]]
    after = solid[kind[solid - 1] == flat.SPACE]
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    # contractions open at an apostrophe that no blank or other mark precedes
    quote = np.flatnonzero((cp == 39) & start[:n] & run[1 : n + 1] & ~first[1 : n + 1])
    if len(quote):
        wide = np.concatenate([cp, np.zeros(3, cp.dtype)])
        kinds = np.concatenate([kind, np.full(3, flat.OTHER, np.uint8)])
        a, b = wide[quote + 1], np.where(first[quote + 2], 0, wide[quote + 2])
        one = np.isin(a, [ord(c) for c in "sdmt"])
        two = ((a == ord("l")) & (b == ord("l"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("r")) & (b == ord("e")))
        for where, length in ((quote[one], 2), (quote[two], 3)):
            start[where + 1] = False
            rest = where + length
            start[rest[(kinds[rest] == flat.LETTER) & ~first[rest]]] = True
    return start[:n]


def distinct_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and lengths of the distinct words, and the number of the distinct word of each word."""
    lengths = np.diff(np.append(starts, len(data)))
    inside = np.arange(len(data)) - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    key = flat.mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[inside], starts) ^ lengths.astype(np.uint64) << np.uint64(48))
    number, keys = pd.factorize(key)
    first = np.empty(len(keys), np.int64)
    first[number[::-1]] = np.arange(len(key) - 1, -1, -1)
    same = lengths[first][number] == lengths
    if same.all() and (data[np.repeat(starts[first][number], lengths) + inside] == data).all():
        return starts[first], lengths[first], number
    seen: dict[bytes, int] = {}  # two words with one key: fall back to the bytes themselves
    number = np.array([seen.setdefault(data[s : s + k].tobytes(), len(seen)) for s, k in zip(starts, lengths)])
    _, first = np.unique(number, return_index=True)
    return starts[first], lengths[first], number


def merge_rounds(model: Merges, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and the number of ids of each word."""
    count = len(lengths)
    word = np.repeat(np.arange(count, dtype=np.int32), lengths)
    rank = np.full(len(sym), NONE, np.uint32)
    inner = np.flatnonzero(word[1:] == word[:-1]) if len(sym) > 1 else np.zeros(0, np.int64)
    rank[inner] = model.ranks(sym[inner], sym[inner + 1])
    ended: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        low = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        over = low == NONE
        if over.any():
            gone = np.repeat(over, sizes)
            ended.append((word[gone], sym[gone]))
            sym, word, rank = sym[~gone], word[~gone], rank[~gone]
            low, sizes = low[~over], sizes[~over]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(low, sizes))
        if len(at) > 1:  # of overlapping pairs (aaa) every second one, from the left
            new = np.append(True, np.diff(at) != 1) | np.append(True, word[at[1:]] != word[at[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        sym[at] = model.result[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = (np.cumsum(keep) - 1)[at]
        sym, word, rank = sym[keep], word[keep], rank[keep]
        touched = np.zeros(len(sym), bool)
        touched[moved] = True
        touched[np.maximum(moved, 1) - 1] = True
        again = np.flatnonzero(touched)
        follow = np.minimum(again + 1, len(sym) - 1)
        pair = (again + 1 < len(sym)) & (word[again] == word[follow])
        rank[again] = NONE
        again = again[pair]
        rank[again] = model.ranks(sym[again], sym[again + 1])
    words = np.concatenate([w for w, _ in ended]) if ended else np.zeros(0, np.int32)
    ids = np.concatenate([s for _, s in ended]) if ended else np.zeros(0, np.uint32)
    order = np.argsort(words, kind="stable")
    return ids[order].astype(np.int32), np.bincount(words, minlength=count)


def encode(texts: list[str], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the number of ids of each text."""
    model = merges(path)
    cp, offsets = flat.joined(texts)
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    data = np.frombuffer("".join(texts).encode("utf-8", "replace"), np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    starts = np.flatnonzero(word_starts(cp, _bounds(offsets)))
    at, size, number = distinct_words(data, heads[starts])
    ids, counts = merge_rounds(model, model.byte_ids[data[flat.ranges(at, size)]], size)
    begin = np.cumsum(counts) - counts
    many = counts[number]
    out = ids[flat.ranges(begin[number], many)]
    total = np.append(0, np.cumsum(many))
    return out, np.diff(total[np.searchsorted(starts, offsets)])


def _bounds(offsets: np.ndarray) -> np.ndarray:
    """The offsets without those of empty texts."""
    return np.append(offsets[:-1][np.diff(offsets) > 0], offsets[-1])


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        lengths = np.array([len(t) for t in texts], np.int64)
        for a, b in flat.slices(lengths, BATCH_CHARS):
            out, counts = encode(texts[a:b], path)
            offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(out))], ["id", "ids"])


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row (id, ids) for each row of df, encoded without special tokens; a narrow map with no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _encode_batches(it, vocabulary), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
