"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment.

Words are maximal runs of letters and digits, lower-cased. An n-gram of an item's passage or question is its seed where
it is rare: held by at most `COMMON` different item texts, or by as few as any n-gram of some stretch of `window` words
around it. Rarity is that among the items, not in the corpus, where the n-grams of a passage are frequent just because
it leaked, and where those that an edit destroyed in most copies would pass as the rarest. So every stretch of `window`
words has a seed, whichever copies are edited, and what a document can share with unrelated items stays bounded. A
document that holds a seed is aligned with the item around its seeds by a local Smith-Waterman alignment over words,
which scores paraphrased and edited copies; the longest run of equal words is reported beside it.
Pairs whose longest common subsequence with the passage is below what is asked for are not aligned; no alignment matches
more words. Many pairs are aligned at once, row by row, so that memory grows with the stretch and not with its product
with the passage.

The evaluation side is sent to the workers as sorted arrays while it has at most `BROADCAST_WORDS` words; beyond that
its n-grams and those of the corpus meet in joins. The rule for seeds and the rows are the same.

Defined results: null and empty texts hold nothing; an item without words is never found; an item text shorter than an
n-gram is its own seed; items that share a passage are all reported; copies of a document are each reported; repeated
rows of one document key count once; texts of any length are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize
from . import flat

#: Words of a seed; consecutive words that make a leak; words of the evaluation side that may be sent to every worker.
SEED_WORDS, WINDOW, BROADCAST_WORDS = 5, 13, 2_000_000
#: Item texts up to which an n-gram is rare wherever it stands.
COMMON = 50
#: Evaluation words up to which the n-grams of the corpus are sifted by a bit table before they meet those of the items; its bits.
SIFTED_WORDS, SIFT_BITS = 20_000_000, 28
#: Places of one seed that may meet in one task of a join; seeds with more are spread.
SEED_ROWS, SALTS = 100_000, 64
#: Words of a document on either side of a seed that the alignment sees beyond the length of the item.
MARGIN = 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of a row of many alignments that are computed at once.
CELLS = 1 << 16
BATCH_CHARS = 3_000_000


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, one after the other, and the offsets of the texts in words."""
    low = [t.lower() for t in texts]
    cp, offsets = flat.joined(low)
    n = len(cp)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kind = flat.char_classes()[cp]
    solid = (kind == flat.LETTER) | (kind == flat.DIGIT)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    start = solid & (np.append(True, ~solid[:-1]) | fresh[:n])
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(solid)
    word = np.cumsum(start)[at] - 1
    first = np.searchsorted(at, starts)
    place = (np.arange(len(at)) - first[word]).astype(np.uint64)
    terms = flat.mix((cp[at].astype(np.uint64) << np.uint64(24)) + place + np.uint64(1))
    return flat.mix(np.add.reduceat(terms, first)), np.searchsorted(starts, offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions are left out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def text_grams(words: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of one text; of a shorter text the text itself."""
    return grams(words, min(n, len(words))) if len(words) else words


class Item:
    """Words of the passage and of the question of one evaluation item; the places of each passage word as bits."""

    def __init__(self, item_id, passage: np.ndarray, question: np.ndarray):
        self.item_id, self.passage, self.question = item_id, passage, question

    @functools.cached_property
    def places(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, word in enumerate(self.passage.tolist()):
            out[word] = out.get(word, 0) | 1 << k
        return out

    @functools.cached_property
    def asked(self) -> frozenset:
        return frozenset(self.question.tolist())


def read_items(rows: list) -> list[Item]:
    """Items from rows (item_id, passage, question)."""
    passages, p = word_hashes([r[1] or "" for r in rows])
    questions, q = word_hashes([r[2] or "" for r in rows])
    return [Item(r[0], passages[p[i] : p[i + 1]], questions[q[i] : q[i + 1]]) for i, r in enumerate(rows)]


def rare(counts: np.ndarray, span: int, common: int) -> np.ndarray:
    """Which n-grams of a text are seeds, by their counts among the item texts, in the order of the text: those with at most
    `common`, or as few as any other of some `span` n-grams in a row (of all, where there are fewer)."""
    if not len(counts):
        return np.zeros(0, bool)
    span = min(span, len(counts))
    least = np.lib.stride_tricks.sliding_window_view(counts, span).min(1)
    # the largest of the least counts of all stretches that hold the n-gram
    edge = np.zeros(span - 1, np.int64)
    most = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, least, edge]), span).max(1)
    return counts <= np.maximum(most, common)


class Seeds:
    """Items with their seeds: by number of words the sorted seeds, and for each the numbers of the items that have it.

    dense has for each item the least number of seeds in any `window` words of its passage: a text that holds such a
    stretch as it is has as many seeds near each other.
    """

    def __init__(self, items: list[Item], n: int, window: int, common: int):
        self.items = items
        texts: dict[bytes, list[int]] = {}  # different texts and the items that have them
        for number, item in enumerate(items):
            for words in (item.passage, item.question):
                if len(words):
                    texts.setdefault(words.tobytes(), []).append(number)
        grams_ = {key: text_grams(np.frombuffer(key, np.uint64), n) for key in texts}
        sizes = {key: min(n, len(key) // 8) for key in texts}
        self.keys, self.begin, self.owner = {}, {}, {}
        self.span, self.dense = window - n + 1, {}
        for size in sorted(set(sizes.values())):
            own = [key for key in texts if sizes[key] == size]
            every, counts = np.unique(np.concatenate([np.unique(grams_[key]) for key in own]), return_counts=True)
            seeds, owners = [], []
            for key in own:
                seed = rare(counts[np.searchsorted(every, grams_[key])], self.span, common)
                if len(seed) >= self.span:
                    self.dense[key] = int(np.convolve(seed, np.ones(self.span, np.int64), "valid").min())
                chosen = np.unique(grams_[key][seed])
                for number in set(texts[key]):
                    seeds.append(chosen)
                    owners.append(np.full(len(chosen), number, np.int64))
            pairs = np.unique(np.rec.fromarrays([np.concatenate(seeds), np.concatenate(owners)], names="k,o"))
            self.keys[size], begin = np.unique(pairs.k, return_index=True)
            self.begin[size] = np.append(begin, len(pairs))
            self.owner[size] = np.ascontiguousarray(pairs.o)
        self.dense = [self.dense.get(item.passage.tobytes()) for item in items]

    def near(self, places: list[int], number: int) -> bool:
        """Whether the places of seeds of an item lie as near each other as those of a stretch held as it is."""
        least = self.dense[number]
        return least is not None and any(b - a < self.span for a, b in zip(places, places[least - 1 :]))

    def found(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item number) of every seed in the texts."""
        at, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, keys in self.keys.items():
            if not len(keys):
                continue
            place, seed = hits(words, offsets, {size: keys})
            k = np.searchsorted(keys, seed)
            n = self.begin[size][k + 1] - self.begin[size][k]
            at.append(np.repeat(place, n))
            numbers.append(self.owner[size][flat.ranges(self.begin[size][k], n)])
        return np.concatenate(at), np.concatenate(numbers)


def hits(words: np.ndarray, offsets: np.ndarray, seeds: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed hash) of every seed inside one of the texts."""
    at, keys = [], []
    text_end = np.repeat(offsets[1:], np.diff(offsets))
    for n, sorted_seeds in seeds.items():
        g = grams(words, n)
        if not len(g):
            continue
        # a small filter first: most n-grams of the corpus are no seed
        mask = np.zeros(1 << 20, bool)
        mask[sorted_seeds & np.uint64(0xFFFFF)] = True
        may = np.flatnonzero(mask[g & np.uint64(0xFFFFF)] & (np.arange(len(g)) + n <= text_end[: len(g)]))
        place = np.searchsorted(sorted_seeds, g[may])
        place[place == len(sorted_seeds)] = 0
        sure = sorted_seeds[place] == g[may]
        at.append(may[sure])
        keys.append(g[may][sure])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(keys)


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(score, matched words, longest run of equal words) of the best local alignment of each pair of word sequences.

    Of the alignments with the best score the one with the most matched words counts. Score and matched words lie in one
    number; a gap along a row is a running maximum of score + GAP * distance. Pairs of like size share a block.
    """
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(pairs)
    order = sorted((k for k, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end - begin + 1) * len(pairs[order[end]][1]) <= CELLS:
            end += 1
        some = order[begin:end]
        for k, result in zip(some, _align_block([pairs[k] for k in some])):
            out[k] = result
        begin = end
    return out


def _align_block(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    size, m, rows = len(pairs), max(len(b) for _, b in pairs), max(len(a) for a, _ in pairs)
    # beyond the end of a text stand words that equal no other
    text, valid = np.zeros((size, m), np.uint64), np.zeros((size, m), bool)
    passage = np.zeros((rows, size), np.uint64)
    live = np.array([len(a) for a, _ in pairs])
    for k, (a, b) in enumerate(pairs):
        text[k, : len(b)], valid[k, : len(b)], passage[: len(a), k] = b, True, a
    one = np.int64(1) << 32
    slope = np.arange(m + 1, dtype=np.int64) * (-GAP * one)
    before, now = np.zeros((size, m + 1), np.int64), np.zeros((size, m + 1), np.int64)
    run, most, best = np.zeros((size, m + 1), np.int32), np.zeros((size, m), np.int32), np.zeros(size, np.int64)
    for i in range(rows):
        same = (text == passage[i][:, None]) & valid & (i < live)[:, None]
        step = np.where(same, MATCH * one + 1, MISMATCH * one)
        np.maximum(before[:, :-1] + step, before[:, 1:] + GAP * one, out=now[:, 1:])
        now[:, 0] = 0
        now[now < one] = 0  # a local alignment begins anew where its score is none
        now += slope
        np.maximum.accumulate(now, axis=1, out=now)
        now -= slope
        now[now < one] = 0
        np.maximum(best, np.where(i < live, now.max(1), 0), out=best)
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        np.maximum(most, run[:, 1:], out=most)
        before, now = now, before
    return [(int(v >> 32), int(v & 0xFFFFFFFF), int(r)) for v, r in zip(best, most.max(1))]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The same for one pair."""
    return align_many([(a, b)])[0]


def common(words: list[int], item: Item) -> int:
    """Length of the longest common subsequence of the words and the passage, in the bits of one number."""
    full = (1 << len(item.passage)) - 1
    open_, places = full, item.places
    for at in filter(None, map(places.get, words)):
        same = open_ & at
        open_ = ((open_ + same) | (open_ - same)) & full
    return len(item.passage) - open_.bit_count()


def stretches(places: list[int], item: Item) -> list[tuple[int, int]]:
    """Begin and end of the words that an alignment sees: the surroundings of the seeds, joined where they are near each other."""
    reach = max(len(item.passage), len(item.question)) + MARGIN
    out: list[tuple[int, int]] = []
    last = None
    for place in sorted(places):
        begin = out.pop()[0] if last is not None and place - last <= reach else max(0, place - reach)
        out.append((begin, place + reach))
        last = place
    return out


def holds(words: list[int], part: list[int]) -> bool:
    return any(words[k : k + len(part)] == part for k, word in enumerate(words) if word == part[0])


def may_match(words: list[int], known: set[int], places: list[int], item: Item, least: float) -> bool:
    """Whether an alignment could match the least share of the passage, or the text hold the question; False is certain.

    known is the set of words. The words the passage shares with the whole text are counted first.
    """
    if item.asked and item.asked <= known and holds(words, item.question.tolist()):
        return True
    if least > 1:
        return False
    size = max(1, len(item.passage))
    if sum(item.places[word].bit_count() for word in item.places.keys() & known) / size < least:
        return False
    return any(common(words[a:b], item) / size >= least for a, b in stretches(places, item))


def compare_many(pairs: list[tuple[np.ndarray, list[int], Item]]) -> list[tuple[int, float, int, bool]]:
    """(score, share of the passage's words matched, longest exact run in the passage, whole question held) near the seeds of each (words, places, item)."""
    parts = [(number, words[a:b]) for number, (words, places, item) in enumerate(pairs) for a, b in stretches(places, item)]
    aligned = align_many([(pairs[number][2].passage, stretch) for number, stretch in parts])
    best = [(0, 0.0, 0)] * len(pairs)
    question = [False] * len(pairs)
    for (number, stretch), (score, matched, run) in zip(parts, aligned):
        item = pairs[number][2]
        was = best[number]
        score, share, _ = max(was, (score, matched / max(1, len(item.passage)), run))
        best[number] = (score, share, max(was[2], run))
        q = item.question
        if len(q) and len(stretch) >= len(q) and not question[number]:
            at = np.flatnonzero(stretch[: len(stretch) - len(q) + 1] == q[0])
            question[number] = any(bool((stretch[k : k + len(q)] == q).all()) for k in at)
    return [(*b, q) for b, q in zip(best, question)]


def compare(words: np.ndarray, places: np.ndarray, item: Item) -> tuple[int, float, int, bool]:
    """The same for one pair."""
    return compare_many([(words, places.tolist(), item)])[0]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
    for a, b in flat.slices(np.array([len(t) for t in texts], np.int64), BATCH_CHARS):
        words, offsets = word_hashes(texts[a:b])
        yield a, b, words, offsets


RESULT = "item_id bigint, score bigint, matched double, longest_run bigint, question boolean"
NAMES = ["id", *[f.split()[0] for f in RESULT.split(", ")]]
KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]


def _align_batches(batches: Iterator[pa.RecordBatch], sent, asked: Asked) -> Iterator[pa.RecordBatch]:
    seeds: Seeds = sent.value
    for batch in batches:
        rows: list[int] = []
        pairs: list[tuple[np.ndarray, list[int], Item]] = []
        for a, _, words, offsets in _texts(batch):
            at, number = seeds.found(words, offsets)
            if not len(at):
                continue
            text = np.searchsorted(offsets, at, side="right") - 1
            order = np.lexsort((at, number, text))
            text, number, at = text[order], number[order], at[order]
            edges = np.append(np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (number[1:] != number[:-1]))), len(at))
            last = -1
            for begin, end in zip(edges, edges[1:]):
                t, item = int(text[begin]), seeds.items[number[begin]]
                if t != last:
                    last, whole = t, words[offsets[t] : offsets[t + 1]]
                    own = whole.tolist()
                    known = set(own)
                places = (at[begin:end] - offsets[t]).tolist()
                chained = not asked.exact or seeds.near(places, number[begin])
                if may_match(own, known, places, item, asked.share(item) if chained else 2.0):
                    rows.append(a + t)
                    pairs.append((whole, places, item))
        columns = list(zip(*compare_many(pairs))) or [[]] * 4
        columns = [[p[2].item_id for p in pairs], *columns]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, KINDS)]], NAMES)


class Asked:
    """Which rows are wanted: a least share of matched words, or exact runs of `window` words; always those with the whole question."""

    def __init__(self, least: float, exact: bool, window: int):
        self.least, self.exact, self.window = least, exact, window

    def share(self, item: Item) -> float:
        """Share of the passage that an alignment must match to be wanted."""
        return self.window / max(1, len(item.passage)) if self.exact else self.least

    def rows(self, df: DataFrame) -> DataFrame:
        if self.exact:  # the score of the alignment, then the exact run
            return df.filter(((F.col("score") >= MATCH * self.window) & (F.col("longest_run") >= self.window)) | F.col("question"))
        return df.filter(((F.col("score") > 0) & (F.col("matched") >= self.least)) | F.col("question"))


def _gram_batches(batches: Iterator[pa.RecordBatch], n: int, sift) -> Iterator[pa.RecordBatch]:
    """(id, seed) of every run of up to n words that the bit table lets pass; shorter runs matter where a whole item text is that short."""
    for batch in batches:
        for a, b, words, offsets in _texts(batch):
            of = np.repeat(np.arange(b - a), np.diff(offsets))
            for size in range(1, n + 1):
                g = grams(words, size)
                text = of[: len(g)]
                at = np.flatnonzero(np.arange(len(g)) + size <= offsets[1:][text]) if len(g) else np.zeros(0, np.int64)
                if sift is not None:
                    at = at[sifted(sift.value, g[at])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + text[at])), pa.array(g[at].view(np.int64))], ["id", "seed"])


def sifted(table: np.ndarray, g: np.ndarray) -> np.ndarray:
    low = g & np.uint64((1 << SIFT_BITS) - 1)
    return (table[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _text_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(item_id, part, whole, pos, size, seed) of every n-gram of the item texts (item_id, part, text); of a shorter text the text itself.

    whole tells different texts apart, size is their number of n-grams.
    """
    for batch in batches:
        rows, whole, at, size, seeds = [], [], [], [], []
        for a, b, words, offsets in _texts(batch):
            for t in range(b - a):
                text = words[offsets[t] : offsets[t + 1]]
                own = text_grams(text, n)
                key = np.bitwise_xor.reduce(flat.mix(text + np.arange(len(text), dtype=np.uint64))) if len(text) else np.uint64(0)
                rows += [a + t] * len(own)
                whole += [int(key.view(np.int64))] * len(own)
                at += range(len(own))
                size += [len(own)] * len(own)
                seeds.append(own)
        keys = [batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 1)]
        ints = [pa.array(x, pa.int64()) for x in (whole, at, size)]
        yield pa.RecordBatch.from_arrays([*keys, *ints, pa.array(np.concatenate([np.zeros(0, np.uint64), *seeds]).view(np.int64))], ["item_id", "part", "whole", "pos", "size", "seed"])


def _pair_batches(batches: Iterator[pa.RecordBatch], n: int, asked: Asked) -> Iterator[pa.RecordBatch]:
    """Alignment of joined pairs (id, item_id, seeds, passage, question, text)."""
    for batch in batches:
        lists, texts = batch.column(2).to_pylist(), batch.column(5).to_pylist()
        items = read_items(list(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())))
        rows, pairs = [], []
        for r, (own, item, text) in enumerate(zip(lists, items, texts)):
            words, offsets = word_hashes([text or ""])
            chosen = np.unique(np.array(own, np.int64).view(np.uint64))
            sizes = {min(n, len(w)) for w in (item.passage, item.question) if len(w)}
            found = [hits(words, offsets, {size: chosen})[0] for size in sizes]
            places = sorted({p for at in found for p in at.tolist()})
            own_words = words.tolist()
            if places and may_match(own_words, set(own_words), places, item, asked.share(item)):
                rows.append(r)
                pairs.append((words, places, item))
        columns = list(zip(*compare_many(pairs))) or [[]] * 4
        taken = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *[pa.array(c, k) for c, k in zip(columns, KINDS[1:])]], NAMES)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SEED_WORDS, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS, least: float = 0.0, exact: bool = False, common: int = COMMON) -> DataFrame:
    """(id, item_id, score, matched, longest_run, question) of every document and item that share a seed.

    items has item_id, passage and question. score and matched (share of the passage's words) are those of the best
    local alignment, longest_run counts equal consecutive words, question tells that the whole question is held.
    least keeps the rows with that share of matched words, or the question; exact those whose alignment scores as much as
    a run of `window` words and holds such a run, or the question.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = items.select(F.col("item_id").cast("bigint"), F.col("passage").cast("string"), F.col("question").cast("string"))
    asked = Asked(least, exact, window)
    chars = held.agg(F.sum(F.coalesce(F.length("passage"), F.lit(0)) + F.coalesce(F.length("question"), F.lit(0))).cast("bigint")).first()[0] or 0
    if chars > 6 * broadcast_words:
        return asked.rows(_joined(src, held, kind, n, window, common, asked, chars)).withColumnRenamed("id", id_col)
    sent = spark.sparkContext.broadcast(Seeds(read_items([tuple(r) for r in held.collect()]), n, window, common))
    out = src.mapInArrow(lambda it: _align_batches(it, sent, asked), f"id {kind}, {RESULT}")
    return asked.rows(out.dropDuplicates(["id", "item_id"])).withColumnRenamed("id", id_col)


def _joined(src: DataFrame, held: DataFrame, kind: str, n: int, window: int, common: int, asked: Asked, chars: int) -> DataFrame:
    """The same for an evaluation side of any size: n-grams are counted and met in joins, texts are joined to pairs."""
    spark = src.sparkSession
    texts = held.select("item_id", F.posexplode(F.array("passage", "question")).alias("part", "text"))
    own = materialize(texts.mapInArrow(lambda it: _text_batches(it, n), "item_id bigint, part int, whole bigint, pos bigint, size bigint, seed bigint"), "item_grams")
    span = window - n + 1
    w = W.partitionBy("item_id", "part").orderBy("pos")
    counts = own.groupBy("seed").agg(F.count_distinct("whole").alias("n"))
    fits = F.col("pos") <= F.greatest(F.col("size") - span, F.lit(0))
    least = own.join(counts, "seed").withColumn("least", F.when(fits, F.min("n").over(w.rowsBetween(0, span - 1))))
    most = least.withColumn("most", F.max("least").over(w.rowsBetween(1 - span, 0)))
    seeds = materialize(most.filter(F.col("n") <= F.greatest("most", F.lit(common))).select("seed", "item_id").distinct(), "seeds")
    sift = None
    if chars <= 6 * SIFTED_WORDS:  # low bits of the seeds; a bit table of 32 MB
        bits = seeds.select(F.col("seed").bitwiseAND((1 << SIFT_BITS) - 1).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)
        table = np.zeros(1 << SIFT_BITS - 3, np.uint8)
        np.bitwise_or.at(table, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
        sift = spark.sparkContext.broadcast(table)
    corpus = src.mapInArrow(lambda it: _gram_batches(it, n, sift), f"id {kind}, seed bigint")
    # a seed with many places is spread: its places by the hash of their document, the items' side once for each salt
    heavy = corpus.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") > SEED_ROWS)
    heavy = materialize(heavy.select("seed", F.least(F.ceil(F.col("n") / SEED_ROWS).cast("int"), F.lit(SALTS)).alias("salts")), "heavy")
    heavy = F.broadcast(heavy) if heavy.count() <= SEED_ROWS else heavy
    salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0))
    placed = corpus.join(heavy, "seed", "left").select("id", "seed", salt.alias("salt"))
    wanted = seeds.join(heavy, "seed", "left").select("seed", "item_id", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    pairs = placed.join(wanted, ["seed", "salt"]).groupBy("id", "item_id").agg(F.collect_set("seed").alias("seeds"))
    whole = pairs.join(held, "item_id").join(src.dropDuplicates(["id"]), "id").select("id", "item_id", "seeds", "passage", "question", "text")
    return whole.mapInArrow(lambda it: _pair_batches(it, n, asked), f"id {kind}, {RESULT}")
