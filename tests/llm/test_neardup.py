import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from sievelight.llm import neardup
from sievelight.llm.neardup import MASKS, NearDuplicates, normalise, sketches


def share(a, b):
    a, b = normalise(a), normalise(b)
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def make(seed=3, n=160):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)] + ["城市", "ทุกปี", "É"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(4, 30))) for _ in range(n)]
    for _ in range(n):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, max(1, len(t) // 25))):
            t[rng.randrange(len(t))] = rng.choice("xyz  ")
        texts.append("".join(t) if rng.random() < 0.9 else "".join(t).upper() + " \n")
    return texts + ["abc", "ABC ", "abd", "x", "", "  ", None, "ab c"]


def test_masks_cover_radius_two():
    for differing in itertools.combinations(range(7), 2):
        assert any(not set(differing) & set(m) for m in MASKS)
    assert all(len(m) == 4 for m in MASKS)


def test_symbols_agree_as_often_as_similar():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    b = a[:2600] + "".join(rng.choice("abcdefghij ") for _ in range(400))
    s = sketches([normalise(a), normalise(b)])
    assert abs((s[0] == s[1]).mean() - share(a, b)) < 0.2


@pytest.mark.parametrize(("bound", "bucket"), [(500_000, 2048), (0, 2048), (500_000, 1), (0, 2)])
def test_against_all_pairs(spark, monkeypatch, bound, bucket):
    monkeypatch.setattr(neardup, "BROADCAST_PAIRS", bound)
    texts = make()
    rows = [("t", f"i{k:04d}", t, 0) for k, t in enumerate(texts)] + [("u", "i0000", texts[0], 0), ("u", "z", texts[0] + "!", 0), (None, "n", "abc", 0)]
    df = spark.createDataFrame(rows + rows[:30], "field string, id string, text string, cls int")
    near = NearDuplicates(df, bucket=bucket)
    got = {(r.field, r.id_a, r.id_b): r.similarity for r in near.record_pairs().collect()}
    live = [(r[1], r[2]) for r in rows if r[0] == "t" and normalise(r[2])]
    want = {("t", a[0], b[0]): share(a[1], b[1]) for a, b in itertools.combinations(live, 2)}
    want = {k: v for k, v in want.items() if v >= 0.7} | {("u", "i0000", "z"): share(texts[0], texts[0] + "!")}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    classes = {(r.field, r.id): r for r in near.record_classes().collect()}
    assert len(classes) == len(live) + 2 and classes["t", "i0320"].n_copies >= 2
    assert NearDuplicates(df.limit(0)).record_pairs().collect() == []


def test_fingerprint_is_a_function_of_the_text():
    a, b = sketches(["same text here"]), sketches(["other", "same text here"])
    assert (a[0] == b[1]).all() and not np.array_equal(b[0], b[1])


def test_a_bucket_of_many_classes_goes_in_tiles():
    """One key for 100,000 classes: all rows come out again, in bounded batches, and are compared in no place."""
    n, size = 100_000, 10_000
    rng = np.random.default_rng(2)
    cls, low, high = (rng.integers(-(1 << 62), 1 << 62, n) for _ in range(3))
    key = np.sort(np.concatenate([np.full(n - 6, 7), [1, 1, 3, 9, 9, 9]]))
    low[:2], high[:2], low[-3:], high[-3:] = 5, 5, 6, 6
    batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + size]) for x in (key, cls, low, high)], ["key", "cls", "low", "high"]) for k in range(0, n, size)]
    out = list(neardup._bucket_batches(iter(batches), 2048))
    assert max(b.num_rows for b in out) <= size + 2048
    rows = pa.Table.from_batches(out).to_pandas()
    assert sorted(rows[rows.key == 7].cls_a) == sorted(cls[key == 7])
    assert len(rows[rows.key.isna()]) == 1 + 3


@pytest.mark.parametrize("size", [1, 3, 50])
def test_buckets_across_batches(size):
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 30, 200))
    cls, low, high = np.arange(200), rng.integers(0, 2, 200) * -1, np.zeros(200, np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + size]) for x in (key, cls, low, high)], ["key", "cls", "low", "high"]) for k in range(0, 200, size)]
    for most in (4, 1000):
        rows = pa.Table.from_batches(neardup._bucket_batches(iter(batches), most)).to_pandas()
        sizes = dict(zip(*np.unique(key, return_counts=True)))
        want = {(i, j) for i in range(200) for j in range(i + 1, 200) if key[i] == key[j] and sizes[key[i]] <= most}
        pairs = rows[rows.key.isna()]
        assert set(zip(pairs.cls_a, pairs.cls_b)) == want
        assert sorted(rows[rows.key.notna()].cls_a) == [i for i in range(200) if sizes[key[i]] > most]
