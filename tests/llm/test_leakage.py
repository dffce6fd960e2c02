import random
import re

import numpy as np
import pytest

from sievelight.llm.leakage import SEED_WORDS, align, align_many, common, compare, leaks, rare, read_items, word_hashes

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, window=13):
    out = set()
    for doc_id, text in docs:
        words = WORD.findall((text or "").lower())
        runs = {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}
        for item_id, passage, question in items:
            p, q = WORD.findall((passage or "").lower()), WORD.findall((question or "").lower())
            held = any(tuple(p[i : i + window]) in runs for i in range(len(p) - window + 1))
            if held or q and any(words[i : i + len(q)] == q for i in range(len(words) - len(q) + 1)):
                out.add((doc_id, item_id))
    return out


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "слово", "2024"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([0, 5, 20, 40])), say(rng.choice([1, 2, 4, 9]))) for i in range(12)]
    items += [(20, None, ""), (21, items[3][1], "w1 w2 w3 w4 w5 w6 w7")]
    docs = []
    for d in range(120):
        text = say(rng.randint(0, 60))
        _, passage, question = rng.choice(items)
        part = (passage or "").split()
        if rng.random() < 0.5 and len(part) > 14:
            a = rng.randint(0, len(part) - 12)
            text += ", " + "; ".join(part[a : a + rng.randint(11, 16)]).upper() + "! " + say(3)
        if rng.random() < 0.3:
            text += " " + (question or "") + "? " + say(2)
        docs.append((d, text))
    return docs + [(500, None), (501, ""), (502, "---")], items


@pytest.mark.parametrize(("bound", "common"), [(2_000_000, 50), (2_000_000, 0), (1, 50), (1, 0)])
def test_against_brute_force(spark, bound, common):
    docs, items = make(7)
    d = spark.createDataFrame([(a, b, 0) for a, b in docs + docs[:5]], "doc_id long, text string, score int")
    i = spark.createDataFrame(items, "item_id long, passage string, question string")
    rows = leaks(d, i, broadcast_words=bound, common=common).collect()
    got = [(r.doc_id, r.item_id) for r in rows if r.longest_run >= 13 or r.question]
    sure = {(r.doc_id, r.item_id) for r in leaks(d, i, broadcast_words=bound, common=common, exact=True).collect()}
    assert sure == set(got)
    assert set(got) == brute(docs, items) and len(got) == len(set(got))
    assert leaks(d.limit(0), i, broadcast_words=bound).collect() == []
    assert leaks(d, i.limit(0)).collect() == []


def test_alignment_scores_edited_copies():
    passage, copy = "the guild of a sold the old mill and its roof in may", "then the guild of a bought the old mill with its roof in june"
    words, o = word_hashes([passage, copy])
    score, matched, run = align(words[: o[1]], words[o[1] :])
    assert (matched, run) == (10, 4) and score == 2 * 10 - 2
    assert align(words[:0], words) == (0, 0, 0)


def test_words_are_runs_of_letters_and_digits():
    texts = ["Ab_c d2-É", "", "ab c", "क़ि x", "D2 é"]
    words, o = word_hashes(texts)
    assert [int(o[k + 1] - o[k]) for k in range(5)] == [len(WORD.findall(t.lower())) for t in texts]
    assert words[0] == words[4] and words[1] == words[5] and (words[2:4] == words[-2:]).all()


def shared(docs, items, n=SEED_WORDS):
    """Every document and item with a common n-gram (or a whole shorter text of the item), aligned from all common places."""
    held = read_items(items)
    out = {}
    for doc_id, text in docs:
        words, _ = word_hashes([text or ""])
        for item in held:
            at = []
            for own in (item.passage, item.question):
                size = min(n, len(own))
                runs = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
                at += [k for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in runs]
            if at:
                result = compare(words, np.array(at), item)
                if result[0] > 0 or result[3]:
                    out[doc_id, item.item_id] = result
    return out


def edited(passage, step):
    """Every step-th word replaced."""
    return " ".join(f"other{k}" if k % step == step - 1 else w for k, w in enumerate(passage.split()))


def with_edits():
    docs, items = make(11)
    docs += [(1000 + k, f"so they said {edited(p, 8)} and left") for k, (_, p, _) in enumerate(items) if p and len(p.split()) >= 20]
    return docs, items


def test_copies_edited_every_8_words(spark):
    docs, items = with_edits()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, question string")
    want = shared(docs, items)
    copies = {k for k, v in want.items() if k[0] >= 1000 and v[1] >= 0.5}
    assert len({k[0] for k in copies}) == sum(a >= 1000 for a, _ in docs) > 3
    rows = {(r.doc_id, r.item_id): (r.score, r.matched, r.longest_run, r.question) for r in leaks(d, i).collect()}
    assert rows == want
    half = {(r.doc_id, r.item_id): (r.score, r.matched, r.longest_run, r.question) for r in leaks(d, i, least=0.5).collect()}
    assert half == {k: v for k, v in want.items() if v[1] >= 0.5 or v[3]}


def test_no_alignment_matches_more_than_the_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 90))] for _ in range(2))
        item = read_items([(0, " ".join(a), "")])[0]
        words, _ = word_hashes([" ".join(b)])
        line = [0] * (len(b) + 1)
        for x in a:
            line = _row(line, x, b)
        assert common(words.tolist(), item) == line[-1] >= round(align(item.passage, words)[1])


def _row(before, x, b):
    now = [0]
    for k, y in enumerate(b):
        now.append(before[k] + 1 if x == y else max(before[k + 1], now[k]))
    return now


def test_both_paths_give_the_same_rows(spark):
    docs, items = with_edits()
    docs += [(2000, "here a small stone bridge crosses it"), (2001, "see the small stone bridge crosses slowly today")]
    items += [(30, "a small stone bridge crosses the small stone bridge crosses slowly", "")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, question string")
    for asked in ({}, {"least": 0.5}, {"exact": True}):
        small, large = (sorted(map(tuple, leaks(d, i, broadcast_words=bound, **asked).collect())) for bound in (2_000_000, 1))
        assert small == large and small
        assert "exact" in asked or {r[0] for r in small if r[1] == 30} >= {2001}


@pytest.mark.parametrize("bound", [2_000_000, 1])
def test_planted_copies_with_one_word_in_a_few_changed(spark, bound):
    """Copies of 40 passages, edited at four rates, the most edited ones far more often than the passages as they are."""
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(60)), "") for k in range(40)]
    docs = [(k, "before it " + p) for k, (_, p, _) in enumerate(items)]
    for rate in (6, 8, 10, 12):
        docs += [(1000 * rate + 100 * copy + k, f"some text {edited(p, rate)} goes on") for copy in range(6 if rate == 6 else 1) for k, (_, p, _) in enumerate(items)]
    docs += [(90_000 + k, " ".join(rng.choice(vocab) for _ in range(80))) for k in range(200)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, question string")
    for common in (50, 0):
        rows = {(r.doc_id, r.item_id): r for r in leaks(d, i, broadcast_words=bound, least=0.5, common=common).collect()}
        want = {(a, a % 100) for a, _ in docs if a < 90_000}
        assert set(rows) == want
        assert all(0.8 <= r.matched <= 1.0 for r in rows.values())


def test_rare_ngrams():
    assert rare(np.array([9, 9, 9, 2, 9, 9, 9, 9, 9]), 4, 0).tolist() == [False] * 3 + [True] * 6
    assert rare(np.array([9, 1, 9]), 5, 0).tolist() == [False, True, False] and rare(np.array([9, 1, 9]), 5, 9).all() and not len(rare(np.zeros(0, int), 5, 1))


def test_many_alignments_at_once_equal_single_ones():
    rng = np.random.default_rng(7)
    pairs = [(rng.integers(1, 6, rng.integers(0, 40)).astype(np.uint64), rng.integers(1, 6, rng.integers(0, 90)).astype(np.uint64)) for _ in range(150)]
    for (a, b), (score, matched, run) in zip(pairs, align_many(pairs)):
        table = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
        best, longest, runs = (0, 0), 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                (d, dm), (u, um), (le, lm) = table[i - 1][j - 1], table[i - 1][j], table[i][j - 1]
                cell = max((d + (2 if same else -1), dm + int(same)), (u - 1, um), (le - 1, lm))
                table[i][j] = cell if cell[0] > 0 else (0, 0)
                runs[i][j] = runs[i - 1][j - 1] + 1 if same else 0
                best, longest = max(best, table[i][j]), max(longest, runs[i][j])
        assert (score, matched, run) == (*best, longest)
