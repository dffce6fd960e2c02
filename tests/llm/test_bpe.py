import os
import random

import pytest

from sievelight.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no public vocabulary on this machine")

CASES = ["", "a", "   ", "it's I'll 's we've''s don't", "\n'll x", "a" * 37, "x  ", "  x", " 'ss", "'", "''", " 's", "<|endoftext|>",
         "I'dx 'D'", "a'", "a'r", "a're", "日本語 テスト。", "\t\t a\r\n\r\n b 12'll", "é" * 30, "ภาษาไทย", "हिन्दी में", "👩‍🔬 ok", "½ℓ №", "x" * 5000]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(texts):
    ids, counts = bpe.encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_equal_to_the_library():
    rng = random.Random(5)
    texts = CASES + ["".join(rng.choice("a'sdlr ev \n 　t1२é日.") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    assert split(texts) == reference(texts)


def test_one_key_for_two_words_falls_back(monkeypatch):
    monkeypatch.setattr(bpe.flat, "mix", lambda h: h * 0)
    assert split(CASES) == reference(CASES)


def test_rows_nulls_and_extra_columns(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect())
    hello = reference(["Hello world"])[0]
    assert got == sorted([(1, hello), (2, []), (3, []), (1, hello)])
    assert bpe.encode_corpus(df.limit(0)).collect() == []
