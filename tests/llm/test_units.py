import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelight.llm.sentences import sentence_units, unit_spans, unit_starts
from sievelight.llm.split import pieces, split_oversized


def cut(text):
    return [text[a:b] for a, b in unit_spans(text)]


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. J. R. Smith of Mt. Fell paid 9.5 crowns.", "It rose from 3.6% to 7% ... and then fell.", "See Fig. 5 and vol. 8, p. 730, of the U.S. catalogue."],
        ["“Who sold the mill?” asked the guild.", "“It is cold. We wait,” the envoy wrote.", "The hemp came from A, B, etc.", "It opened at 11 a.m.", "Its owner left."],
        ["„Wer hat das?“, fragte die Akademie.", "Am 9. Mai 1725 brannte es z. B. in Ulm.", "Es gab Seide usw.", "Dann nicht."],
        ["« Qui a vu la tour ? » demanda la guilde.", "Vers 24 av. J.-C., elle comptait 5,17 ha.", "P. ex. le vol. 1 (éd. X, p. 136) cite Y."],
        ["Era de A y B S. A.", "—¿Dónde está C? —preguntó la liga.", "Los EE. UU. compraron seda."],
        ["«Кто видел Б?» — спросила гильдия.", "В 1156 г. в с. К жило 38,5 тыс. человек, т. е. больше.", "На ул. П, напр., стоит дом."],
        ["(See also the mosaic of X, approx. 41 ft. from Y.)", "The end (est. 2015; cf. V no. 4) came."],
    ],
)
def test_units_with_blanks(units):
    assert cut(" ".join(units)) == units


@pytest.mark.parametrize(
    "units",
    [
        ["使者说：“天冷了。我们在里等玻璃。”", "“谁修复了市场？”公司问道。", "1540年大火烧毁了2735间房屋。"],
        ["「図書館はどこですか。」と人が尋ねた。", "城は閉じた。", "橋はあるのか？", "そうだ。"],
    ],
)
def test_units_without_blanks(units):
    assert cut("".join(units)) == units


def test_lines_lists_and_scripts():
    assert cut("one line\nwraps here. Next\n\nHeading\n\n- first item, 1819. After it\n2. second item") == [
        "one line\nwraps here.", "Next", "Heading", "- first item, 1819.", "After it", "2. second item"]
    assert cut("ไฟไหม้ตลาด ส่งกระดาษ") == ["ไฟไหม้ตลาด", "ส่งกระดาษ"]
    assert cut("डॉ. क ने देखा। क्या है? हाँ।") == ["डॉ. क ने देखा।", "क्या है?", "हाँ।"]
    assert cut("a | b | 3\nc | d | 4") == ["a | b | 3\nc | d | 4"]
    assert cut("(never closed. Still two. Three") == ["(never closed.", "Still two.", "Three"]
    assert unit_starts("") == [] == unit_starts(" \n ") and unit_spans(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n“”()。A1-", max_size=80))
def test_units_cover_the_text(text):
    spans = unit_spans(text)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered or text[i].isspace() for i in range(len(text)))
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])) and all(a < b for a, b in spans)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n。é́A", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_pieces_are_a_round_trip(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert "".join(text[b:c] for _, b, c in got) == text
    assert all(c - a <= limit for a, _, c in got)
    for (a, _, before), (start, core, _) in zip(got, got[1:]):
        assert core == before and a <= start <= core and core - start <= overlap


def test_pieces_end_at_strong_boundaries():
    text = " ".join(f"Sentence number {i} has a few more words." for i in range(60))
    got = pieces(text)
    assert len(got) > 2 and all(text[c - 1] == "." for _, _, c in got) and all(core - a == 100 for a, core, _ in got[1:])
    assert max(c - a for a, _, c in pieces("x" * 50_000)) <= 800
    with pytest.raises(ValueError):
        pieces("x", 10, 10)


def test_frames(spark):
    df = spark.createDataFrame([(1, "Al be. Co de.", "s"), (2, None, "t"), (3, "", "u"), (1, "Al be. Co de.", "v")], "id long, text string, piece string")
    rows = sorted((r.id, r.position, r.sentence) for r in sentence_units(df, ["id"], "text").collect())
    assert rows == [(1, 0, "Al be."), (1, 0, "Al be."), (1, 1, "Co de."), (1, 1, "Co de.")]
    text = "Al be. Co de."
    want = [(i, k, text[a:c]) for i in (1, 1) for k, (a, _, c) in enumerate(pieces(text, 7, 1))] + [(3, 0, "")]
    assert sorted((r.id, r.piece_no, r.piece) for r in split_oversized(df, ["id"], "text", 7, 1).collect()) == sorted(want)
    assert split_oversized(df.limit(0), ["id"], "text").collect() == []



@pytest.mark.parametrize("text", ["( a " * 250_000, "(. " * 100_000 + "x" + ")" * 100_000, "a.(" * 100_000 + "b." + ")" * 100_000, " " * 500_000 + "a", "“a. " * 200_000, "—(" * 200_000])
def test_units_take_linear_time(text):
    begun = time.process_time()
    assert unit_starts(text)
    assert time.process_time() - begun < 10


def test_signs_close_the_innermost_frame_of_their_kind():
    assert unit_starts("(A [b “cat.” d] end.) Then fog came. Gulls.") == [0, 22, 37]
