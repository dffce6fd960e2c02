"""Splitting oversized texts at natural boundaries by recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint (paragraph, sentence, line, word; a place
between two characters only where the text offers none), and so is each half that still exceeds the limit less the
overlap; then every piece but the first is given the last `overlap` characters of the piece before.

Defined results: null texts give no piece; texts within the limit, the empty text included, give themselves as one
piece; the parts behind the overlaps (from core_start) put together are the text again; no cut parts a base character
from its combining marks or a joined emoji; repeated rows give their pieces again; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .sentences import unit_spans

LIMIT, OVERLAP = 800, 100
PARAGRAPH, SENTENCE, LINE, WORD = 4, 3, 2, 1


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where the text may be cut, ascending, and their strengths."""
    cp = flat.code_points(text)
    blank = flat.char_classes()[cp] == flat.SPACE
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    lines = np.append(0, np.cumsum((cp == 10) | (cp == 13) & (np.append(cp[1:], 0) != 10)))
    solid = np.append(np.flatnonzero(~blank), len(cp))
    follow = solid[np.searchsorted(solid, ends)]
    breaks = lines[follow] - lines[ends]
    strength = np.where(breaks > 1, PARAGRAPH, np.where(breaks == 1, LINE, WORD))
    units = np.array([b for _, b in unit_spans(text)], np.int64)
    units = units[units < len(cp)]
    at = np.concatenate([ends, units])
    strength = np.concatenate([strength, np.full(len(units), SENTENCE)])
    order = np.lexsort((strength, at))
    at, strength = at[order], strength[order]
    last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, bool)
    return at[last], strength[last]


def joined_to_previous(text: str, at: int) -> bool:
    """Whether a cut before text[at] would part what is read as one character."""
    if not 0 < at < len(text):
        return False
    c = text[at]
    return bool(unicodedata.combining(c)) or unicodedata.category(c) in ("Mn", "Mc", "Me") or c in "‍️" or text[at - 1] == "‍" or "\U0001f3fb" <= c <= "\U0001f3ff"


def _cut(text: str, at: np.ndarray, strength: np.ndarray, begin: int, end: int) -> int:
    """The strongest boundary near the midpoint; in the middle half if there is one, else anywhere inside."""
    middle, quarter = (begin + end) // 2, (end - begin) // 4
    for low, high in ((middle - quarter, middle + quarter), (begin + 1, end - 1)):
        a, b = np.searchsorted(at, [low, high + 1])
        if b > a:
            best = strength[a:b].max()
            near = at[a:b][strength[a:b] == best]
            return int(near[np.argmin(np.abs(near - middle))])
    for step in range(quarter):
        for place in (middle - step, middle + step):
            if not joined_to_previous(text, place):
                return place
    return middle


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core_start, end) of every piece; the overlap is text[start:core_start]."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    at, strength = boundaries(text)
    cores, todo = [], [(0, len(text))]
    while todo:
        begin, end = todo.pop()
        if end - begin <= limit - overlap:
            cores.append((begin, end))
        else:
            place = _cut(text, at, strength, begin, end)
            todo += [(place, end), (begin, place)]
    out, before = [], 0
    for begin, end in cores:
        start = max(before, begin - overlap)
        while start < begin and joined_to_previous(text, start):
            start += 1
        out.append((start, begin, end))
        before = start
    return out


def _batches(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.columns[:-1], batch.column(batch.num_columns - 1).to_pylist()
        row, number, start, core, end, out = [], [], [], [], [], []
        for i, text in enumerate(texts):
            if text is not None:
                for k, (a, b, c) in enumerate(pieces(text, limit, overlap)):
                    row.append(i)
                    number.append(k)
                    start.append(a)
                    core.append(b)
                    end.append(c)
                    out.append(text[a:c])
        rows = pa.array(row, pa.int64())
        ints = [pa.array(x, pa.int32()) for x in (number, start, core, end)]
        names = [*batch.schema.names[:-1], "piece_no", "start_char", "core_start", "end_char", "piece"]
        yield pa.RecordBatch.from_arrays([*[k.take(rows) for k in keys], *ints, pa.array(out, pa.string())], names)


def split_oversized(df: DataFrame, keys: list[str], text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = False) -> DataFrame:
    """(keys, piece_no, start_char, core_start, end_char, piece); a narrow map with no shuffle."""
    text = F.col(text_col).cast("string")
    src = df.filter(F.length(text) > limit) if only_oversized else df
    src = src.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], text.alias("text"))
    kinds = [f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    schema = ", ".join([*kinds, "piece_no int, start_char int, core_start int, end_char int, piece string"])
    out = src.mapInArrow(lambda it: _batches(it, limit, overlap), schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "piece_no", "start_char", "core_start", "end_char", "piece")
