"""Flat numpy views of batches of texts: code points, character classes and segment arithmetic."""

from __future__ import annotations

import functools

import numpy as np

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter (L*), number (N*) or other, as the public BPE pattern sees them."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *[0x110000 - 1] * 0x800, *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the offsets of the texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return code_points("".join(texts)), offsets


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each segment, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def slices(lengths: np.ndarray, most: int):
    """(from, to) of consecutive rows of at most `most` units together; a longer row stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if begin < len(lengths):
        yield begin, len(lengths)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))
