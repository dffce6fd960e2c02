"""Sentence boundaries across languages and scripts by a pushdown automaton.

The automaton reads the marks of a text from left to right. Its stack holds the open quotations and brackets; a mark
inside one is kept back on the stack frame, dropped when the frame closes and given free when its paragraph ends without
the closing sign (pieces of larger texts often begin or end inside a quotation). Whether a mark ends a unit is decided
by its script, by tries of abbreviations and by the character that follows. Blank lines empty the stack; list items
start a unit with their marker; in Thai a blank ends a unit.

Defined results: null, empty and blank texts have no unit; a text without any final mark is one unit; texts of any
length are read whole; offsets count code points from 0; each input row gives its own result, repeated rows included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that an ordinary word, a name or a number follows: they never end a unit.
OPEN_ABBREVIATIONS = """
dr mr mrs ms prof gen col lt capt maj sgt rev hon gov sen rep pres st ste mt ft fig figs vol vols no nos pp ed eds est
cf vs approx ca resp viz ch sec art dept univ jan feb mar apr jun jul aug sep sept oct nov dec
hr fr nr abb bzw bspw vgl sog geb gest evtl ggf inkl zzgl tel bd str kap hl
mme mlle mm av apr éd env chap ex tél bd fasc
sr sra srta dña ud uds ee pág págs cap núm avda ej lic ing
г-н г-жа проф ул напр гр тов им акад стр гл рис см обл р-н просп пер корп
डॉ श्री पं प्रो د أ م ص
""".split()
# After the part to the left, the part to the right does end a unit although it is one letter.
CLOSED_PAIRS = {("s", "a"), ("u", "a"), ("т", "д"), ("т", "п"), ("a", "m"), ("p", "m"), ("a", "c"), ("d", "c")}
GERMAN_MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "jahrhundert", "jh"}

QUOTES = {"“": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "„": "“”", "‚": "‘’", "‹": "›", "《": "》", '"': '"'}
BRACKETS = {"(": ")", "[": "]", "（": "）", "【": "】", "{": "}"}
OPENERS = QUOTES | BRACKETS
CLOSERS = frozenset("”’»」』›》)]）】}")
FULL_MARKS = frozenset("。！？｡।॥؟۔")
DASHES = "—–-―"
THAI = r"฀-๿"
EVENTS = re.compile(
    r"(?P<blank>(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*)"
    r"|(?P<item>(?:\r\n|\r|\n)[^\S\r\n]*(?=(?:[-*•‣◦▪–]|\d{1,3}[.)]|\(?[A-Za-z]\))[^\S\r\n]+\S))"
    r"|(?P<mark>[.!?…。！？｡．؟।॥۔]+)"
    r"|(?P<sign>[“”‘’«»「」『』„‚‹›《》\"()\[\]（）【】{}])"
    rf"|(?P<thai>(?<=[{THAI}])[^\S\r\n]+|(?<![^\S\r\n])[^\S\r\n]++(?=[{THAI}]))"
)
WORD_BEFORE = re.compile(r"[^\s(\[“\"«„‘—]*\Z")
NEXT_WORD = re.compile(r"\w+")


class Trie:
    """Abbreviations read backwards from their mark."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = True

    def __contains__(self, word: str) -> bool:
        node = self.root
        for c in reversed(word):
            if (node := node.get(c)) is None:
                return False
        return "" in node


ABBREVIATIONS = Trie(OPEN_ABBREVIATIONS)


class Frame:
    __slots__ = ("closers", "is_quote", "at_start", "introduced", "pending", "marked")

    def __init__(self, closers: str, is_quote: bool, at_start: bool, introduced: bool):
        self.closers, self.is_quote, self.at_start, self.introduced = closers, is_quote, at_start, introduced
        self.pending: list[int] = []
        self.marked = -1  # end of the last mark inside


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯"


class Ahead:
    """What follows a place of a text. A run of closing signs or of white space is read once, however many places in it ask."""

    def __init__(self, text: str):
        self.text = text
        self.closed, self.blank = (-1, -1), (-1, -1)

    def tail(self, end: int) -> int:
        """Beyond the closing signs at `end`; signs that also open count where a blank, a comma or nothing follows them."""
        if self.closed[0] <= end <= self.closed[1]:
            return self.closed[1]
        text, begin = self.text, end
        while end < len(text) and (text[end] in CLOSERS or text[end] in "\"“‘" and (end + 1 == len(text) or text[end + 1].isspace() or text[end + 1] in ",;.")):
            end += 1
        self.closed = (begin, end)
        return end

    def follow(self, at: int) -> tuple[int, str]:
        """Position and character of what follows at, beyond white space; '' at the end."""
        text, begin, n = self.text, at, len(self.text)
        if self.blank[0] <= at <= self.blank[1]:
            at = self.blank[1]
        else:
            while at < n and text[at].isspace():
                at += 1
            self.blank = (begin, at)
        return at, text[at] if at < n else ""


def _goes_on(text: str, at: int) -> bool:
    """Whether the text at `at` continues a sentence: a small letter, perhaps behind a dash or an opening sign."""
    c = text[at]
    while c in DASHES or c in "“‘«„(['\"" or c.isspace():
        at += 1
        if at >= len(text):
            return False
        c = text[at]
    return c.islower() or c in ",;:，、；："


def _ends(ahead: Ahead, start: int, end: int, unit: int) -> bool:
    """Whether the mark text[start:end] ends the unit that began at `unit`."""
    text, tail = ahead.text, ahead.tail(end)
    at, c = ahead.follow(tail)
    if not c:
        return False
    mark = text[start:end]
    if mark[-1] in FULL_MARKS or mark == "．":
        return True
    gap = at > tail
    if "!" in mark or "?" in mark:
        return not _goes_on(text, at) if gap else c.isupper() and text[start - 1 : start].isalpha()
    if len(mark) > 1 or mark == "…":
        return gap and not _goes_on(text, at)
    word = WORD_BEFORE.search(text, max(0, start - 24), start).group()
    if not gap:
        return c.isupper() and len(word) > 1 and word.isalpha() and word[-1].islower() and word.lower() not in ABBREVIATIONS
    if not word or _goes_on(text, at):
        return not _goes_on(text, at)
    low = word.lower()
    if start == len(word) and word.islower():
        return True  # the rest of a word that the text begins with
    if low in ABBREVIATIONS or low[0] in "'’" and low[1:] in ABBREVIATIONS:
        return False
    if "'" in low or "’" in low:
        if re.split("['’]", low)[-1] in ABBREVIATIONS:
            return False
    if len(word) == 1 and word.isalpha():
        before = WORD_BEFORE.search(text, max(0, start - 12), max(0, start - 2)).group() if text[start - 2 : start - 1].isspace() else ""
        if (before.rstrip(".").lower(), low) in CLOSED_PAIRS and before.endswith("."):
            return True
        return low == "г" and bool(re.search(r"\d\s*\Z", text[max(0, start - 5) : start - 1]))
    if word.isdigit() and len(word) <= 3:
        if start - len(word) <= unit:
            return start == len(word) and c.isupper()  # the rest of a number that the text begins with, else a list marker
        follow = NEXT_WORD.match(text, at)
        return not (len(word) <= 2 and follow and (follow.group().lower() in GERMAN_MONTHS or follow.group().isdigit()))
    return True


def _closes(ahead: Ahead, frame: Frame, end: int) -> bool:
    """Whether the closing sign before `end`, right after a final mark, ends the unit as well."""
    text, end = ahead.text, ahead.tail(end)
    at, c = ahead.follow(end)
    if not c:
        return False
    if _goes_on(text, at):
        return False
    if not frame.is_quote:
        return frame.at_start
    if "぀" <= c <= "ゟ":
        return False
    if at == end:
        return (frame.introduced or not frame.at_start) if _cjk(c) or c.isdigit() else not c.isalnum()
    return c.isupper() or c.isdigit() or not c.isalpha() or frame.introduced or not frame.at_start


class Stack:
    """Open frames; for each closing sign the depths of the frames that it closes, so that no sign walks the stack."""

    def __init__(self):
        self.frames: list[Frame] = []
        self.depths: dict[str, list[int]] = {}

    def push(self, frame: Frame) -> None:
        for sign in frame.closers:
            self.depths.setdefault(sign, []).append(len(self.frames))
        self.frames.append(frame)

    def depth(self, sign: str) -> int:
        """Depth of the innermost frame that the sign closes, -1 where there is none."""
        at = self.depths.get(sign)
        return at[-1] if at else -1

    def pop(self, depth: int) -> tuple[Frame, int]:
        """Takes off the frame and all above it; with it the end of the last mark inside any of them."""
        marked = -1
        while len(self.frames) > depth:
            frame = self.frames.pop()
            marked = max(marked, frame.marked)
            for sign in frame.closers:
                self.depths[sign].pop()
        return frame, marked

    def clear(self) -> None:
        self.frames.clear()
        self.depths.clear()


QUIET = frozenset("”’»」』)]） \u00a0\u202f")
SOLID = re.compile(rf"[^ \t\r\n{re.escape(DASHES)}]")


class Quiet:
    """Whether text[a:b] holds closing signs and blanks only, for ever larger b; what was seen before is not read again."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, 0, 0

    def __call__(self, a: int, b: int) -> bool:
        k = b
        while k > a:
            if k == self.end and self.begin < k:
                k = self.begin
            elif self.text[k - 1] in QUIET:
                k -= 1
            else:
                break
        self.begin, self.end = k, b
        return k <= a


def unit_starts(text: str) -> list[int]:
    """Start of every unit of the text, the first included; in time linear in its length."""
    ahead = Ahead(text)
    first, c = ahead.follow(0)
    if not c:
        return []
    starts, stack, unit, solid, quiet = [first], Stack(), first, -1, Quiet(text)
    frames = stack.frames

    def cut(end: int) -> None:
        nonlocal unit, solid
        at, c = ahead.follow(ahead.tail(end))
        if c and at > starts[-1]:
            starts.append(at)
            unit, solid = at, -1

    def release() -> None:
        for frame in frames:
            for end in frame.pending:
                cut(end)
        stack.clear()

    for m in EVENTS.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "mark":
            if frames:
                frames[-1].marked = end
                if _ends(ahead, start, end, unit):
                    frames[-1].pending.append(end)
            elif _ends(ahead, start, end, unit):
                cut(end)
        elif kind == "sign":
            sign = text[start]
            depth = stack.depth(sign)
            if depth >= 0 and (sign not in "’‘" or not text[end : end + 1].isalpha()):
                frame, marked = stack.pop(depth)
                if marked >= 0 and quiet(marked, start):
                    if frames:
                        frames[-1].marked = end
                    if _closes(ahead, frame, end):
                        if frames:
                            frames[-1].pending.append(end)
                        else:
                            cut(end)
            elif sign in OPENERS and not (sign in "‘‚" and text[start - 1 : start].isalpha() and start):
                before = text[max(0, start - 2) : start].rstrip()
                if solid < 0:  # the first place of the unit with more than blanks and dashes
                    found = SOLID.search(text, unit)
                    solid = found.start() if found else len(text)
                stack.push(Frame(OPENERS[sign], sign in QUOTES, start <= unit or solid >= start, before[-1:] in ("：", ":", "，", ",")))
        elif kind == "thai":
            if not frames:
                cut(end)
            else:
                frames[-1].pending.append(end)
        elif kind == "blank":
            release()
            cut(end)
        else:
            release()
            cut(end)
    release()
    return starts


def unit_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit; the white space between units belongs to none."""
    if not text:
        return []
    starts = unit_starts(text)
    ends = [*starts[1:], len(text)]
    return [(a, a + len(text[a:b].rstrip())) for a, b in zip(starts, ends)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, end, counts = [], [], [0]
        for text in batch.column(batch.num_columns - 1).to_pylist():
            for a, b in unit_spans(text):
                begin.append(a)
                end.append(b)
            counts.append(len(begin))
        offsets = pa.array(counts, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (begin, end)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], [*batch.schema.names[:-1], "starts", "ends"])


def sentence_offsets(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, starts, ends): the offsets of the units of each row; a narrow map with no shuffle."""
    src = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*[f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)], "starts array<int>", "ends array<int>"])
    out = src.mapInArrow(_batches, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "starts", "ends")


def sentence_units(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, position, start_char, end_char, sentence): one row for each unit."""
    src = df.select(*keys, F.col(text_col).cast("string").alias("__text"))
    # the text travels with its key, so that the units are cut without a join
    parts = sentence_offsets(src, [*keys, "__text"], "__text")
    units = parts.select(*keys, "__text", F.posexplode(F.arrays_zip("starts", "ends")).alias("position", "u"))
    piece = F.substring(F.col("__text"), F.col("u.starts") + 1, F.col("u.ends") - F.col("u.starts"))
    return units.select(*keys, "position", F.col("u.starts").alias("start_char"), F.col("u.ends").alias("end_char"), piece.alias("sentence"))
