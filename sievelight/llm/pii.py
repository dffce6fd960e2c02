"""Personal information inside free text: a character-level BiLSTM-CRF tagger, exact checks and typed placeholders.

Fitting: of at most `FIT_DOCS` documents (those with the smallest hashes of their ids, so that neither the order of rows nor
their files matter) spans are labelled by their context (pii_labels), and `INVENTED` invented texts with known spans are
added (pii_grammar); windows with labels and as many without teach the tagger and a screen of character 5-grams, which tells
what resembles a span. The fitted model is stored in the shared folder under a key of all that it was fitted on, so
that it is fitted once. Tagging: every text is cut into overlapping windows from its first to its last character; all are
read by the tagger, decoded by Viterbi where a path may score more than that of no span, and put together again, each
character taking the tag of the window in which it lies farthest from an edge. What lies
far from all that the screen passes needs a higher gain, chosen on labelled texts. Exact checks follow: a span is trimmed to
the value itself and dropped where it cannot be one (a phone number of five digits, a date, a number of houses, a bridge
named after somebody).

Name lists of up to `SENT_NAMES` names go to every worker; of longer ones each text gets the names that occur in it, by a
join on the words of the texts. Both give the same rows.

Defined results: null and empty texts give no span; texts of any length are read whole; spans do not overlap; repeated
rows give their spans again; where no document can be labelled the invented texts alone are fitted; other columns are
ignored. Names are found in scripts with capital letters only.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from . import flat
from .pii_grammar import invented
from .pii_labels import _STOP as STOP
from .pii_labels import _UP, DATE, EMAIL, ID, KINDS, PAGES, PHONE, STREET, Names, weak_spans
from .tagger import DECODED, SHARED, STEPS, WINDOW, Screen, Tagger, folded

#: Documents that may be labelled for fitting; windows that may be fitted; characters around a screened one that count as near it.
FIT_DOCS, FIT_WINDOWS, CONTEXT = 6000, 5000, 28
#: Invented texts that are added; names that are sent to every worker (about 10 MB).
INVENTED, SENT_NAMES = 300, 200_000
#: Labelled texts by which the least gains are chosen.
JUDGED = 2000
#: Longer documents are not taken into the fitting sample.
FIT_CHARS = 20_000
BATCH_CHARS = 2_000_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

_TITLE = re.compile(r"(?:Dr|Mrs?|Ms|Prof|Frau|Herr|Mme|Mlle|M|Sra?|Г-н|Г-жа|DR|MRS?|MS|FRAU|HERR|MME|SRA?)(?:\.\s*|\s+)(?=\S{2})")
_INITIALS = re.compile(rf"(?<![\w’'-])({_UP}[^\W\d_]{{2,}} )?((?:{_UP}\. )+)\Z")
_PARTICLES = {"van", "von", "der", "den", "de", "la", "le", "les", "du", "des", "del", "di", "da", "dos", "el", "al", "bin", "ibn", "af", "av", "zu", "zur", "ter", "y", "e", "i"}
_CAPITALS = re.compile(r"(?<!\w)(?!(?:MR|MRS|MS|DR|PROF|FRAU|HERR|MME|SRA?)\b)[^\W\d_]{2,} \Z")
_AHEAD = re.compile(r"(?:[^\W\d_]{3,}\.\s+|([^\W\d_]+)\s+)(?=\S)")
_THING = re.compile(r"\s(?:Bridge|Institute|Street|Road|Foundation|Museum|Avenue|Prize|Hall|College|Inc|Ltd|GmbH|Corp|BRIDGE|INSTITUTE|STREET)\b")
_ADDRESS_START = re.compile(r"(?:(?:Am|An der|Calle|Plaza|Paseo|Avenida|C/|Avda\.|ул\.|пр\.|просп\.|пер\.|AM|CALLE|PLAZA|AVDA\.|C/)\s?)\Z")


class Model:
    """least has of each kind the mean gain over no span, tag by tag, from which a span is taken; far that of spans nowhere near what the screen passes."""

    def __init__(self, tagger: Tagger, screen: Screen, names: Names):
        self.tagger, self.screen, self.names = tagger, screen, names
        self.least, self.far = dict.fromkeys(KINDS, -np.inf), dict.fromkeys(KINDS, -np.inf)


_DIGITS, _WORD = re.compile(r"\d+"), re.compile(r"[A-Z][^\W\d_]{3,}")


def flags(text: str, known: set[str] | frozenset[str]) -> np.ndarray:
    """Of every character twice the length of its run of digits (at most 11), and 1 more in a known name."""
    out = bytearray(len(text))
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        out[a:b] = _RUNS[min(11, b - a)] * (b - a)
    if not known.isdisjoint(map(str.lower, _WORD.findall(text))):
        for m in _WORD.finditer(text):
            if m.group().lower() in known:
                a, b = m.span()
                out[a:b] = b"\1" * (b - a)
    return np.frombuffer(out, np.uint8)


_RUNS = [bytes([2 * k]) for k in range(12)]


FLAGS = 24
HIDE = np.arange(FLAGS, dtype=np.uint8) // 2 * 2


def _windows(length: int, size: int = WINDOW) -> list[int]:
    """Starts of windows that cover `length` characters, neighbours sharing SHARED."""
    if length <= size:
        return [0]
    starts = list(range(0, length - size, size - SHARED))
    return [*starts, length - size]


def fit(rows: list[tuple[str]], names: Names, steps: int = STEPS, seed: int = 11, more: int = INVENTED) -> Model | None:
    """A model from texts, labelled by their context, and invented ones."""
    rng = np.random.default_rng(seed)
    table = folded()
    texts, golds, syms = [], [], []
    for text, spans_ in [*((text, weak_spans(text, names)) for (text,) in rows), *invented(more)]:
        gold = np.zeros(len(text), np.int8)
        for a, b, kind in spans_:
            tag = 1 + 2 * KINDS.index(kind)
            gold[a], gold[a + 1 : b] = tag, tag + 1
        texts.append(text)
        golds.append(gold)
        syms.append(table[flat.code_points(text)])
    if not any((g > 0).any() for g in golds):
        return None
    screen = Screen(syms, golds)
    with_span, without = [], []
    for i, gold in enumerate(golds):
        marks = np.flatnonzero(gold % 2 == 1)
        for a in _windows(len(gold)):
            (with_span if ((marks >= a) & (marks < a + WINDOW)).any() else without).append((i, a))
        for m in marks[rng.random(len(marks)) < 0.5]:  # the same spans at other places of a window
            with_span.append((i, int(max(0, min(m - rng.integers(4, WINDOW - 12), len(gold) - WINDOW)))))
    hard = []
    for i, some in itertools.groupby(without, lambda w: w[0]):
        passed = screen.passes(syms[i])
        hard += [w for w in some if passed[w[1] : w[1] + WINDOW].any()]
    pick = lambda of, n: [of[k] for k in rng.permutation(len(of))[:n]]
    chosen = pick(with_span, FIT_WINDOWS * 3 // 4)
    chosen += pick(hard, len(chosen) // 5) + pick(without, len(chosen) // 8)
    n = len(chosen)
    sym, flag, gold, valid = (np.zeros((n, WINDOW), t) for t in (np.uint8, np.uint8, np.int64, np.float32))
    for k, (i, a) in enumerate(chosen):
        b = min(len(texts[i]), a + WINDOW)
        own = golds[i][a:b].copy()
        cut = np.flatnonzero(np.append(own % 2 == 1, True) | np.append(own == 0, True))[0]
        own[:cut] = np.where(own[:cut] > 0, own[:cut], 0)
        if len(own) and own[0] and own[0] % 2 == 0:
            own[0] -= 1  # a span that begins before the window
        sym[k, : b - a], gold[k, : b - a], valid[k, : b - a] = syms[i][a:b], own, 1.0
        flag[k, : b - a] = flags(texts[i][a:b], names.all)
    tagger = Tagger(len(KINDS), FLAGS)
    tagger.loss = tagger.fit(sym, flag, gold, valid, HIDE, steps)
    model = Model(tagger, screen, names)
    judged = [*range(min(len(rows), JUDGED)), *range(len(rows), len(texts))]
    model.least, model.far = _least(model, [texts[i] for i in judged], [golds[i] for i in judged])
    return model


def _least(model: Model, texts: list[str], golds: list[np.ndarray]) -> tuple[dict[str, float], dict[str, float]]:
    """Of each kind the gains from which spans are taken, near and far: those with the best balance of right, wrong and lost spans on labelled texts."""
    seen: list[tuple[int, int, str, float, bool]] = []
    for a in range(0, len(texts), 500):
        some: list[tuple[int, int, str, float, bool]] = []
        tag(texts[a : a + 500], model, None, some)
        seen += [(t + a, *rest) for t, *rest in some]
    out, far = dict(model.least), dict(model.far)
    for number, kind in enumerate(KINDS):
        inside = (1 + 2 * number, 2 + 2 * number)
        total = sum(int((golds[t] == inside[0]).sum()) for t in range(len(texts)))
        judged = lambda near: sorted(((gain, bool(np.isin(golds[t][start : start + 4], inside).any())) for t, start, k, gain, n in seen if k == kind and n == near), reverse=True)
        own, others = judged(True), judged(False)
        taken = good = 0
        if own and total:
            right = np.cumsum([good for _, good in own])
            balance = 2 * right / (np.arange(1, len(own) + 1) + total)
            last = int(np.flatnonzero(balance >= balance.max() - 0.002)[-1])
            out[kind], taken, good = own[last][0], last + 1, int(right[last])  # the lowest that costs nothing to speak of
        far[kind] = out[kind]
        if others:
            right = good + np.cumsum([good for _, good in others])
            balance = 2 * right / (taken + np.arange(1, len(others) + 1) + max(total, 1))
            best = int(balance.argmax())
            # where taking any of them does harm, only what exceeds all of them
            far[kind] = max(out[kind], others[best][0] if balance[best] > 2 * good / max(1, taken + total) else others[0][0] + 1e-6)
    return out, far


def tag(texts: list[str], model: Model, known: set[str] | None = None, seen: list | None = None) -> list[list[tuple[int, int, str]]]:
    """The spans of each text; known are the folded names that may occur in the texts (without it those of the model).

    seen takes (text, start, kind, gain, near) of every span of the path, before it is checked.
    """
    known = model.names.all if known is None else known
    cp, offsets = flat.joined(texts)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(cp):
        return out
    sym = folded()[cp]
    flag = np.concatenate([flags(t, known) for t in texts])
    windows = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if a < b:
            starts = [a + w for w in _windows(b - a, DECODED)]
            # a character that two windows share is of that in which it lies farther from the edge
            edges = [a, *[(s + e + DECODED) // 2 for e, s in zip(starts, starts[1:])], b]
            windows += [(s, min(b, s + DECODED), edges[k], edges[k + 1]) for k, s in enumerate(starts)]
    windows = np.array(windows, np.int64)
    windows = windows[np.argsort(windows[:, 1] - windows[:, 0], kind="stable")]  # windows of like length share a batch; shorter ones are filled up with the symbol 0
    tags, gains = np.zeros(len(cp), np.int8), np.zeros(len(cp), np.float32)
    tables = model.tagger.tables()
    held: list[tuple[np.ndarray, np.ndarray]] = []  # windows that may have a span and their scores, until they are many enough

    def put() -> None:
        path, gain = (x.T for x in model.tagger._viterbi(np.concatenate([e for _, e in held], axis=1)))
        where = np.concatenate([on for on, _ in held])
        for r in np.flatnonzero(path.any(1)):
            start, _, low, high = windows[where[r]]
            own, part = slice(low, high), slice(low - start, high - start)
            tags[own], gains[own] = path[r, part], gain[r, part]
        held.clear()

    for some in range(0, len(windows), 512):
        start, end, _, _ = windows[some : some + 512].T
        at = start[:, None] + np.arange((end - start).max())
        inside = at < end[:, None]
        at = np.minimum(at, len(cp) - 1)
        e = model.tagger.scores(np.where(inside, sym[at], 0).T, np.where(inside, flag[at], 0).T, tables)
        on = np.flatnonzero(model.tagger.suspects(e))
        if held and (len(held[0][1]) != len(e) or sum(len(x) for x, _ in held) + len(on) > 512):
            put()
        if len(on):
            held.append((some + on, e[:, on]))
    if held:
        put()
    for t in np.unique(np.searchsorted(offsets, np.flatnonzero(tags), side="right") - 1).tolist():
        own = slice(int(offsets[t]), int(offsets[t + 1]))
        path, gain, passed = tags[own], gains[own], model.screen.passes(sym[own])
        for start, end, kind in _spans(path):
            sure = float(gain[start:end].mean())
            near = bool(passed[max(0, start - CONTEXT) : end + CONTEXT].any())
            if seen is not None:
                seen.append((t, start, kind, sure, near))
            if sure >= (model.least if near else model.far)[kind] and (fixed := check(texts[t], start, end, kind)) and (not out[t] or fixed[0] >= out[t][-1][1]):
                if out[t] and _one_person(texts[t], out[t][-1], fixed):
                    fixed = (out[t].pop()[0], *fixed[1:])
                out[t].append(fixed)
    return out


_FAMILY_FIRST = re.compile(r"[^\W\d_][^\s,]*, [^\W\d_][^\s,]*")


def _one_person(text: str, before: tuple[int, int, str], now: tuple[int, int, str]) -> bool:
    """Whether two names are the family and the given name of one person: a word each, a comma and a blank between them, and no list goes on."""
    if before[2] != "name" or now[2] != "name" or text[before[1] : now[0]] != ", " or not _FAMILY_FIRST.fullmatch(text, before[0], now[1]):
        return False
    return not re.match(r",| (?:and|und|et|y|e|и|or|oder|ou)\b", text[now[1] : now[1] + 6]) and not text[: before[0]].endswith(", ")


def _spans(path: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Begin-inside runs of one kind; neighbours of a kind that only a mark or blank parts stay apart."""
    edges = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    current = None
    for p in [*edges.tolist(), len(path)]:
        tag_ = int(path[p]) if p < len(path) else 0
        if current and (tag_ == 0 or tag_ % 2 == 1 or KINDS[(tag_ - 1) // 2] != current[1]):
            yield current[0], p, current[1]
            current = None
        if tag_ and current is None:
            current = (p, KINDS[(tag_ - 1) // 2])
        elif tag_ % 2 == 1:
            current = (p, KINDS[(tag_ - 1) // 2])


def check(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """The span trimmed to the value itself, or None where it cannot be one."""
    while start < end and (text[start].isspace() or text[start] in ".,;:<>\"“”„«»*_|"):
        start += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] in ",;:<>\"“”„«»*_|"):
        end -= 1
    if start >= end:
        return None
    value = text[start:end]
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        for m in EMAIL.finditer(text, max(0, start - 40), end + 60):
            if m.start() < end and m.end() > start:
                return m.start(), m.end(), kind
        return None
    if kind in ("phone", "id_number"):
        while start > 0 and (text[start - 1].isdigit() or text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+(" or text[start - 1] == "-" and text[start - 2 : start - 1].isalnum()):
            start -= 1
        while end < len(text) and (text[end].isdigit() or text[end] == "-" and text[end + 1 : end + 2].isdigit()):
            end += 1
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        # a value whose form is that of one kind only is of that kind, and whole
        forms = {k: next((m for m in rx.finditer(text, max(0, start - 10), end + 25) if m.start() < end and m.end() > start), None) for k, rx in (("id_number", ID), ("phone", PHONE))}
        fits = [(k, m) for k, m in forms.items() if m]
        if len(fits) == 1:
            kind, start, end = fits[0][0], fits[0][1].start(), fits[0][1].end()
        digits = sum(c.isdigit() for c in text[start:end])
        if not 6 <= digits <= 34 or kind == "phone" and digits > 20 or DATE.fullmatch(text, start, end) or PAGES.search(text, max(0, start - 40), start):
            return None
        return start, end, kind
    if kind == "address":
        while start > 0 and text[start - 1].isalnum() and text[start].isalnum():
            start -= 1
        if m := _ADDRESS_START.search(text, max(0, start - 10), start):
            start = m.start()
        return (start, end, kind) if digits and STREET.search(text[start:end]) else None
    while start > 0 and text[start - 1].isalpha() and text[start].isalpha() and (text[start - 1].isascii() or not text[start].isascii()):
        start -= 1
    while end < len(text) and text[end].isalpha() and text[end - 1].isalpha():
        end += 1
    while m := _TITLE.match(text, start, end):
        start = m.end()
    m = _INITIALS.search(text, max(0, start - 30), start)  # initials before a family name, and a given name before them
    if m and not (m.group(2) == "M. " and not m.group(1) and text[m.start() - 1 : m.start()] in ("(", "")):
        start = m.start(2) if m.group(1) and m.group(1).strip() in STOP else m.start()
    while m := _AHEAD.match(text, start, end):  # the end of the sentence before, an article
        if m.group(1) and m.group(1) not in STOP:
            break
        start = m.end()
    value = text[start:end].rstrip(".,; ")
    if len(value) < 3 or not value[0].isupper() or digits or _THING.match(text, start + len(value)) or _THING.search(value):
        return None
    words = re.split(r"[\s,]+", value)
    if any(w[0].islower() and w.lower() not in _PARTICLES for w in words) or words[-1][0].islower():
        return None  # a name is of capitalised words and particles
    if len(words) == 1 and value.isupper() and (m := _CAPITALS.search(text, max(0, start - 30), start)) and m.group().isupper():
        return None  # a word of a sentence in capitals
    return start, start + len(value), kind


def _tagged(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[list[str | None], list[list[tuple[int, int, str]]]]]:
    """Texts of a batch (id, text) or (id, text, known) and their spans, some at a time."""
    texts = batch.column(1).to_pylist()
    names = batch.column(2) if batch.num_columns > 2 else None
    for a, b in flat.slices(np.array([len(t or "") for t in texts], np.int64), BATCH_CHARS):
        known = None if names is None else {w for row in names.slice(a, b - a).to_pylist() for w in row or []}
        yield texts[a:b], tag([t or "" for t in texts[a:b]], model, known)


def _span_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans_ = [s for _, found in _tagged(batch, sent.value) for s in found]
        offsets = pa.array(np.append(0, np.cumsum([len(s) for s in spans_])), pa.int32())
        flat_spans = [x for s in spans_ for x in s]
        parts = [pa.array([x[k] for x in flat_spans], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(offsets, p) for p in parts]], ["id", "starts", "ends", "kinds"])


def _sample(docs: DataFrame, fit_docs: int) -> list[tuple[str]]:
    """The texts of the `fit_docs` documents with the smallest hashes of their ids among those that can be fitted."""
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    usable = docs.select("id", "text", order.alias("h")).filter(F.col("text").isNotNull() & (F.length("text") > 0) & (F.length("text") <= FIT_CHARS))
    # only the fitting sample leaves longer texts out; all texts are tagged whole
    total = docs.count()
    for share in (min(1.0, 2.0 * fit_docs / max(1, total)), 1.0):
        rows = usable.filter(F.col("h") < int(share * (1 << 30)) + 1).orderBy("h", "id", F.xxhash64("text")).limit(fit_docs).collect()
        if len(rows) == fit_docs or share == 1.0:
            break
    return [(r.text,) for r in rows]


def fitted(docs: DataFrame, names: DataFrame, fit_docs: int = FIT_DOCS, steps: int = STEPS, sent_names: int = SENT_NAMES) -> tuple[Model, DataFrame | None]:
    """The model fitted on a bounded sample of docs (id, text), and the folded names where there are too many to be sent.

    names has name and role. The names that occur in the sample help to label it, however long the list is. The model is
    stored under a key of the sample, those names and the parameters; asked for again, it is read.
    """
    rows = _sample(docs, fit_docs)
    folded_names = names.select(F.lower("name").alias("name")).filter(F.col("name").isNotNull() & (F.col("name") != "")).distinct()
    large = folded_names.limit(sent_names + 1).count() > sent_names
    if large:
        words = sorted({w.lower() for (text,) in rows for w in re.findall(r"[^\W\d_]+", text.replace("\u200b", ""))})
        listed = folded_names.join(docs.sparkSession.createDataFrame([(w,) for w in words], "name string"), "name", "left_semi")
    else:
        listed = folded_names
    known = {r.name for r in listed.collect()}  # at most sent_names, or the words of the sample
    digest = hashlib.sha256(pickle.dumps((rows, sorted(known), fit_docs, steps, INVENTED, _code()))).hexdigest()[:32]
    model = stored(docs.sparkSession, f"pii-{digest}", lambda: fit(rows, Names(known, set()), steps))
    return model, folded_names if large else None


@functools.cache
def _code() -> str:
    """A key of the code that fits, so that a changed one does not meet a model of another."""
    import inspect

    from . import pii_grammar, pii_labels, tagger

    return hashlib.sha256("".join(inspect.getsource(m) for m in (pii_grammar, pii_labels, tagger, fit, _least, tag)).encode()).hexdigest()


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, words = [], []
        for r, text in enumerate(batch.column(1).to_pylist()):
            own = set(map(str.lower, _WORD.findall(text or "")))
            rows += [r] * len(own)
            words += own
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.string())], ["id", "name"])


def _with_known(src: DataFrame, kind: str, names: DataFrame) -> DataFrame:
    """(id, text, known): the names that occur in each text, met in a join; names are rare among words, so what comes back is small."""
    met = src.mapInArrow(_word_batches, f"id {kind}, name string").join(names, "name", "left_semi").groupBy("id").agg(F.collect_set("name").alias("known"))
    return src.alias("s").join(met.alias("m"), F.expr("s.id <=> m.id"), "left").select("s.id", "s.text", "m.known")


def _prepared(docs: DataFrame, names: DataFrame, id_col: str, text_col: str, fit_docs: int, steps: int, sent_names: int):
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model, large = fitted(src, names, fit_docs, steps, sent_names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kind, src if large is None else _with_known(src, kind, large), sent


def spans(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, steps: int = STEPS, sent_names: int = SENT_NAMES) -> DataFrame:
    """(id, starts, ends, kinds): the spans of each row, ascending; a narrow map with no shuffle, but for names too many to be sent."""
    kind, src, sent = _prepared(docs, names, id_col, text_col, fit_docs, steps, sent_names)
    return src.mapInArrow(lambda it: _span_batches(it, sent), f"id {kind}, starts array<int>, ends array<int>, kinds array<string>").withColumnRenamed("id", id_col)


def replaced(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with typed placeholders, otherwise unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in found:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def _redact_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [replaced(t, s) for texts, found in _tagged(batch, sent.value) for t, s in zip(texts, found)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], ["id", "text"])


def redacted(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, steps: int = STEPS, sent_names: int = SENT_NAMES) -> DataFrame:
    """(id, text) with typed placeholders."""
    kind, src, sent = _prepared(docs, names, id_col, text_col, fit_docs, steps, sent_names)
    return src.mapInArrow(lambda it: _redact_batches(it, sent), f"id {kind}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
