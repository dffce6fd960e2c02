"""A character-level bidirectional LSTM with CRF transitions, in numpy: fitting, decoding, and a cheap screen before it."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

from . import flat

#: Cells per direction, characters of a window in fitting and in decoding, and how many two windows share; windows of a fitting step, number of steps (the same for any input), rate.
CELLS, WINDOW, DECODED, SHARED, STEP, STEPS, RATE = 32, 72, 144, 28, 48, 1000, 0.012
SCREEN_BITS, SCREEN_GRAM, SCREEN_SPAN = 20, 5, 12
#: Characters whose grams are counted at once.
COUNTED = 2_000_000
NEVER = -1e4


@functools.cache
def folded() -> np.ndarray:
    """Input symbol of every code point: letters without their marks, digits as zero or not, one symbol for each other script."""
    table = np.zeros(0x110000, np.uint8)
    ids: dict[str, int] = {"other": 0}
    number = lambda key: ids.setdefault(key, len(ids))
    for c in [chr(k) for k in range(32, 127)]:
        number("1" if c in "23456789" else c)
    for c in "абвгдежзийклмнопрстуфхцчшщъыьэюя":
        number(c)
        number(c.upper())
    dashes, singles, doubles = "‐‑‒–—―−－", "‘’‚ʼ", "“”„«»"
    for code in range(0x3000):
        c = chr(code)
        kind = unicodedata.category(c)
        base = unicodedata.normalize("NFKD", c)[:1]
        if kind == "Nd":
            key = "0" if unicodedata.digit(c) == 0 else "1"
        elif c in ids:
            key = c
        elif c in dashes or c in singles or c in doubles:
            key = "-" if c in dashes else "'" if c in singles else '"'
        elif c in "\n\r":
            key = "line"
        elif kind == "Zs" or c == "\t":
            key = " "
        elif kind in ("Mn", "Me", "Cf", "Cc"):
            key = "mark"
        elif base in ids and kind[0] == "L":
            key = base
        elif kind[0] == "L" and code < 0x600:
            key = "upper" if kind == "Lu" else "lower"
        elif kind[0] in "LM":
            key = f"script{code >> 8}"
        else:
            key = "sign"
        table[code] = number(key)
    for a, b, key in ((0x3000, 0x3040, "cjk sign"), (0x3040, 0x3100, "kana"), (0x3100, 0xD800, "cjk"), (0xE000, 0x110000, "far")):
        table[a:b] = number(key)
    table[0x3000] = number(" ")
    for code in range(0xFF01, 0xFF5F):
        table[code] = table[code - 0xFEE0]
    return table


SYMBOLS = 256


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each number."""
    order = np.argsort(at, kind="stable")
    used, begin = np.unique(at[order], return_index=True)
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[used] = np.add.reduceat(rows[order], begin, axis=0)
    return out


def _zeros(*shape: int) -> np.ndarray:
    """Zeros that begin at a cache line, which vector instructions read and write faster."""
    size = 4 * int(np.prod(shape))
    room = np.zeros(size + 64, np.uint8)
    begin = -room.ctypes.data % 64
    return room[begin : begin + size].view(np.float32).reshape(shape)


class Tagger:
    """Tags are 0 for outside, then begin and inside of each kind."""

    def __init__(self, kinds: int, flags: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, self.tags, self.flags = CELLS, 1 + 2 * kinds, flags
        small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        # both directions lie in one array: the second reads the window from its end
        self.p = {"x": small(2, SYMBOLS, 4 * h), "g": small(2, flags, 4 * h), "h": small(2, h, 4 * h), "c": np.zeros((2, 4 * h), np.float32)}
        self.p["c"][:, h : 2 * h] = 1.0
        self.p |= {"out": small(2 * h, self.tags), "bias": np.zeros(self.tags, np.float32), "move": np.zeros((self.tags, self.tags), np.float32)}
        self.banned = np.zeros((self.tags, self.tags), np.float32)
        for k in range(kinds):
            inside = 2 + 2 * k
            self.banned[:, inside] = NEVER
            self.banned[[inside - 1, inside], inside] = 0.0
        self.first = np.zeros(self.tags, np.float32)

    def _run(self, sym: np.ndarray, flag: np.ndarray, keep: bool):
        """Hidden states of both directions, time by direction by window, each in its own order of time."""
        t_all, n = sym.shape
        h, p = CELLS, self.p
        x = p["x"] + p["c"][:, None]
        hid, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, store = np.empty((t_all, 2, n, h), np.float32), []
        z = np.empty((2, n, 4 * h), np.float32)
        for t in range(t_all):
            u = t_all - 1 - t
            np.matmul(hid, p["h"], out=z)
            z[0] += x[0][sym[t]]
            z[0] += p["g"][0][flag[t]]
            z[1] += x[1][sym[u]]
            z[1] += p["g"][1][flag[u]]
            gates = sigmoid(z[:, :, : 3 * h])
            g = np.tanh(z[:, :, 3 * h :])
            before = cell
            cell = gates[:, :, h : 2 * h] * before + gates[:, :, :h] * g
            th = np.tanh(cell)
            if keep:
                store.append((gates, g, before, th, hid))
            hid = gates[:, :, 2 * h :] * th
            out[t] = hid
        return out, store

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What symbol and flag give to the gates, in one table, and the weights of the state, both gate by gate; halves go with _steps."""
        h, p = CELLS, self.p
        half = np.repeat(np.array([0.5, 1.0], np.float32), [3 * h, h])  # sigmoid(x) = (tanh(x / 2) + 1) / 2
        given = ((p["x"] + p["c"][:, None])[:, :, None] + p["g"][:, None]).reshape(2, -1, 4, h) * half.reshape(4, h)
        table, weights = _zeros(4, *given.shape[:2], h), _zeros(4, 2, h, h)
        table[:] = given.transpose(2, 0, 1, 3)
        weights[:] = (p["h"] * half * np.float32(0.5)).reshape(2, h, 4, h).transpose(2, 0, 1, 3)
        return table.reshape(-1, h), weights

    def _steps(self, sym: np.ndarray, flag: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[np.ndarray]:
        """Of each step twice the hidden states that _run gives; the next step writes over them.

        All gates go through one tanh, gate by gate in its own block, so that every pass runs over adjacent numbers. Halves
        and doubles are exact in binary, they only move between the factors.
        """
        t_all, n = sym.shape
        h = CELLS
        table, weights = tables or self.tables()
        size = len(table) // 8
        at = sym.astype(np.intp) * self.flags + flag
        block, rows = np.arange(8).reshape(4, 2, 1) * size, np.empty((4, 2, n), np.intp)
        z, given, hid, cell = _zeros(4, 2, n, h), _zeros(4, 2, n, h), _zeros(2, n, h), _zeros(2, n, h)
        into, keep, out, new = z
        one, halved = np.float32(1), np.float32(0.5)
        for t in range(t_all):
            np.add(at[t], block[:, 0], out=rows[:, 0])
            np.add(at[t_all - 1 - t], block[:, 1], out=rows[:, 1])
            table.take(rows, 0, given, "clip")
            np.matmul(hid, weights, out=z)
            z += given
            np.tanh(z, out=z)
            z[:3] += one
            cell *= keep
            into *= new
            cell += into
            cell *= halved
            np.tanh(cell, out=new)
            np.multiply(out, new, out=hid)
            yield hid

    def _states(self, sym: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """Hidden states as _run gives them."""
        return np.stack([hid * np.float32(0.5) for hid in self._steps(sym, flag)])

    def scores(self, sym: np.ndarray, flag: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Scores of the tags, time by window by tag; in memory the windows of a tag are adjacent. tables are those of the tagger, made once for many calls."""
        t_all, n = sym.shape
        out, each = _zeros(2, self.tags, CELLS), _zeros(t_all, 2, self.tags, n)
        out[:] = (self.p["out"] * np.float32(0.5)).reshape(2, CELLS, self.tags).transpose(0, 2, 1)
        for t, hid in enumerate(self._steps(sym, flag, tables)):
            np.matmul(out, hid.transpose(0, 2, 1), out=each[t])
        e = each[:, 0] + each[::-1, 1]
        e += self.p["bias"][:, None]
        return e.transpose(0, 2, 1)

    def decode(self, sym: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path of each window (Viterbi), and by how much the scores of its tags exceed that of no span."""
        e = self.scores(sym, flag)
        path, gain = np.zeros(e.shape[:2], np.int8), np.zeros(e.shape[:2], np.float32)
        if len(on := np.flatnonzero(self._may_hold(e))):
            path[:, on], gain[:, on] = self._viterbi(e[:, on])
        return path, gain

    def suspects(self, e: np.ndarray) -> np.ndarray:
        """Which windows may have a path that scores more than that of no span: all that have one, and few others.

        Each kind's best span is followed by itself, its way out included; where none scores more than no span, no path of
        several does. A move from one span to the next counts at least as the way out of the one and the way into the other.
        """
        move = self.p["move"] + self.banned
        move = move - move[0, 0]
        rows, leave = e.transpose(0, 2, 1), move[1:, :1]
        enter = (move[:, 1::2] - move[:, :1]).max(0)[:, None] + leave[::2]
        begin, inside = np.arange(1, self.tags, 2), np.arange(2, self.tags, 2)
        go, stay = move[begin, inside][:, None] - leave[::2] + leave[1::2], move[inside, inside][:, None]
        best = top = rows[0, 1:] - rows[0, 0] + leave
        for row in rows[1:]:
            more = row[1:] - row[0]  # over no span
            more[::2] += enter
            more[1::2] += np.maximum(best[::2] + go, best[1::2] + stay)
            best, top = more, np.maximum(top, more)
        return np.maximum(top, best - leave).max(0) > -0.01  # less than that rounding does not add

    def _may_hold(self, e: np.ndarray) -> np.ndarray:
        """Which windows have a path that scores more than that of no span, by the scores of Viterbi without the way back."""
        out = self.suspects(e)
        if len(on := np.flatnonzero(out)):
            move = self.p["move"] + self.banned
            move = (move - move[0, 0])[:, :, None]
            more = np.ascontiguousarray((e[:, on] - e[:, on, :1]).transpose(0, 2, 1))  # over no span
            best = more[0]
            for row in more[1:]:
                best = (best[:, None] + move).max(0) + row
            out[on] = best.max(0) > 0
        return out

    def _viterbi(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        move = (self.p["move"] + self.banned)[:, :, None]
        t_all, n, _ = e.shape
        rows = e.transpose(0, 2, 1)
        best = np.empty((t_all, self.tags, n), np.float32)
        best[0] = rows[0]
        for t in range(1, t_all):
            best[t] = (best[t - 1][:, None] + move).max(0) + rows[t]
        path = np.empty((t_all, n), np.int8)
        path[-1] = best[-1].argmax(0)
        into = np.ascontiguousarray(move[:, :, 0].T)
        for t in range(t_all - 1, 0, -1):  # the way back is that of the same sums
            path[t - 1] = (best[t - 1].T + into[path[t]]).argmax(1)
        return path, np.take_along_axis(e, path[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0]

    def _gradients(self, sym, flag, gold, valid) -> tuple[float, dict]:
        t_all, n = sym.shape
        h = CELLS
        outs, store = self._run(sym, flag, True)
        both = np.concatenate([outs[:, 0], outs[::-1, 1]], axis=2)
        e = both @ self.p["out"] + self.p["bias"]
        move = self.p["move"] + self.banned
        # CRF by forward and backward sums; beyond the end of a window scores are zero and all tags alike
        e = e * valid[:, :, None]
        shift = np.exp(np.maximum(move, -60.0))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, t_all):
            top = alpha[t - 1].max(1, keepdims=True)
            step = np.log(np.exp(alpha[t - 1] - top) @ shift + 1e-30) + top + e[t]
            alpha[t] = np.where(valid[t][:, None] > 0, step, alpha[t - 1])
        for t in range(t_all - 2, -1, -1):
            ahead = e[t + 1] + beta[t + 1]
            top = ahead.max(1, keepdims=True)
            step = np.log(np.exp(ahead - top) @ shift.T + 1e-30) + top
            beta[t] = np.where(valid[t + 1][:, None] > 0, step, beta[t + 1])
        top = alpha[-1].max(1, keepdims=True)
        whole = (np.log(np.exp(alpha[-1] - top).sum(1, keepdims=True)) + top)
        share = np.exp(alpha + beta - whole[None])
        grad = share * valid[:, :, None]
        np.put_along_axis(grad, gold[:, :, None], np.take_along_axis(grad, gold[:, :, None], 2) - valid[:, :, None], 2)
        gmove = np.zeros_like(move)
        real = 0.0
        for t in range(1, t_all):
            on = valid[t][:, None]
            a = np.exp(alpha[t - 1] - whole) * on
            b = np.exp(np.minimum(e[t] + beta[t], 60.0))
            gmove += (a.T @ b) * shift
            np.add.at(gmove, (gold[t - 1], gold[t]), -valid[t])
        picked = np.take_along_axis(e, gold[:, :, None], 2)[:, :, 0].sum()
        moves = (move[gold[:-1], gold[1:]] * valid[1:]).sum()
        loss = float((whole.sum() - picked - moves) / n) + real
        g = {"move": np.clip(gmove, -50, 50) / n, "bias": grad.sum((0, 1)) / n}
        grad /= n
        g["out"] = both.reshape(-1, 2 * h).T @ grad.reshape(-1, self.tags)
        back = grad @ self.p["out"].T
        wh = self.p["h"].transpose(0, 2, 1).copy()
        dz_all = np.empty((t_all, 2, n, 4 * h), np.float32)
        dh, dc, gwh = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32), np.zeros_like(self.p["h"])
        for t in range(t_all - 1, -1, -1):
            gates, c_in, before, th, hid = store[t]
            dh[0] += back[t][:, :h]
            dh[1] += back[t_all - 1 - t][:, h:]
            i, f, o = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            dc = dc + dh * o * (1 - th * th)
            dz = dz_all[t]
            dz[:, :, :h] = dc * c_in * i * (1 - i)
            dz[:, :, h : 2 * h] = dc * before * f * (1 - f)
            dz[:, :, 2 * h : 3 * h] = dh * th * o * (1 - o)
            dz[:, :, 3 * h :] = dc * i * (1 - c_in * c_in)
            gwh += hid.transpose(0, 2, 1) @ dz
            dh = dz @ wh
            dc = dc * f
        flat = [dz_all[:, 0].reshape(-1, 4 * h), dz_all[::-1, 1].reshape(-1, 4 * h)]
        g |= {"h": gwh, "x": np.stack([_summed(sym.ravel(), f, SYMBOLS) for f in flat]), "g": np.stack([_summed(flag.ravel(), f, self.flags) for f in flat]), "c": np.stack([f.sum(0) for f in flat])}
        return loss, g

    def fit(self, sym: np.ndarray, flag: np.ndarray, gold: np.ndarray, valid: np.ndarray, hide: np.ndarray, steps: int = STEPS, seed: int = 5) -> float:
        """Windows as rows; Adam with a falling rate. hide maps each flag to the one without the help of the name list. Returns the last losses' mean."""
        rng = np.random.default_rng(seed)
        mean, square = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        order, losses = np.zeros(0, np.int64), []
        for done in range(1, steps + 1):
            if len(order) < STEP:
                order = np.concatenate([order, *[rng.permutation(len(sym)) for _ in range(-(-STEP // len(sym)))]])
            at, order = order[:STEP], order[STEP:]
            f = flag[at].copy()
            blind = rng.random(len(at)) < 0.3
            f[blind] = hide[f[blind]]
            loss, g = self._gradients(sym[at].T, f.T, gold[at].T, valid[at].T)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
            rate = RATE * min(1.0, done / 50) * (0.5 + 0.5 * np.cos(np.pi * done / (steps + 1)))
            for k, v in g.items():
                v = v * scale
                mean[k] += np.float32(0.1) * (v - mean[k])
                square[k] += np.float32(0.01) * (v * v - square[k])
                self.p[k] -= np.float32(rate / (1 - 0.9**done)) * mean[k] / (np.sqrt(square[k] * np.float32(1 / (1 - 0.99**done))) + np.float32(1e-8))
            losses.append(loss)
        return float(np.mean(losses[-50:]))


class Screen:
    """Which stretches may hold a span at all: log odds of character 5-grams, summed over 12 characters."""

    def __init__(self, texts_sym: list[np.ndarray], texts_gold: list[np.ndarray], keep: float = 0.999):
        size = 1 << SCREEN_BITS
        inside, outside = np.zeros(size, np.float32), np.zeros(size, np.float32)
        codes = [self.grams(s) for s in texts_sym]
        for a, b in flat.slices(np.array([len(c) for c in codes], np.int64), COUNTED):
            code, on = np.concatenate(codes[a:b]), np.concatenate(texts_gold[a:b]) > 0
            inside += np.bincount(code[on], minlength=size)
            outside += np.bincount(code[~on], minlength=size)
        self.odds = np.log((inside + 0.05) / (outside + 0.5)).astype(np.float32)
        peaks = []
        for code, gold in zip(codes, texts_gold):
            if not (gold > 0).any():
                continue
            # a gram counts without its own occurrence, as it would in a text that was not fitted
            on = gold > 0
            own = np.log((np.maximum(inside[code] - 1, 0) + 0.05) / (outside[code] + 0.5))
            total = self.spread(np.where(on, own, self.odds[code]).astype(np.float32))
            begins = np.flatnonzero(gold % 2 == 1)
            ends = [int(np.flatnonzero(np.append(gold[b + 1 :], 0) % 2 * 1 + (np.append(gold[b + 1 :], 0) == 0) > 0)[0]) + b + 1 for b in begins]
            peaks += [total[b:e].max() for b, e in zip(begins, ends)]
        self.least = float(np.quantile(peaks, 1 - keep)) if peaks else np.inf

    @staticmethod
    def grams(sym: np.ndarray) -> np.ndarray:
        wide = np.concatenate([np.zeros(2, np.uint8), sym, np.zeros(2, np.uint8)]).astype(np.uint32)
        code = np.zeros(len(sym), np.uint32)
        for k in range(SCREEN_GRAM):
            code = code * np.uint32(0x01000193) ^ (wide[k : k + len(sym)] * np.uint32(0x9E3779B1))
        return code >> np.uint32(32 - SCREEN_BITS)

    @staticmethod
    def spread(odds: np.ndarray) -> np.ndarray:
        """Sum over the SCREEN_SPAN characters around each."""
        half = SCREEN_SPAN // 2
        none = np.zeros(half, odds.dtype)
        sums = np.cumsum(np.concatenate([none[:1], none, odds, none]), dtype=np.float64)
        return (sums[2 * half : 2 * half + len(odds)] - sums[: len(odds)]).astype(np.float32)

    def passes(self, sym: np.ndarray) -> np.ndarray:
        return self.spread(self.odds[self.grams(sym)]) >= self.least
