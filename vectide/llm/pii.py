"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The network reads characters as a few dozen classes, in both directions, with piecewise-linear gates, so that
a step is two small matrix products; a linear-chain CRF over its outputs labels every character. It is trained
in numpy on labelled spans: those of the fixed patterns in a bounded sample of rows, and written-out variants
of them. Whole texts are read in overlapping windows. The windows' outputs are added up character by
character, each weighted by how deep it stands in its window, and each text is decoded once as a whole:
its blocks are reduced to transfer matrices side by side, which makes the one best path of any length cheap.
The patterns' spans always stay; the network adds spans that overlap none of them and hold up as their kind.

A span that holds up has a digit, an @ or the word "at" (``needed``). Windows are therefore read on demand: those of such
characters first, then on to either side until the best path is at 0 whatever the windows beyond say. What is not read can't be
in a span that is kept, so the result is that of reading every window.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import LOWER, flat, in_arrow, sampled, steps, table

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
HIDDEN = 16
WIDTH, OVERLAP = 96, 32
STRIDE = WIDTH - OVERLAP
#: Characters that are read on either side of a sign.
REACH = 64
#: Characters of a block of the decoder.
BLOCK = 64
#: Distinct rows whose spans the network learns from, by their digest, half of them with a sign; SAMPLE_CHARS bounds a row's
#: text. And windows made of them.
SAMPLE = 400
WINDOWS = 6400
EPOCHS = 11

# --- fixed patterns ---------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that time stays in proportion to the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        got = _DOMAIN.match(text, at + 1) if start < at else None
        if got:
            out.append((start, got.end()))
            free = got.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns in code points, by kind as listed, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- characters -------------------------------------------------------------------------------------------

_KNOWN = "adot@._+-()[]{}<>%: \t\n,;/#*"
CLASSES = 6 + len(_KNOWN)
_CLASS = np.full(256, 5, np.uint8)  # 0 is beyond the text
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
for _k, _c in enumerate(_KNOWN):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = 6 + _k


def classes(data: np.ndarray) -> np.ndarray:
    """A class for each code point of UTF-8 bytes."""
    return _CLASS[data[(data & 0xC0) != 0x80]]


# --- the network ------------------------------------------------------------------------------------------


def _clip(x: np.ndarray, low: float) -> np.ndarray:
    """``x`` itself, brought between ``low`` and 1."""
    np.maximum(x, np.float32(low), out=x)
    return np.minimum(x, np.float32(1), out=x)


class Net:
    """Parameters by name, and the forward, backward and decoding passes over time-major batches."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"V": rng.normal(0, 0.3, (2 * h, LABELS)), "b": np.zeros(LABELS), "A": np.zeros((LABELS, LABELS)), "s": np.zeros(LABELS)}
        for side in "fb":
            self.p["G" + side] = rng.normal(0, 0.5, (CLASSES, 4 * h))
            self.p["G" + side][:, h : 2 * h] += 1  # forget gates start open
            self.p["U" + side] = rng.normal(0, 0.3, (h, 4 * h))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def hidden(self, x: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """(time, batch, HIDDEN) outputs; gates are clip(z/4 + 1/2, 0, 1), candidates clip(z, -1, 1)."""
        if trace is None:
            return self._read(x, side)
        h = HIDDEN
        table_, u = self.p["G" + side].copy(), self.p["U" + side].copy()
        table_[:, : 3 * h] = table_[:, : 3 * h] * 0.25 + 0.5
        u[:, : 3 * h] *= 0.25
        span, batch = x.shape
        out = np.empty((span, batch, h), np.float32)
        state, c = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        z, add = np.empty((batch, 4 * h), np.float32), np.empty((batch, 4 * h), np.float32)
        for t in range(span) if side == "f" else range(span - 1, -1, -1):
            np.matmul(state, u, out=z)
            np.take(table_, x[t], axis=0, out=add)
            z += add
            a = np.clip(z[:, : 3 * h], 0, 1)
            g = np.clip(z[:, 3 * h :], -1, 1)
            was = c
            c = a[:, h : 2 * h] * c + a[:, :h] * g
            np.multiply(a[:, 2 * h :], np.clip(c, -1, 1), out=out[t])
            trace.append((t, state, a, g, was, c))
            state = out[t]
        return out

    def _read(self, x: np.ndarray, side: str) -> np.ndarray:
        """``hidden`` without a trace: a gate's values stand side by side, and steps are taken in place."""
        h, (span, batch) = HIDDEN, x.shape
        table_, u = self.p["G" + side].T.copy(), self.p["U" + side].T.copy()
        table_[: 3 * h] = table_[: 3 * h] * 0.25 + 0.5
        u[: 3 * h] *= 0.25
        out = np.empty((span, batch, h), np.float32)
        state, c, kept, z, add = (np.zeros((n, batch), np.float32) for n in (h, h, h, 4 * h, 4 * h))
        for t in range(span) if side == "f" else range(span - 1, -1, -1):
            np.matmul(u, state, out=z)
            z += np.take(table_, x[t], axis=1, out=add, mode="clip")
            _clip(z[: 3 * h], 0)
            g = _clip(z[3 * h :], -1)
            g *= z[:h]
            c *= z[h : 2 * h]
            c += g
            kept[:] = c
            np.multiply(_clip(kept, -1), z[2 * h : 3 * h], out=state)
            out[t] = state.T
        return out

    def emissions(self, x: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        first, second = traces or (None, None)
        both = np.concatenate([self.hidden(x, "f", first), self.hidden(x, "b", second)], axis=2)
        return both @ self.p["V"] + self.p["b"], both

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean CRF negative log-likelihood of labels y, and its gradient."""
        traces: tuple[list, list] = ([], [])
        e, both = self.emissions(x, traces)
        span, batch = x.shape
        # Forward and backward sums as scaled products.
        a_, s_ = np.exp(self.p["A"].astype(float)), np.exp(self.p["s"].astype(float))
        peak = e.max(2, keepdims=True)
        near = np.exp((e - peak).astype(float))
        alpha, beta, unit = np.empty((span, batch, LABELS)), np.ones((span, batch, LABELS)), np.empty((span, batch, 1))
        for t in range(span):
            now = (s_ if t == 0 else alpha[t - 1] @ a_) * near[t]
            unit[t] = now.sum(1, keepdims=True)
            alpha[t] = now / unit[t]
        for t in range(span - 2, -1, -1):
            beta[t] = (near[t + 1] * beta[t + 1] / unit[t + 1]) @ a_.T
        z = (np.log(unit) + peak).sum((0, 2))
        rows = np.arange(batch)
        gold = self.p["s"][y[0]] + e[np.arange(span)[:, None], rows[None], y].sum(0) + self.p["A"][y[:-1], y[1:]].sum(0)
        d_e = alpha * beta
        d_s = d_e[0].sum(0) - np.bincount(y[0], minlength=LABELS)
        after = (near * beta / unit)[1:].reshape(-1, LABELS)
        moves = np.bincount((y[:-1].astype(int) * LABELS + y[1:]).ravel(), minlength=LABELS**2).reshape(LABELS, LABELS)
        d_a = alpha[:-1].reshape(-1, LABELS).T @ after * a_ - moves
        d_e[np.arange(span)[:, None], rows[None], y] -= 1
        d_e = (d_e / batch).astype(np.float32)
        g = {"A": d_a / batch, "s": d_s / batch, "b": d_e.sum((0, 1)), "V": np.einsum("tbh,tbl->hl", both, d_e)}
        d_h = d_e @ self.p["V"].T
        h = HIDDEN
        order = np.argsort(x.ravel(), kind="stable")
        kinds, first = np.unique(x.ravel()[order], return_index=True)
        for side, trace, cut in (("f", traces[0], slice(0, h)), ("b", traces[1], slice(h, 2 * h))):
            every, states = np.empty((span, batch, 4 * h), np.float32), np.empty((span, batch, h), np.float32)
            back_h, back_c = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
            back = self.p["U" + side].T.copy()
            for t, state, a, cand, was, c in reversed(trace):
                dh = d_h[t][:, cut] + back_h
                i, f, o = a[:, :h], a[:, h : 2 * h], a[:, 2 * h :]
                dc = back_c + dh * o * (np.abs(c) < 1)
                d_g = every[t]
                d_g[:, :h], d_g[:, h : 2 * h], d_g[:, 2 * h : 3 * h] = dc * cand, dc * was, dh * np.clip(c, -1, 1)
                d_g[:, : 3 * h] *= 0.25 * ((a > 0) & (a < 1))
                d_g[:, 3 * h :] = dc * i * (np.abs(cand) < 1)
                back_c = dc * f
                back_h = d_g @ back
                states[t] = state
            d_table = np.zeros((CLASSES, 4 * h))
            d_table[kinds] = np.add.reduceat(every.reshape(-1, 4 * h)[order], first)
            g["U" + side], g["G" + side] = states.reshape(-1, h).T @ every.reshape(-1, 4 * h), d_table
        return float((z - gold).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, seed: int = 3) -> float:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros(p.shape) for k, p in self.p.items()} for _ in range(2))
        step, loss, whole = 0, 0.0, epochs * -(-x.shape[1] // batch)
        for _ in range(epochs):
            order, loss = rng.permutation(x.shape[1]), 0.0
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                now, g = self.gradient(x[:, part], y[:, part])
                loss += now * len(part) / len(order)
                scale = min(1.0, 5.0 / (np.sqrt(sum(float((d * d).sum()) for d in g.values())) + 1e-9))
                step += 1
                for name, d in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * d * scale
                    v[name] = 0.99 * v[name] + 0.01 * (d * scale) ** 2
                    self.p[name] = (self.p[name] - rate * (1 - 0.9 * step / whole) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def labels(self, e: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """``decode``, but for the characters that are 0 on the best path for certain: those whose output for 0 is further
        above the others than any neighbours' transitions could make up for. What stands between them is decoded by itself."""
        a = self.p["A"]
        lead = (a[:, 1:] - a[:, :1]).max(0) + (a[1:] - a[:1]).max(1)  # the most that a label's transitions gain on those of 0
        open_ = np.flatnonzero((e[:, :1] - e[:, 1:] <= lead + 1e-3).any(1))
        out = np.zeros(len(e), np.uint8)
        if len(open_):
            run = np.searchsorted(edge, open_, "right")
            new = np.flatnonzero((np.diff(open_) != 1) | (np.diff(run) != 0)) + 1
            out[open_] = self.decode(e[open_], np.concatenate([[0], new, [len(open_)]]))
        return out

    def decode(self, e: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The best labels of runs of characters, given their outputs one after the other and the runs' bounds. Before and
        after a run stands label 0. Exact for any length: each block's best scores from any label to any other are
        found side by side, the blocks of a run are chained, and the path is read back within all blocks at once."""
        a = self.p["A"].astype(np.float32)
        sizes = np.diff(edge)
        blocks = sizes // BLOCK + 1  # at least one character after the run, which is label 0
        begin = np.cumsum(blocks) - blocks
        n = int(blocks.sum())
        spot = np.repeat(begin * BLOCK - edge[:-1], sizes) + np.arange(len(e))
        out = np.full((n * BLOCK, LABELS), -1e6, np.float32)
        out[:, 0] = 0
        out[spot] = e
        out = out.reshape(n, BLOCK, LABELS)
        score, back = a[None] + out[:, 0, None, :], np.zeros((BLOCK, n, LABELS, LABELS), np.uint8)
        for t in range(1, BLOCK):
            every = score[:, :, :, None] + a
            back[t] = every.argmax(2)
            score = every.max(2) + out[:, t, None, :]
        best, came = np.full((len(sizes), LABELS), -np.inf), np.zeros((n, LABELS), np.uint8)
        best[:, 0] = 0
        for k in range(int(blocks.max(initial=0))):
            run = np.flatnonzero(blocks > k)
            every = best[run][:, :, None] + score[begin[run] + k]
            came[begin[run] + k] = every.argmax(1)
            best[run] = every.max(1)
        now, first, last = best.argmax(1), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        for k in range(int(blocks.max(initial=0)) - 1, -1, -1):
            run = np.flatnonzero(blocks > k)
            b = begin[run] + k
            last[b] = now[run]
            now[run] = first[b] = came[b, now[run]]
        label, rows = np.zeros((n, BLOCK), np.uint8), np.arange(n)
        label[:, -1] = now = last
        for t in range(BLOCK - 1, 0, -1):
            label[:, t - 1] = now = back[t, rows, first, now]
        return label.reshape(-1)[spot]


    def settled(self, e: np.ndarray, edge: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pieces of texts, given their outputs one after the other and the pieces' bounds: the best labels between
        labels 0, and which characters are 0 whatever labels stand before the piece and at its end. ``head`` and ``tail``
        say of each piece whether a text begins and ends with it; label 0 stands before and after a text."""
        a, sizes = self.p["A"].astype(np.float32), np.diff(edge)
        order = np.argsort(-sizes, kind="stable")  # the longest first, so that those that still run are in front
        begin, sizes, tail = edge[:-1][order], sizes[order], tail[order]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # pieces that have a character number t
        score, back = a[None] + e[begin][:, None, :], np.zeros((sizes[0], len(sizes), LABELS, LABELS), np.uint8)
        for t in range(1, sizes[0]):
            m = active[t]
            every = score[:m, :, :, None] + a
            back[t, :m] = every.argmax(2)
            score[:m] = every.max(2) + e[begin[:m] + t][:, None, :]
        # Paths by the label before the piece and the one at its end; a text's end leaves one for each label before.
        now = np.broadcast_to(np.arange(LABELS, dtype=np.uint8), score.shape).copy()
        now[tail] = (score[tail] + a[:, 0]).argmax(2)[:, :, None]
        now[head[order]] = now[head[order]][:, :1]
        before = np.arange(LABELS)[None, :, None] * ~head[order][:, None, None]
        path, zero, rows = np.zeros(len(e), np.uint8), np.zeros(len(e), bool), np.arange(len(sizes))[:, None, None]
        for t in range(sizes[0] - 1, -1, -1):
            m = active[t]
            path[begin[:m] + t] = now[:m, 0, 0]
            zero[begin[:m] + t] = (now[:m] == 0).all((1, 2))
            now[:m] = back[t, rows[:m], before[:m], now[:m]]
        return path, zero


# --- training windows -------------------------------------------------------------------------------------


def _variant(kind: int, rng) -> str:
    """A made-up span of a kind, in a spelling that the fixed patterns may miss."""
    letters = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))
    word = lambda a, b: letters(a, b).capitalize() if rng.random() < 0.15 else letters(a, b).upper() if rng.random() < 0.05 else letters(a, b)
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    pick = lambda *x: x[rng.integers(len(x))]
    space = lambda: pick("", "", " ")

    def sign(name: str, plain: str) -> str:
        """A sign as it is, spaced, in brackets, or spelled out."""
        inner = pick(name, name, name.upper(), plain)
        opened, closed = pick("[]", "()", "[]", "()", "{}", "<>")
        return pick(plain, space() + plain + space(), space() + opened + inner + closed + space(), " " + opened + inner + closed + " ", f" {pick(name, name.upper())} ")

    if kind == 0:
        local = pick(word(3, 9), f"{word(2, 8)}{pick('.', '_', '-')}{word(2, 8)}", f"{word(3, 8)}{num(rng.integers(1, 4))}")
        at, dot = sign("at", "@"), sign("dot", ".")
        host = dot.join([f"{word(3, 9)}{num(rng.integers(0, 2))}", *(word(3, 8) for _ in range(rng.integers(0, 2))), pick("com", "org", "net", "de", "io", "edu", "co" + dot + "uk")])
        return f"{local}{at}{host}"
    if kind == 1:
        return sign("dot", ".").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        size = pick(16, 16, 16, 15)
        body = str(rng.integers(3, 6)) + num(size - 2)
        digits = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = pick("", " ", "-", ".", " - ", "  ", "_", "/", " . ", "\t", ",")
        groups = [digits[k : k + 4] for k in range(0, 16, 4)] if size == 16 else [digits[:4], digits[4:10], digits[10:]]
        return sep.join(groups)
    sep, other = (pick(" ", "-", ".", "/", "-", " ", ".", " - ", "") for _ in range(2))
    if rng.random() < 0.35:
        return f"{pick('', '', '', '1-', '1 ', '+1 ')}{num(3)}{sep or '.'}{num(3)}{pick(sep, sep, other) or '-'}{num(4)}"
    area = pick(f"({num(3)}) ", f"({num(3)})", f"{num(3)}{sep or ' '}", f"({num(4)}) ", f"0{num(2)}{sep or '-'}")
    head = pick("", "", f"+{num(rng.integers(1, 3))} ", f"00{num(2)} ", f"+{num(2)}-", f"{num(1)}-", "+1 ")
    return pick(f"{head}{area}{num(3)}{sep or '-'}{num(4)}", f"{head}{area}{num(2)}{sep or ' '}{num(2)}{sep or ' '}{num(3)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"00{num(2)} {num(2)} {num(rng.integers(6, 8))}", f"{head}{area}{num(rng.integers(6, 8))}")


def _other(rng) -> str:
    """Figures and signs that are no personal data."""
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    made = (
        str(rng.integers(1, 10**6)), f"{rng.integers(1900, 2030)}-0{rng.integers(1, 10)}-1{rng.integers(0, 10)}", f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}", f"{rng.integers(0, 24)}:{rng.integers(10, 60)}",
        "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, 40)), f"${rng.integers(1, 999)}.{rng.integers(10, 99)}", f"{num(1)},{num(3)},{num(3)}", f"{num(2)}/{num(2)}/{rng.integers(1900, 2030)}",
        f"{rng.integers(0, 9)}.{num(6)}", f"{rng.integers(1, 99)}%", f"(at {rng.integers(1, 13)} pm)", "@" + "".join(chr(97 + c) for c in rng.integers(0, 26, 6)), f"dot {num(1)}", f"[{num(2)}]", f"{num(3)} x {num(3)}", f"{num(2)}.{num(2)}.{rng.integers(1990, 2030)}",
    )
    return made[rng.integers(len(made))]


def labelled(texts: list[str], windows: int = WINDOWS, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(classes, labels), time-major, of windows around patterns' spans, written-out variants, and neither."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["a b c"]
    spans = [(k, s) for k, t in enumerate(texts) for s in base_spans(t)]
    x, y = np.zeros((WIDTH, windows), np.uint8), np.zeros((WIDTH, windows), np.uint8)
    for w in range(windows):
        what = w % 4
        if what == 0 and spans:
            k, (_, a, b) = spans[rng.integers(len(spans))]
            start = max(0, a - int(rng.integers(0, max(1, WIDTH - (b - a)))))
        else:
            k = int(rng.integers(len(texts)))
            start = int(rng.integers(0, max(1, len(texts[k]) - WIDTH // 2)))
        piece = texts[k][start : start + WIDTH]
        label = np.zeros(len(piece), np.uint8)
        for kind, a, b in base_spans(texts[k][max(0, start - WIDTH) : start + 2 * WIDTH]):
            a, b = a + max(0, start - WIDTH) - start, b + max(0, start - WIDTH) - start
            label[max(0, a) : max(0, b)] = kind + 1
        if what in (1, 2):
            piece, label = piece[: WIDTH - 40], label[: WIDTH - 40]  # room for what is put in
            for _ in range(int(rng.integers(1, 3))):
                kind = int(rng.integers(len(KINDS)))
                made = _variant(kind, rng)
                before, after = (("", ""), ("", ""), ("(", ")"), ("", ","), ("", "."), (": ", ""), ("<", ">"), ('"', '"'))[rng.integers(8)]
                gaps = [i for i, c in enumerate(piece) if c in " \n" and not label[i]]
                gaps += [len(piece)] * (1 + len(gaps) // 3)  # often the end
                g = gaps[rng.integers(len(gaps))]
                piece = piece[:g] + " " + before + made + after + piece[g:]
                label = np.concatenate([label[:g], np.zeros(1 + len(before)), np.full(len(made), kind + 1), np.zeros(len(after)), label[g:]]).astype(np.uint8)
        elif what == 3:
            made = _other(rng)
            gaps = [i for i, c in enumerate(piece) if c in " \n" and not label[i]] or [len(piece)]
            g = gaps[rng.integers(len(gaps))]
            piece = piece[:g] + " " + made + piece[g:]
            label = np.concatenate([label[:g], np.zeros(1 + len(made), np.uint8), label[g:]]).astype(np.uint8)
        got = classes(np.frombuffer(piece.encode("utf-8", "replace"), np.uint8))[:WIDTH]
        x[: len(got), w], y[: len(got), w] = got, label[: len(got)]
    return x, y


# --- whole texts ------------------------------------------------------------------------------------------

#: Windows read together.
BATCH = 2048
#: Characters that are read on either side of a needed one at first, and windows side by side from which on a row is read whole.
CONTEXT, FAR = 16, 16


def signs(data: np.ndarray) -> np.ndarray:
    """Bytes that a span of some kind must hold one of: digits, @, the word "dot", and "at" behind a bracket."""
    low = LOWER[data]
    out = ((data >= 48) & (data < 58)) | (data == 64)
    if len(data) < 4:
        return out
    letter = (low >= 97) & (low < 123)
    dot = (low[:-2] == 100) & (low[1:-1] == 111) & (low[2:] == 116)  # d, o, t
    dot[1:] &= ~letter[:-3]
    dot[:-1] &= ~letter[3:]
    at = (low[1:-1] == 97) & (low[2:] == 116) & np.isin(data[:-2], np.frombuffer(b"[({<", np.uint8))
    out[:-2] |= dot | at
    return out


def stretches(sign: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the characters within REACH of a sign in their row; ``sign`` has the signs' places, in order."""
    row = np.searchsorted(bounds, sign, "right") - 1
    low, high = np.maximum(sign - REACH, bounds[row]), np.minimum(sign + REACH + 1, bounds[row + 1])
    new = np.ones(len(sign), bool)
    new[1:] = (low[1:] > high[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], low[first], high[np.append(first[1:], len(sign)) - 1] if len(sign) else high


class Windows:
    """The windows over stretches of a line, and what has been read of them: the sums of their outputs, and weights."""

    def __init__(self, net: Net, line: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.net, self.line, self.start, self.sizes = net, line, start, end - start
        self.edge = np.concatenate([[0], np.cumsum(self.sizes)])
        self.total, self.weight = np.zeros((self.edge[-1], LABELS), np.float32), np.zeros(self.edge[-1], np.float32)
        self.windows = np.maximum(1, -(-(self.sizes - OVERLAP) // STRIDE))
        self.begin = np.cumsum(self.windows) - self.windows
        self.run = np.repeat(np.arange(len(self.sizes)), self.windows)
        self.number = np.arange(len(self.run)) - np.repeat(self.begin, self.windows)
        self.done = np.zeros(len(self.run), bool)

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of windows' characters among the stretches', time-major, and whether they are within their stretch."""
        spot = (self.number[which] * STRIDE)[None, :] + np.arange(WIDTH)[:, None]
        return self.edge[self.run[which]][None, :] + spot, spot < self.sizes[self.run[which]][None, :]

    def read(self, which: np.ndarray) -> None:
        """Add up the outputs of windows, each weighted by how deep a character stands in it."""
        inside = np.arange(WIDTH)[:, None]
        for odd in (0, 1):  # every other window of a stretch: these don't overlap
            mine = which[self.number[which] % 2 == odd]
            for k in range(0, len(mine), BATCH):
                part = mine[k : k + BATCH]
                r, n = self.run[part], self.number[part]
                spot, there = self.places(part)
                e, _ = self.net.emissions(np.where(there, self.line[np.minimum((self.start - self.edge[:-1])[r][None, :] + spot, len(self.line) - 1)], 0))
                left = np.where(n[None, :] > 0, inside + 1, WIDTH)
                right = np.where(n[None, :] + 1 < self.windows[r][None, :], WIDTH - inside, WIDTH)
                deep = np.minimum(np.minimum(left, right), OVERLAP).astype(np.float32)
                at = spot[there]
                self.total[at] += (e * deep[:, :, None])[there]
                self.weight[at] += deep[there]
        self.done[which] = True

    def outputs(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The mean of the windows that hold a character."""
        return self.total[at] / self.weight[at, None]

    def of(self, at: np.ndarray) -> np.ndarray:
        """The windows, one or two each, that hold the characters at these places."""
        r = np.searchsorted(self.edge, at, "right") - 1
        spot = at - self.edge[r]
        last, first = np.minimum(spot // STRIDE, self.windows[r] - 1), np.maximum((spot - WIDTH) // STRIDE + 1, 0)
        return np.unique(np.concatenate([self.begin[r] + first, self.begin[r] + last]))


def outputs(net: Net, line: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The network's outputs for the characters of the stretches, one after the other: the mean of the windows that hold a
    character, weighted by how deep it stands in each."""
    every = Windows(net, line, start, end)
    every.read(np.arange(len(every.run)))
    return every.outputs()


def labels_around(net: Net, line: np.ndarray, start: np.ndarray, end: np.ndarray, need: np.ndarray) -> np.ndarray:
    """``net.labels`` of the stretches' outputs, but 0 in the runs between two settled zeros in which no place of ``need``
    (in order) stands. Windows are read from those places outwards, until each run that holds one is closed by
    characters that are 0 whatever the network says beyond the windows read; so the labels are those of reading all."""
    some = Windows(net, line, start, end)
    edge, run, number = some.edge, some.run, some.number
    label, whole = np.zeros(edge[-1], np.uint8), np.zeros(len(some.sizes), bool)
    row = np.searchsorted(edge, need, "right") - 1
    new = some.of(np.concatenate([np.maximum(need - CONTEXT, edge[row]), np.minimum(need + CONTEXT, edge[row + 1] - 1)]))
    while len(new):
        some.read(new)
        done = np.flatnonzero(some.done & ~whole[run])
        cut = np.flatnonzero((np.diff(done) != 1) | (np.diff(run[done]) != 0)) + 1
        first, last = done[np.append(0, cut)], done[np.append(cut, len(done)) - 1]  # windows side by side
        fresh = np.searchsorted(new, first) < np.searchsorted(new, last, "right")
        far = fresh & (last - first >= FAR)
        whole[run[first[far]]] = True  # a row of many needed characters is read as a whole
        mine = fresh & ~whole[run[first]]
        first, last = first[mine], last[mine]
        if not len(first):
            break
        # The characters for which no window is missing.
        head, tail = number[first] == 0, number[last] + 1 == some.windows[run[last]]
        low = edge[run[first]] + np.where(head, 0, number[first] * STRIDE + OVERLAP)
        high = np.where(tail, edge[run[last] + 1], edge[run[last]] + (number[last] + 1) * STRIDE)
        bounds = np.concatenate([[0], np.cumsum(high - low)])
        at = np.arange(bounds[-1]) + np.repeat(low - bounds[:-1], high - low)
        path, zero = net.settled(some.outputs(at), bounds, head, tail)
        open_ = np.flatnonzero(~zero)
        group = np.searchsorted(bounds, open_, "right") - 1
        cut = np.flatnonzero((np.diff(open_) != 1) | (np.diff(group) != 0)) + 1
        a, b = np.append(0, cut)[: len(open_)], np.append(cut, len(open_))[: len(open_)] - 1
        held = np.searchsorted(need, at[open_[a]]) < np.searchsorted(need, at[open_[b]], "right")
        a, b = a[held], b[held]
        group = group[a]
        left = (open_[a] == bounds[group]) & ~head[group]
        right = (open_[b] + 1 == bounds[group + 1]) & ~tail[group]
        for i, j in zip(open_[a[~left & ~right]], open_[b[~left & ~right]] + 1, strict=True):
            label[at[i] : at[i] + j - i] = path[i:j]
        new = np.unique(np.concatenate([first[group[left]] - 1, last[group[right]] + 1]))
    if whole.any():
        some.read(np.flatnonzero(whole[run] & ~some.done))
        rows = np.flatnonzero(whole)
        bounds = np.concatenate([[0], np.cumsum(some.sizes[rows])])
        at = np.arange(bounds[-1]) + np.repeat(edge[rows] - bounds[:-1], some.sizes[rows])
        label[at] = net.labels(some.outputs(at), bounds)
    return label


def needed(data: np.ndarray) -> np.ndarray:
    """Bytes of which each span that ``plausible`` lets through holds one: digits, @, and the word "at"."""
    out = ((data >= 48) & (data < 58)) | (data == 64)
    if len(data) >= 4:
        low = LOWER[data]
        word = ((low >= 97) & (low < 123)) | out
        out[1:-2] |= (low[1:-2] == 97) & (low[2:-1] == 116) & ~word[:-3] & ~word[3:]
    return out


def tag(net: Net, data: np.ndarray, at: np.ndarray, need: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(row, kind, start, end) of runs of one label, over all rows of a flat buffer. With ``need``, which marks bytes, at
    least of those runs that hold such a byte."""
    lead = (data & 0xC0) != 0x80
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=place[1:])
    bounds = place[at]
    row = np.flatnonzero(np.diff(bounds))
    if not len(row):
        return []
    start, end = bounds[:-1][row], bounds[1:][row]
    edge = np.concatenate([[0], np.cumsum(end - start)])
    line = _CLASS[data[lead]]
    label = net.labels(outputs(net, line, start, end), edge) if need is None else labels_around(net, line, start, end, place[np.flatnonzero(need)])
    on = np.flatnonzero(label)
    if not len(on):
        return []
    of = np.searchsorted(edge, on, "right") - 1
    new = np.concatenate([[True], (np.diff(on) != 1) | (label[on[1:]] != label[on[:-1]]) | (of[1:] != of[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(on)) - 1
    shift = start[of] - edge[of] - bounds[row[of]]  # from the place among the stretches to the one in the row
    return [(int(row[of[a]]), int(label[on[a]]) - 1, int(on[a] + shift[a]), int(on[b] + shift[a]) + 1) for a, b in zip(first, last, strict=True)]


#: The signs of an address between letters or digits, as they are or spelled out.
_AT = re.compile(r"(?i)[a-z0-9]\s*(?:@|[\[({<]\s*(?:at|@)\s*[\])}>]|\sat\s)\s*[a-z0-9]")
_DOT = re.compile(r"(?i)[a-z0-9]\s*(?:\.|[\[({<]\s*(?:dot|\.)\s*[\])}>]|\sdot\s)\s*[a-z]{2}")


def plausible(kind: int, s: str) -> bool:
    """Whether an added span holds up as its kind, spelling aside."""
    digits = _digits(s)
    if kind == 0:
        return bool(_AT.search(s) and _DOT.search(s))
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", re.sub("(?i)dot", "", s))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(re.findall(r"[0-9]+", s)) >= 2 and bool(re.fullmatch(r"[0-9+()./\s-]+", s))


def added(text: str, found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for kind, a, b in found:
        while a < b and not (text[a].isalnum() or text[a] in "+(") or text[a:b].startswith("(") and text.count("(", a, b) > text.count(")", a, b):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if plausible(kind, text[a:b]) and not any(a < y and x < b for _, x, y in base):
            out.append((kind, a, b))
    return out


def _texts_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _finding(net: Net):
    digit = np.zeros(256, bool)
    digit[48:58] = digit[64] = True

    def run(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            columns: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added", "n_spans")}
            for i, j in steps(at):
                piece = data[at[i] : at[j]]
                bounds = at[i : j + 1] - at[i]
                found: dict[int, list] = {}
                for r, kind, a, b in tag(net, piece, bounds, needed(piece)):
                    found.setdefault(r, []).append((kind, a, b))
                marks = np.zeros(len(piece) + 1, np.int64)
                np.cumsum(digit[piece], out=marks[1:])
                some = marks[bounds[1:]] > marks[bounds[:-1]]
                for r in range(j - i):
                    base: list = []
                    more: list = []
                    if some[r] or r in found:  # every pattern has a digit or an @
                        text = piece[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8", "replace")
                        base = base_spans(text)
                        more = added(text, found.get(r, []), base)
                    for k, name in enumerate(KINDS):
                        columns["n_" + name].append(sum(s[0] == k for s in base))
                    columns["base"].append(_texts_of(base))
                    columns["spans"].append(_texts_of([*base, *more]))
                    columns["n_added"].append(len(more))
                    columns["n_spans"].append(len(base) + len(more))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.string() if k in ("base", "spans") else pa.int64()) for k, v in columns.items()})

    return run


def personal_data(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> DataFrame:
    """One row per document: (doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added, n_spans).

    Spans are kind:start:end in code points, end exclusive, by kind as listed, then start. The counts and
    ``base`` are of the fixed patterns; ``spans``, n_spans of them, has the network's n_added besides. Null text is
    empty and has none. Repeated rows get the same spans; null ids are kept. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = base.filter(F.col("text").isNotNull())
    rows = [*sampled(some, sample // 2), *sampled(some.filter(F.col("text").rlike("[0-9@]")), sample // 2)]
    net = Net()
    if rows:
        net.train(*labelled(sorted({r["text"] for r in rows}), windows))
    return in_arrow(base, _finding(net), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long, n_spans long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark, table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans")


QUERIES = {"op1_pii": op1_pii}
SQL: dict[str, str] = {}
