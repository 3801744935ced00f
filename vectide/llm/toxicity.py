"""Toxicity scoring by a subsequence-kernel support vector machine with Nyström landmarks.

A sentence is read as segments: its space-cut words without signs, and runs of very short words joined, so
that spelled-out words come together. Two segments are as alike as their common three-letter subsequences,
each discounted by the span it takes, so inserted letters weaken a match and don't break it. The kernel to
landmarks (segments of labelled sentences), whitened, is the feature space of a linear support vector machine,
which is trained on sentences: a sentence stands by its segment of highest margin, and which sentences of a
toxic text are toxic is learnt with the machine. Its decision is a weight for each three-letter subsequence,
which is how segments are scored: exactly the landmark sum, without visiting landmarks. A document's score is
calibrated from its two highest margins and the number of positive ones.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import LOWER, SPACED, flat, in_arrow, sampled, span_hashes, steps, table, words
from vectide.llm.language import fold

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
#: Labelled rows that the classifier is fitted on, by the digest of doc_id; SAMPLE_CHARS bounds a row's text.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
LANDMARKS = 320
#: Rounds of training and choosing sentences; a toxic row's sentences in one; the clean sentences nearest to toxic ones, and as many drawn.
ROUNDS, SENTENCES, NEGATIVES = 4, 4, 4000
DECAY = 0.7
LETTERS = 40
#: Longer segments are read in windows of WIDEST letters, each half over the last.
WIDEST = 17
#: Cached margins of a task.
CACHE = 1 << 20
FLOOR = -3.0

_DROP = 255
CODE = np.full(256, _DROP, np.uint8)
CODE[97:123] = np.arange(26)
CODE[48:58] = 26
CODE[128:] = 27 + np.arange(128) % 12
#: The letter that every segment begins with, so that a word's beginning is unlike the same letters within one.
EDGE = 39


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends, row): segments, EDGE and three letters or more, over a buffer of letter codes; longer ones than
    WIDEST in pieces, of which the first has the EDGE."""
    code = CODE[LOWER[data]]
    kept = code != _DROP
    shift = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=shift[1:])
    starts, ends, row = words(data, at)
    starts, ends = shift[starts], shift[ends]
    real = ends > starts
    starts, ends, row = starts[real], ends[real], row[real]
    size = ends - starts
    short = size <= 2
    # Runs of three or more short words in a row stand next to each other among the codes.
    first = short & np.concatenate([[True], ~short[:-1] | (row[1:] != row[:-1])])[: len(short)]
    last = short & np.concatenate([~short[1:] | (row[1:] != row[:-1]), [True]])[-len(short) :] if len(short) else short
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    run = b - a >= 2
    starts = np.concatenate([starts[size >= 3], starts[a[run]]])
    ends = np.concatenate([ends[size >= 3], ends[b[run]]])
    row = np.concatenate([row[size >= 3], row[a[run]]])
    ok = ends - starts >= 3
    order = np.flatnonzero(ok)[np.argsort(starts[ok], kind="stable")]
    starts, ends, row = starts[order], ends[order], row[order]
    letters = np.insert(code[kept], starts, EDGE)
    starts, ends = starts + np.arange(len(starts)), ends + np.arange(len(starts)) + 1
    wide = ends - starts > WIDEST
    if wide.any():
        half = WIDEST // 2
        pieces = -(-(ends[wide] - starts[wide] - WIDEST) // half) + 1
        base = np.repeat(starts[wide], pieces)
        step = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop = np.repeat(ends[wide], pieces)
        e = np.minimum(base + step * half + WIDEST, stop)
        starts = np.concatenate([starts[~wide], e - WIDEST])
        ends = np.concatenate([ends[~wide], e])
        row = np.concatenate([row[~wide], np.repeat(row[wide], pieces)])
    return letters, starts, ends, row


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _TRIPLES:
        t = np.array(list(combinations(range(size), 3)))
        _TRIPLES[size] = t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)
    return _TRIPLES[size]


def self_kernel(mat: np.ndarray) -> np.ndarray:
    """K3(s, s) of each row of letter codes, by the usual recursion over both ends."""
    rows, size = mat.shape
    same = (mat[:, :, None] == mat[:, None, :]).astype(np.float32)
    prior = np.ones((rows, size + 1, size + 1), np.float32)
    lam = np.float32(DECAY)
    for _ in range(2):
        new = np.zeros_like(prior)
        for i in range(size):
            run = np.zeros(rows, np.float32)
            for j in range(size):
                run = lam * run + lam * lam * same[:, i, j] * prior[:, i, j]
                new[:, i + 1, j + 1] = lam * new[:, i, j + 1] + run
        prior = new
    return lam * lam * (same * prior[:, :-1, :-1]).sum((1, 2))


def norms(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The length of each segment's subsequence features."""
    out = np.zeros(len(starts), np.float32)
    for size in np.unique(ends - starts):
        rows = np.flatnonzero(ends - starts == size)
        most = max(1, 500_000 // int(size) ** 2)
        for k in range(0, len(rows), most):
            part = rows[k : k + most]
            out[part] = np.sqrt(np.maximum(self_kernel(codes[starts[part][:, None] + np.arange(size)]), 1e-12))
    return out


def project(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, norm: np.ndarray | None = None, rows_of: np.ndarray | None = None) -> np.ndarray:
    """The normalised subsequence features of each segment times ``weights`` (LETTERS^3, columns), or times fewer rows, of
    which ``rows_of`` names each subsequence's."""
    norm = norms(codes, starts, ends) if norm is None else norm
    out = np.zeros((len(starts), weights.shape[1]), np.float32)
    for size in np.unique(ends - starts):
        t, decay = _triples(int(size))
        rows = np.flatnonzero(ends - starts == size)
        most = max(1, 2_000_000 // (len(t) * weights.shape[1]))
        for k in range(0, len(rows), most):
            part = rows[k : k + most]
            mat = codes[starts[part][:, None] + np.arange(size)].astype(np.int64)
            index = (mat[:, t[:, 0]] * LETTERS + mat[:, t[:, 1]]) * LETTERS + mat[:, t[:, 2]]
            index = index if rows_of is None else rows_of[index]
            if weights.shape[1] == 1:
                out[part, 0] = (weights[:, 0][index] @ decay) / norm[part]
            else:
                out[part] = np.einsum("btm,t->bm", weights[index], decay) / norm[part][:, None]
    return out


def _explicit(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows_of, basis): unit subsequence vectors of the landmarks, a column each, over the subsequences that they have; the
    last row is all others'."""
    parts = []
    for s in names:
        t, decay = _triples(len(s))
        x = s.astype(np.int64)
        parts.append(((x[t[:, 0]] * LETTERS + x[t[:, 1]]) * LETTERS + x[t[:, 2]], decay))
    held = np.unique(np.concatenate([i for i, _ in parts]))
    rows_of = np.full(LETTERS**3, len(held), np.int32)
    rows_of[held] = np.arange(len(held))
    out = np.zeros((len(held) + 1, len(names)), np.float32)
    for m, (index, decay) in enumerate(parts):
        np.add.at(out[:, m], rows_of[index], decay)
        out[:, m] /= np.linalg.norm(out[:, m]) or 1
    return rows_of, out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng, lam: float = 1e-4, passes: int = 30) -> np.ndarray:
    """A linear support vector machine with a bias column, by averaged subgradient steps on batches."""
    x = np.column_stack([x, np.ones(len(x))])
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    step, batch = 0, 256
    for p in range(passes):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            step += 1
            part = order[k : k + batch]
            wrong = y[part] * (x[part] @ w) < 1
            g = lam * w - ((weight[part] * y[part] * wrong) @ x[part]) / len(part)
            w = w - g * (4.0 / np.sqrt(step))
            if p >= passes // 2:
                mean += w
    return mean / max(1, step - (passes // 2) * -(-len(x) // batch))


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def sentences(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The offsets at which the sentences of all rows begin, and the end: rows begin one, and so does what follows a line
    break or a full stop, exclamation or question mark before white space."""
    stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
    stop[:-1] &= ~SPACED[data[1:]]
    stop |= data == 10
    return np.unique(np.concatenate([at, np.flatnonzero(stop) + 1]))


def _by_row(margin: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """What calibration looks at: each row's highest margin, its second highest, and how many are positive."""
    order = np.lexsort((-margin, row))
    ranked, of = margin[order], row[order]
    first = np.searchsorted(of, np.arange(rows))
    size = np.bincount(of, minlength=rows)
    top = [np.where(size > k, ranked[np.minimum(first + k, max(0, len(ranked) - 1))], FLOOR) if len(ranked) else np.full(rows, FLOOR) for k in (0, 1)]
    return np.column_stack([*(np.clip(t, FLOOR, -FLOOR) for t in top), np.log1p(np.bincount(row[margin > 0], minlength=rows))])


class Sample:
    """Labelled texts as sentences and their distinct segments."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        data, at = flat(pa.array(texts, pa.large_string()))
        parts, base, begun = [], 0, 0
        short = lambda x: x.astype(np.int32)
        for i, j in steps(at):  # tables of powers stay as small as a step
            piece, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
            cut = sentences(piece, bounds)
            codes, starts, ends, row = segments(piece, cut)
            doc = np.searchsorted(bounds, cut[:-1], "right") - 1 + i
            keys = span_hashes(codes, starts, ends)
            parts.append((codes, short(starts + base), short(ends + base), short(row + begun), keys, short(doc)))
            base, begun = base + len(codes), begun + len(doc)
        self.codes, starts, ends, sentence, keys, self.doc_of = (np.concatenate([p[k] for p in parts]) for k in range(6))
        del parts
        _, where, which = np.unique(keys, return_index=True, return_inverse=True)
        del keys
        self.starts, self.ends = starts[where], ends[where]
        self.norm = norms(self.codes, self.starts, self.ends)
        pairs = np.unique(sentence.astype(np.int64) * len(where) + which)  # a sentence's distinct segments
        self.sentence, self.segment = (pairs // len(where)).astype(np.int32), (pairs % len(where)).astype(np.int32)
        self.toxic, self.rows = toxic, len(texts)

    def text(self, segment: int) -> np.ndarray:
        return self.codes[self.starts[segment] : self.ends[segment]]

    def projected(self, which: np.ndarray, weights: np.ndarray, rows_of: np.ndarray | None = None) -> np.ndarray:
        return project(self.codes, self.starts[which], self.ends[which], weights, self.norm[which], rows_of)

    def telling(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's segment of highest margin: (sentences, segments)."""
        order = np.lexsort((-margin[self.segment], self.sentence))
        first = np.concatenate([[True], np.diff(self.sentence[order]) != 0])
        return self.sentence[order][first], self.segment[order][first]

    def odds(self) -> np.ndarray:
        """How much likelier a segment is in a toxic row than in a clean one, in logarithms, counting each row once."""
        doc = self.doc_of[self.sentence]
        pairs = np.unique(doc.astype(np.int64) * len(self.starts) + self.segment)
        doc, seg = pairs // len(self.starts), pairs % len(self.starts)
        n = [np.bincount(seg[self.toxic[doc] == k], minlength=len(self.starts)) for k in (0, 1)]
        rows = [max(1, int((self.toxic == k).sum())) for k in (0, 1)]
        return np.log((n[1] + 0.5) / (rows[1] + 1)) - np.log((n[0] + 0.5) / (rows[0] + 1))


def _examples(sample: Sample, margin: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """(segments, labels) that stand for labelled sentences: of a toxic row the sentence of highest margin, and its next ones
    while their margins are positive; of the clean rows the sentences of highest margins and a draw of all."""
    sentence, segment = sample.telling(margin)
    doc = sample.doc_of[sentence]
    order = np.lexsort((-margin[segment], doc))
    sentence, segment, doc = sentence[order], segment[order], doc[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    bad = sample.toxic[doc] == 1
    pos = bad & ((rank == 0) | ((rank < SENTENCES) & (margin[segment] > 0)))
    clean = np.flatnonzero(~bad)
    hard = clean[np.argsort(-margin[segment[clean]], kind="stable")[:NEGATIVES]]
    neg = np.unique(np.concatenate([hard, rng.permutation(clean)[:NEGATIVES]])).astype(int)
    return np.concatenate([segment[pos], segment[neg]]), np.concatenate([np.ones(int(pos.sum())), -np.ones(len(neg))])


def fit(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, seed: int = 11):
    """(weights of subsequences, bias, calibration) from labelled texts.

    Only whole texts are labelled, so which sentences of a toxic one are toxic is learnt with the machine: a first guess
    by odds, then rounds in which the machine is trained on labelled sentences and chooses them anew.
    """
    rng = np.random.default_rng(seed)
    sample = Sample(texts, toxic)
    n_bad, n_good = int((toxic == 1).sum()), int((toxic == 0).sum())
    if not n_bad or not n_good or not len(sample.starts):
        return np.zeros((LETTERS**3, 1), np.float32), FLOOR, np.array([0.0, 0.0, 0.0, np.log((n_bad + 0.5) / (n_good + 0.5))])
    margin = sample.odds()
    every = np.arange(len(sample.starts))
    for _ in range(ROUNDS):
        which, y = _examples(sample, margin, rng)
        # Landmarks: what stands for most toxic sentences, what is likest to it in clean ones, and a draw.
        seen, n = np.unique(which[y > 0], return_counts=True)
        lead = seen[np.argsort(-n, kind="stable")][: landmarks // 2]
        rest = np.setdiff1d(which[y < 0], lead)
        hard = rest[np.argsort(-margin[rest], kind="stable")][: (landmarks - len(lead)) // 2]
        draw = rng.permutation(np.setdiff1d(rest, hard))[: landmarks - len(lead) - len(hard)]
        rows_of, basis = _explicit([sample.text(k) for k in (*lead, *hard, *draw)])
        gram = sum(part.T @ part for part in (basis[k : k + 4096].astype(float) for k in range(0, len(basis), 4096)))
        value, vector = np.linalg.eigh(gram)
        white = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
        # Each example as it is, and the toxic ones with letters put in besides.
        noisy = [np.insert(t, rng.integers(1, len(t), 1 + k % 2), rng.integers(0, 26, 1 + k % 2))[:WIDEST].astype(t.dtype) for k, t in enumerate(sample.text(i) for i in which[y > 0])]
        edge = np.concatenate([[0], np.cumsum([len(s) for s in noisy])]).astype(int)
        x = np.concatenate([sample.projected(which, basis, rows_of), project(np.concatenate(noisy), edge[:-1], edge[1:], basis, None, rows_of)]) @ white
        target = np.concatenate([y, np.ones(len(noisy))])
        weight = np.where(target > 0, len(target) / (2 * (target > 0).sum()), len(target) / (2 * max(1, (target < 0).sum())))
        w = _svm(x, target, weight, rng)
        primal = (basis @ (white @ w[:-1])).astype(np.float32)[rows_of][:, None]
        margin = sample.projected(every, primal)[:, 0] + w[-1]
    doc = sample.doc_of[sample.sentence]
    return primal, float(w[-1]), _calibrate(_by_row(margin[sample.segment], doc, sample.rows), toxic)


def _score(primal, bias, calibration):
    def run(batches):
        known, value = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for batch in batches:
            with np.errstate(over="ignore"):
                data, at = flat(batch.column("text"))
                out = np.zeros(len(batch))
                for i, j in steps(at):
                    codes, starts, ends, row = segments(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    keys, where, which = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
                    spot = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                    new = known[spot] != keys if len(known) else np.ones(len(keys), bool)
                    got = np.zeros(len(keys), np.float32)
                    got[~new] = value[spot[~new]] if len(known) else 0
                    got[new] = project(codes, starts[where[new]], ends[where[new]], primal)[:, 0] + bias
                    if len(known) > CACHE:
                        known, value = keys, got
                    else:
                        merged = np.concatenate([known, keys[new]])
                        order = np.argsort(merged)
                        known, value = merged[order], np.concatenate([value, got[new]])[order]
                    x = _by_row(got[which], row, j - i) @ calibration[:-1] + calibration[-1]
                    out[i:j] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN), threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted).

    Learns from labelled rows outside the held-out fold, at most ``sample`` of each class; a null label or text
    is no example, and an id that is labelled both ways is a toxic one. Words of one or two letters are read where three
    or more stand in a row, and not otherwise. Null, empty and wordless texts get the score of a text without segments. Repeated rows get
    the same score. Without examples all scores are alike. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), folds) == held).alias("held_out"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter((fold(F.col("doc_id"), folds) != held) & F.col("doc_id").isNotNull())
    known: dict[int, int] = {}
    for value, most in zip((1, 0), sample, strict=True):
        for r in marks.filter(F.col("toxic") == value).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect():
            known.setdefault(r["doc_id"], value)
    rows = sampled(base.filter(F.col("doc_id").isin(list(known)) & F.col("text").isNotNull()).select("doc_id", "text"), sum(sample)) if known else []
    nothing = np.zeros((LETTERS**3, 1), np.float32), FLOOR, np.zeros(4)
    marks_of = np.array([known[r["doc_id"]] for r in rows])
    rows = [r["text"] for r in rows]
    primal, bias, calibration = fit(rows, marks_of) if rows else nothing
    scored = in_arrow(base.select("doc_id", "held_out", "text"), _score(primal, bias, calibration), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
