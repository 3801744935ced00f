"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (code points; runs across word edges see them as spaces) are hashed to a
fixed number of buckets. Document frequencies come from all learning documents; the weights from a bounded
sample, by follow-the-regularised-leader with an elastic-net penalty, whose L1 part leaves most buckets at
zero. A temperature fitted on a slice that the weights didn't see turns scores to probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import flat, in_arrow, sampled, steps, table

#: Hash buckets of n-grams.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: The weights are fitted on at most so many distinct rows of each language, taken by the digest of the row, and on so many
#: languages, the most frequent ones; SAMPLE_CHARS bounds a row's text.
SAMPLE = 600
LANGS = 512
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
FOLDS, HELD = 5, 0
UNKNOWN = "und"


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(1))


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a flat UTF-8 buffer, and each row's offset into them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    out = data[lead].astype(np.uint32)
    more = np.flatnonzero(out >= 0x80)
    if len(more):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        first, spot = out[more], lead[more]
        low = [(padded[spot + k] & 0x3F).astype(np.uint32) for k in (1, 2, 3)]
        two = (first & 0x1F) << 6 | low[0]
        three = (first & 0x0F) << 12 | low[0] << 6 | low[1]
        four = (first & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2]
        out[more] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return out, np.searchsorted(lead, at)


_PLAIN = np.array([c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)], np.uint32)


def counts(data: np.ndarray, at: np.ndarray):
    """The (buckets, counts) of each row's n-grams of characters; letters A-Z in lower case, digits and signs as spaces."""
    for i, j in steps(at):
        piece, bounds = characters(data[at[i] : at[j]], at[i : j + 1] - at[i])
        ascii_ = piece < 128
        piece[ascii_] = _PLAIN[piece[ascii_]]
        keys, code = [], np.zeros(len(piece), np.uint32)
        for k in range(max(ORDERS)):
            code = code * np.uint32(0x01000193)
            code[: len(piece) - k] += piece[k:] + np.uint32(1)
            h = (code ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            keys.append(((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(16) & np.uint32(BUCKETS - 1)).astype(np.int64))
        for r in range(j - i):
            a, b = int(bounds[r]), int(bounds[r + 1])
            out = np.bincount(np.concatenate([keys[k][a : max(a, b - k)] for k in range(max(ORDERS))]), minlength=BUCKETS)
            on = np.flatnonzero(out)
            yield on, out[on]


def _frequencies(batches):
    seen, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        data, at = flat(batch.column("text"))
        for on, _ in counts(data, at):
            seen[on] += 1
            rows += 1
    yield pa.RecordBatch.from_arrays([pa.array([seen.tolist()], pa.list_(pa.int64())), pa.array([rows], pa.int64())], ["seen", "rows"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The smoothed IDF of each bucket over all of ``docs``; summed by bucket, so its size is fixed."""
    part = in_arrow(docs.select("text"), _frequencies, "seen array<long>, rows long")
    got = part.select(F.posexplode(F.concat("seen", F.array("rows"))).alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1)
    for bucket, n in got:
        out[bucket] = n
    return np.log((1 + out[-1]) / (1 + out[:-1])) + 1


def _unit(on: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The row's TF-IDF values at its buckets, at unit length."""
    x = np.log1p(count) * idf[on]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def fit(rows: list[tuple[str, str]], idf: np.ndarray, seed: int = 7):
    """(languages, weights, temperature) from (text, lang) rows; every fifth row sets the temperature only."""
    langs = sorted({lang for _, lang in rows})
    column = pa.array([t for t, _ in rows], pa.large_string())
    x = [(on, _unit(on, c, idf)) for on, c in counts(*flat(column))]
    y = np.array([langs.index(lang) for _, lang in rows])
    tune = np.arange(len(y)) % 5 == 4
    if tune.all() or not tune.any():
        tune = np.zeros(len(y), bool)
    learn = np.flatnonzero(~tune)
    rng = np.random.default_rng(seed)
    z, n = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), BUCKETS))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in rng.permutation(learn):
            on, value = x[k]
            w = weights(z[:, on], n[:, on])
            s = w @ value
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = p[:, None] * value[None, :]
            step = (np.sqrt(n[:, on] + g * g) - np.sqrt(n[:, on])) / ALPHA
            z[:, on] += g - step * w
            n[:, on] += g * g
    w = weights(z, n)
    best = (np.inf, 1.0)
    held = np.flatnonzero(tune) if tune.any() else learn
    s = np.stack([w[:, x[k][0]] @ x[k][1] for k in held])
    for t in np.exp(np.linspace(np.log(0.05), np.log(4), 60)):
        q = s / t
        q = q - q.max(1, keepdims=True)
        loss = -(q[np.arange(len(held)), y[held]] - np.log(np.exp(q).sum(1))).mean()
        best = min(best, (loss, float(t)))
    return langs, w.astype(np.float32), best[1]


def _predictions(model, column) -> tuple[list[str], np.ndarray]:
    """The language and score of each text of an Arrow column."""
    langs, w, idf, temperature = model
    if not langs or not len(column):
        return [UNKNOWN] * len(column), np.zeros(len(column))
    s = np.stack([w[:, on] @ _unit(on, c, idf) for on, c in counts(*flat(column))]) / temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top = p.argmax(1)
    lettered = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False))
    return [langs[k] if ok else UNKNOWN for k, ok in zip(top, lettered, strict=True)], np.where(lettered, p[np.arange(len(top)), top], 0.0)


def _predict(model):
    def run(batches):
        for batch in batches:
            pred, score = _predictions(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _accept(model, least):
    def run(batches):
        for batch in batches:
            pred, score = _predictions(model, batch.column("text").cast(pa.string()))
            yield batch.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return run


def learn(docs: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE):
    """(languages, weights, IDF, temperature) from text and non-null lang of rows outside the held-out fold."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64(*known.columns)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    if not total:
        return [], np.zeros((1, BUCKETS), np.float32), np.ones(BUCKETS, np.float32), 1.0
    by: dict[str, list] = {}
    for r in sampled(known, sample, "lang", {r["lang"]: r["n"] for r in total}):
        by.setdefault(r["lang"], []).append((r["text"], r["lang"]))
    idf = inverse_frequencies(known).astype(np.float32)
    mixed = [row for group in zip(*(v * -(-sample // len(v)) for v in by.values()), strict=False) for row in group]
    langs, w, temperature = fit(mixed, idf)
    return langs, w, idf, temperature


def identify(spark: SparkSession, docs: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score).

    Learns from text and non-null lang of rows outside the held-out fold; lang, source and doc_id are no
    inputs of a prediction. Null text, and text without a letter, is "und" with score 0, as is everything where
    nothing can be learnt. Repeated rows get the same answer. An empty table gives no rows.
    """
    model = learn(docs, folds, held, sample)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_arrow(base, _predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(spark: SparkSession, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The input rows, all columns, whose language is a learnt one with a score of ``least`` or more."""
    return in_arrow(docs, _accept(learn(docs), least), docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
