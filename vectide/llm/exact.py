"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text's fingerprint is its bytes as a polynomial modulo a prime. The text is cut into chunks whose hashes
are computed independently and joined by ``h(ab) = h(a) * r^len(b) + h(b)``, so a huge document needs no
state beyond one chunk, and its pieces are hashed by many tasks. Rows with equal length and fingerprint are
then compared chunk against chunk; where any differs, the group is cut by the digests of its whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import flat, forget, in_arrow, keep, steps, table

PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A2C4E687 % PRIME
#: Bytes of a hashed chunk; characters of a compared chunk.
CHUNK_BYTES = 1 << 16
CHUNK_CHARS = 1 << 15
#: Larger texts are hashed by several tasks.
HUGE_BYTES = 8 << 20


def power(length: int, prime: int = PRIME, base: int = BASE) -> int:
    """The shift that moves a fingerprint past ``length`` bytes."""
    return pow(base, length, prime)


def combine(left: tuple[int, int], right: tuple[int, int], prime: int = PRIME, base: int = BASE) -> tuple[int, int]:
    """(fingerprint, length) of two adjoining pieces from those of each; associative."""
    return (left[0] * power(right[1], prime, base) + right[0]) % prime, left[1] + right[1]


_LIMB = np.uint64(31)
_LOW = np.uint64((1 << 31) - 1)
_M61 = np.uint64(PRIME)


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, both below it, in 64-bit limbs."""
    ah, al, bh, bl = a >> _LIMB, a & _LOW, b >> _LIMB, b & _LOW
    mid = ah * bl + al * bh
    out = np.uint64(2) * ah * bh + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << _LIMB) + al * bl
    out = (out & _M61) + (out >> np.uint64(61))
    return np.where(out >= _M61, out - _M61, out)


def _table(size: int) -> np.ndarray:
    """base^0 .. base^(size-1) modulo 2^61 - 1, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, _mul(out, np.full(len(out), power(len(out)), np.uint64))])
    return out[:size]


_POWERS = _table(CHUNK_BYTES)


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Fingerprints of byte ranges of at most CHUNK_BYTES each; a byte b counts as b + 1."""
    if not len(starts):
        return []
    sizes = ends - starts
    base = int(starts[0])
    piece = data[base : int(ends[-1])].astype(np.uint64) + np.uint64(1)
    place = np.repeat(ends - base, sizes) - 1 - np.arange(len(piece))
    low = (_POWERS[place] & _LOW) * piece  # in two limbs, so that a step's sum fits 64 bits
    high = (_POWERS[place] >> _LIMB) * piece
    edges = np.zeros(len(piece) + 1, np.uint64)
    out = []
    sums = []
    for part in (low, high):
        np.cumsum(part, out=edges[1:])
        sums.append(edges[ends - base] - edges[starts - base])
    for lo, hi in zip(sums[0].tolist(), sums[1].tolist(), strict=True):
        out.append((lo + (hi << 31)) % PRIME)
    return out


def fingerprints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of a flat text buffer."""
    out = np.zeros(len(at) - 1, np.int64)
    for i, j in steps(at):
        rows = range(i, j)
        if j == i + 1 and at[j] - at[i] > CHUNK_BYTES:
            total = (0, 0)
            for start in range(int(at[i]), int(at[j]), CHUNK_BYTES):
                end = min(start + CHUNK_BYTES, int(at[j]))
                total = combine(total, (chunk_hashes(data, np.array([start]), np.array([end]))[0], end - start))
            out[i] = total[0]
            continue
        starts, ends, owner = [], [], []
        for k in rows:
            for start in range(int(at[k]), int(at[k + 1]), CHUNK_BYTES):
                starts.append(start)
                ends.append(min(start + CHUNK_BYTES, int(at[k + 1])))
                owner.append(k)
        if not starts:
            continue
        found = chunk_hashes(data, np.array(starts), np.array(ends))
        so_far: dict[int, tuple[int, int]] = {}
        for k, h, a, b in zip(owner, found, starts, ends, strict=True):
            so_far[k] = combine(so_far[k], (h, b - a)) if k in so_far else (h, b - a)
        for k, (h, _) in so_far.items():
            out[k] = h
    return out


def _fingerprint_batches(modulus: int, names: list[str]):
    """``names`` of the batch, which has ``text``, with its fingerprint and bytes."""

    def run(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            prints = fingerprints(data, at) % modulus
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(prints, pa.int64()), pa.array(np.diff(at), pa.int64())], [*names, "fp", "n_bytes"])

    return run


def _combined(modulus: int):
    """One row of a document's piece fingerprints, in order."""

    def run(batches):
        for batch in batches:
            whole = []
            for pieces in batch.column("pieces").to_pylist():
                total = (0, 0)
                for p in pieces:
                    total = combine(total, (p["fp"], p["n_bytes"]))
                whole.append(total)
            prints, sizes = [f % modulus for f, _ in whole], [n for _, n in whole]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_sha256"), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), batch.column("copies")], ["doc_id", "text_sha256", "fp", "n_bytes", "copies"])

    return run


def _pieces(text: Column, chars: int) -> Column:
    """The text cut every ``chars`` characters: an array of (part, piece); an empty text is one piece."""
    last = F.floor(F.greatest(F.lit(0), F.length(text) - 1) / chars).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("part"), F.substring(text, i * chars + 1, F.lit(chars)).alias("text")))


def _marked(base: DataFrame, modulus: int, huge: int) -> DataFrame:
    """(doc_id, text_sha256, fp, n_bytes) of each row. Texts of more than ``huge`` bytes are cut in pieces that are dealt
    to all tasks and hashed there; a piece's fingerprint is exact whatever the modulus, which folds the whole one."""
    size = F.octet_length("text")
    rows = base.withColumn("text_sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    small = in_arrow(rows.filter(size <= huge), _fingerprint_batches(modulus, ["doc_id", "text_sha256"]), "doc_id long, text_sha256 string, fp long, n_bytes long")
    cut = rows.filter(size > huge).select("doc_id", "text_sha256", F.inline(_pieces(F.col("text"), max(1, huge // 4))))
    # Rows that repeat id and text give each piece several times; their count comes back at the end.
    dealt = cut.repartition("doc_id", "text_sha256", "part")
    hashed = in_arrow(dealt, _fingerprint_batches(PRIME, ["doc_id", "text_sha256", "part"]), "doc_id long, text_sha256 string, part int, fp long, n_bytes long")
    once = hashed.groupBy("doc_id", "text_sha256", "part", "fp", "n_bytes").agg(F.count("*").alias("copies"))
    gathered = once.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("part", "fp", "n_bytes"))).alias("pieces"), F.max("copies").alias("copies"))
    large = in_arrow(gathered, _combined(modulus), "doc_id long, text_sha256 string, fp long, n_bytes long, copies long")
    each = large.select("doc_id", "text_sha256", "fp", "n_bytes", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return small.unionByName(each)


def exact_duplicates(spark: SparkSession, docs: DataFrame, modulus: int = PRIME, huge: int = HUGE_BYTES) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Null text counts as empty, and all empty texts are one group. Of equal texts the largest doc_id stays;
    rows that repeat a doc_id count each in group_size. A null doc_id never stays unless its whole group has
    none. An empty table gives no rows. Other columns are not looked at. ``modulus`` folds fingerprints to
    fewer values, ``huge`` is the size from which a text is hashed in parallel; results depend on neither.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = keep(spark, _marked(base, modulus, huge), "fingerprints")
    groups = marked.groupBy("fp", "n_bytes").agg(F.count("*").alias("size"))
    several = keep(spark, groups.filter("size > 1").drop("size"), "groups")
    # Equal fingerprints are compared chunk by chunk: a group's chunk is one text if its least and greatest are. Tasks
    # send on one pair a chunk, however many copies they read, so no task holds two whole texts or a whole group.
    printed = in_arrow(base, _fingerprint_batches(modulus, ["text"]), "text string, fp long, n_bytes long")
    chunks = printed.join(several, ["fp", "n_bytes"], "left_semi").select("fp", "n_bytes", F.inline(_pieces(F.col("text"), CHUNK_CHARS)))
    spread = chunks.groupBy("fp", "n_bytes", "part").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    odd = keep(spark, spread.filter("least <> most").select("fp", "n_bytes", F.lit(True).alias("odd")).distinct(), "collisions")
    # A group in which any chunk differs is cut by the digests of its whole texts.
    cut_by = marked.join(odd, ["fp", "n_bytes"], "left").withColumn("own", F.when(F.col("odd"), F.col("text_sha256")).otherwise("")).drop("odd")
    # Written first, so that both sides of the join are plain shuffles, of which Spark splits a large group's.
    final = keep(spark, cut_by.groupBy("fp", "n_bytes", "own").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "final")
    forget(several)
    return cut_by.join(final, ["fp", "n_bytes", "own"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents"))


SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g USING (text)"""
}
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
