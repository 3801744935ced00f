"""Shared pieces: tables kept in the cluster's shared folder, and numpy kernels over Arrow text buffers."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.plans.ship import ship
from vectide.plans.store import forget, keep, shared_dir

__all__ = ["flat", "forget", "in_arrow", "keep", "mix", "sampled", "shared_dir", "shrink_heaps", "span_hashes", "steps", "table", "words"]

#: Bytes of text that one numpy step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; ``sf_dir`` may be any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers each that are broadcast, so that the texts they meet aren't shuffled; more are joined by shuffles.
BROADCAST_ROWS = 500_000


def near_texts(kept: DataFrame) -> DataFrame:
    """A kept table of narrow rows, to be broadcast if its rows are few enough, counted."""
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


#: Characters of a text that a classifier's sample holds; of longer ones a stretch that the digest places.
SAMPLE_CHARS = 1 << 14


def sampled(rows: DataFrame, most: int, by: str | None = None, many: dict | None = None) -> list:
    """At most ``most`` distinct rows of ``rows`` (which has ``text``), or of each value of ``by``: those of least digest,
    sorted by it. What the driver gets is bounded by ``most`` times SAMPLE_CHARS, however often a row is repeated. With
    ``by``, ``many`` says about how many distinct rows each value has, and names the values that count: rows whose digest
    is too high for their value's sample go before the values' rows meet."""
    marked = rows.withColumn("_digest", F.xxhash64(*rows.columns))
    if by:
        ceiling = F.create_map(*(F.lit(x) for value, n in many.items() for x in (value, min(1 << 30, int((2 * most + 50) / max(1, n) * (1 << 30))))))
        narrow = marked.filter(F.pmod("_digest", F.lit(1 << 30)) < F.element_at(ceiling, F.col(by))).select(by, "_digest").distinct()
        first = Window.partitionBy(by).orderBy(F.pmod("_digest", F.lit(1 << 30)), "_digest")
        narrow = narrow.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most)
    else:
        narrow = marked.select("_digest").distinct().orderBy("_digest").limit(most)
    start = F.pmod("_digest", F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    # At most ``most`` digests, or so many a value of ``by``, whose number the caller bounds.
    cut = marked.join(F.broadcast(narrow.select("_digest")), "_digest", "left_semi").withColumn("text", F.substring(F.col("text"), start.cast("int"), F.lit(SAMPLE_CHARS)))
    return sorted(cut.dropDuplicates(["_digest"]).collect(), key=lambda r: r["_digest"])


def release() -> None:
    """Give the memory that this process freed back to the system: workers wait for their next task with what they hold,
    beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Have each executor collect its garbage, so that its heap gives unused memory back to the system: a heap that grew to
    its limit stays there, beside what later work takes outside of it. One task an executor, as they are dealt out in turn
    when all are idle; where a task misses an executor, that one's heap stays as it is."""
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # without the driver
    spark.range(0, executors, 1, executors).selectExpr("java_method('java.lang.System', 'gc')").collect()


def _released(kernel):
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def in_arrow(df: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` over the Arrow batches of ``df``, with this package at hand in the workers, which release its memory."""
    ship(df.sparkSession)
    return df.mapInArrow(_released(kernel), schema)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offset into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def steps(at: np.ndarray, most: int = STEP_BYTES):
    """Ranges of rows with at most ``most`` bytes together, or a single longer row."""
    i, rows = 0, len(at) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, rows)
        i = min(j, rows)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words cut at white space: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` bytes; runs end at row ends."""
    hit = inside[data]
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1]
    last[:-1] &= ~hit[1:]
    edges = at[:-1]
    edges = edges[edges < len(data)]
    first[edges] = hit[edges]
    edges = at[1:] - 1
    edges = edges[edges >= 0]
    last[edges] = hit[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size + 1, _BASE, np.uint64)
    down = np.full(size + 1, pow(int(_BASE), -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, alike wherever the range stands."""
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts])
