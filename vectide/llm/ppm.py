"""Language-model scoring by prediction with partial matching over a byte-context trie.

A byte is predicted from the longest known context of up to four bytes; where the context hasn't seen it, an
escape (as likely as the context's distinct successors against all it has seen) leads to the next shorter
context, from whose counts all symbols of the longer one are excluded. Below the empty context every byte not
yet excluded is equally likely, so the probabilities of all texts add up to one. ``Trie`` is the plain form,
adaptive or trained; ``Model`` holds the same counts as sorted arrays and scores whole batches.

The corpus is dealt into blocks of nearly equal size, at random. A block counts its distinct words and five-byte grams
once; counts meet in buckets of hashed keys and return to the blocks that asked, so neither a document's
words nor a hot word ever gather in one task. Distinct grams then meet by the last two bytes of their context,
which decide all that the contexts of two bytes and more know; the shorter contexts' counts (65,536 at most, as
bytes have 256 values) go to all tasks. Each gram's probability returns the way the word counts do, so no task
and no driver holds the whole trie, however many grams the corpus has.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import LOWER, flat, keep, mix, span_hashes, steps, table, words
from vectide.llm.language import fold
from vectide.plans.ship import ship

ORDER = 4
BLOCK_BYTES = 8 << 20
BLOCKS_A_BUCKET = 8
FOLDS, HELD = 7, 2
SEED = 7
END_KEY = np.uint64(0)


class Trie:
    """Counts of successors by context, one symbol at a time."""

    def __init__(self, order: int = ORDER):
        self.order, self.next = order, {}

    def _contexts(self, past: bytes):
        return [past[len(past) - k :] for k in range(self.order, -1, -1)]

    def learn(self, past: bytes, symbol: int) -> None:
        for context in self._contexts(past):
            seen = self.next.setdefault(context, {})
            seen[symbol] = seen.get(symbol, 0) + 1

    def log10(self, past: bytes, symbol: int) -> float:
        out, excluded = 0.0, set()
        for context in self._contexts(past):
            open_ = {s: n for s, n in self.next.get(context, {}).items() if s not in excluded}
            if not open_:
                continue
            whole = sum(open_.values()) + len(open_)
            if symbol in open_:
                return out + float(np.log10(open_[symbol] / whole))
            out += float(np.log10(len(open_) / whole))
            excluded |= set(open_)
        return out - float(np.log10(256 - len(excluded)))

    def score(self, text: bytes, adapt: bool = False) -> float:
        """log10 probability of the text and its end; an adaptive trie learns each symbol after scoring it."""
        past, out = bytes(self.order), 0.0
        for symbol in [*text, 0]:
            out += self.log10(past, symbol)
            if adapt:
                self.learn(past, symbol)
            past = (past + bytes([symbol]))[-self.order :] if self.order else b""
        return out

    def train(self, text: bytes) -> None:
        past = bytes(self.order)
        for symbol in [*text, 0]:
            self.learn(past, symbol)
            past = (past + bytes([symbol]))[-self.order :] if self.order else b""


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's gram (its ORDER predecessors and itself, high to low) for rows ended by a zero byte; and the rows' bounds."""
    sizes = np.diff(at)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    line = np.zeros(bounds[-1], np.uint64)
    keep_at = np.ones(bounds[-1], bool)
    keep_at[bounds[1:] - 1] = False
    line[keep_at] = LOWER[data]
    code = line.copy()
    since = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes + 1)
    for k in range(1, ORDER + 1):
        back = np.zeros_like(line)
        back[k:] = line[:-k]
        back[since < k] = 0
        code |= back << np.uint64(8 * k)
    return code, bounds


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class Model:
    """A trained trie as sorted arrays: for each gram length its grams and counts, for each context its total, its
    distinct successors, and the mass that these have in the next shorter context.

    With ``pairs`` (grams of two symbols and their counts in the whole corpus), the other grams may be those of
    some two-byte context ends alone; the model is then the whole one for grams with these."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.grams, self.counts, self.contexts = {}, {}, {}
        keys, n = codes, counts.astype(np.int64)
        for size in range(ORDER + 1, 0, -1):
            if size == 2 and pairs is not None:
                keys, n = pairs
            keys, n = _sum_by(keys & np.uint64((1 << (8 * size)) - 1), n)
            self.grams[size], self.counts[size] = keys, n
        for size in range(1, ORDER + 2):
            g, n = self.grams[size], self.counts[size]
            heads = g >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(g) else np.zeros(0, np.int64)
            if size > 1:
                below = self.counts[size - 1][np.searchsorted(self.grams[size - 1], g & np.uint64((1 << (8 * (size - 1))) - 1))]
            else:
                below = np.zeros(len(g), np.int64)
            total = [np.add.reduceat(x, first) if len(first) else x[:0] for x in (n, np.ones(len(g), np.int64), below)]
            self.contexts[size - 1] = (heads[first], *total)

    @functools.cached_property
    def known(self) -> np.ndarray:
        return self.log10_of(self.grams[ORDER + 1])

    def _find(self, sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
        return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)

    def log10_of(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol after the others."""
        out = np.zeros(len(codes))
        live = np.arange(len(codes))
        mass, kinds = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for order in range(ORDER, -1, -1):
            code = codes[live] & np.uint64((1 << (8 * (order + 1))) - 1)
            heads, total, distinct, below = self.contexts[order]
            at, there = self._find(heads, code >> np.uint64(8))
            if not len(heads):
                continue
            n = np.where(there, total[at] - mass[live], 0)
            q = np.where(there, distinct[at] - kinds[live], 0)
            g_at, seen = self._find(self.grams[order + 1], code)
            seen &= q > 0
            whole = np.maximum(n + q, 1)
            out[live] += np.where(q > 0, np.log10(np.where(seen, self.counts[order + 1][g_at], np.maximum(q, 1)) / whole), 0.0)
            mass[live] = np.where(there, below[at], 0)
            kinds[live] = np.where(there, distinct[at], 0)
            live = live[~seen]
        if len(live):
            out[live] -= np.log10(256 - kinds[live])
        return out

    def log10_each(self, codes: np.ndarray) -> np.ndarray:
        """The same for a long run of grams, each distinct one scored once."""
        order = np.argsort(codes)
        ranked = codes[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(codes) else np.zeros(0, bool)
        distinct = ranked[first]
        at, there = self._find(self.grams[ORDER + 1], distinct)
        value = np.zeros(len(distinct))
        if len(self.known):
            value[there] = self.known[at[there]]
        value[~there] = self.log10_of(distinct[~there])
        out = np.empty(len(codes))
        out[order] = value[np.cumsum(first) - 1]
        return out


def _word_keys(piece: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = words(piece, bounds)
    h = span_hashes(piece, starts, ends)
    h[h == END_KEY] = 1
    return h, row


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(buckets)).astype(np.int64)


def _block_words(data, at, learns) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word keys of a block, sorted, with their counts in learning rows; the end counts once a row."""
    keys, counts = [np.array([END_KEY])], [np.array([int(learns.sum())], np.int64)]
    for i, j in steps(at):
        piece = LOWER[data[at[i] : at[j]]]
        h, row = _word_keys(piece, at[i : j + 1] - at[i])
        k, n = _sum_by(h, learns[i:j][row].astype(np.int64))
        keys.append(k)
        counts.append(n)
    return _sum_by(np.concatenate(keys), np.concatenate(counts))


def _block_grams(data, at, learns) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block, sorted, with their counts in learning rows."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in steps(at):
        code, bounds = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
        taught = np.repeat(learns[i:j], np.diff(bounds))
        for part, by in ((code[taught], 1), (code[~taught], 0)):
            part.sort()
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            keys.append(part[first])
            counts.append(np.diff(np.append(first, len(part))) * by)
    return _sum_by(np.concatenate(keys), np.concatenate(counts))


def _counting(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            data, at = flat(group.column("text"))
            learns = ~np.asarray(group.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool)
            block = group.column("block")[0].as_py()
            keys, counts = _block_words(data, at, learns)
            codes, n = _block_grams(data, at, learns)
        rows = []
        for kind, k, c in (("word", keys, counts), ("gram", codes, n)):
            b = _bucket_of(k, buckets)
            order = np.argsort(b, kind="stable")  # keys stay sorted in each bucket
            edge = np.searchsorted(b[order], np.arange(buckets + 1))
            for x in range(buckets):
                part = order[edge[x] : edge[x + 1]]
                if len(part):
                    rows.append((kind, x, block, k[part].tobytes(), c[part].astype(np.int64).tobytes()))
        kind, bucket, blocks, k, c = zip(*rows, strict=True)
        return pa.table({"kind": pa.array(kind), "bucket": pa.array(bucket, pa.int64()), "block": pa.array(blocks, pa.int64()), "keys": pa.array(k, pa.binary()), "counts": pa.array(c, pa.binary())})

    return run


def _joined(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("keys")]
    counts = [np.frombuffer(x.as_buffer(), np.int64) for x in group.column("counts")]
    return keys, *_sum_by(np.concatenate(keys), np.concatenate(counts))


def _answer_words(group: pa.Table) -> pa.Table:
    """Each block's counts of a bucket become the corpus' counts, in the block's order; with the bucket's N and V."""
    keys, known, total = _joined(group)
    back = [total[np.searchsorted(known, k)].tobytes() for k in keys]
    n, v = int(total.sum()), int(np.count_nonzero(total))
    first = [i == 0 for i in range(len(keys))]
    return pa.table({"kind": group.column("kind"), "block": group.column("block"), "bucket": group.column("bucket"), "totals": pa.array(back, pa.binary()), "n": pa.array([n * f for f in first], pa.int64()), "v": pa.array([v * f for f in first], pa.int64())})


def _answer_grams(group: pa.Table) -> pa.Table:
    _, known, total = _joined(group)
    return pa.table({"gram": pa.array(known.view(np.int64)), "n": pa.array(total)})


def _rating(pairs, buckets: int):
    """(bucket, gram, value): log10 probability of each gram of a group, which has all grams of its context ends."""

    def run(group: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            codes = group.column("gram").to_numpy().astype(np.int64).view(np.uint64)
            n = group.column("n").to_numpy()
            values = Model(codes[n > 0], n[n > 0], pairs.value).log10_of(codes)
            return pa.table({"bucket": _bucket_of(codes, buckets), "gram": codes.view(np.int64), "value": values})

    return run


def _answer_values(key, asked: pa.Table, rated: pa.Table) -> pa.Table:
    """The values of each block's grams of a bucket, in the block's order."""
    codes, values = rated.column("gram").to_numpy().astype(np.int64).view(np.uint64), rated.column("value").to_numpy()
    order = np.argsort(codes)
    codes, values = codes[order], values[order]
    back = [values[np.searchsorted(codes, np.frombuffer(k.as_buffer(), np.uint64))].tobytes() for k in asked.column("keys")]
    return pa.table({"kind": pa.array(["gram"] * len(back)), "block": asked.column("block"), "bucket": asked.column("bucket"), "totals": pa.array(back, pa.binary())})


def _rated(spark: SparkSession, counted: DataFrame, buckets: int) -> DataFrame:
    """(kind, block, bucket, totals): for each block the log10 probabilities of its distinct grams, by all learning rows."""
    mine = counted.filter("kind = 'gram'")
    known = keep(spark, mine.groupBy("bucket").applyInArrow(_answer_grams, "gram long, n long"), "grams")
    short = known.filter("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).collect()
    pairs = spark.sparkContext.broadcast((np.array([r["pair"] for r in short], np.uint64), np.array([r["n"] for r in short], np.int64)))
    end = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    values = known.groupBy(F.pmod(F.xxhash64(end), F.lit(buckets)).alias("part")).applyInArrow(_rating(pairs, buckets), "bucket long, gram long, value double")
    return mine.select("bucket", "block", "keys").groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(_answer_values, "kind string, block long, bucket long, totals binary")


def _scoring(buckets: int, whole: int, kinds: int):
    def run(key, docs: pa.Table, totals: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            data, at = flat(docs.column("text"))
            held = np.asarray(docs.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool)
            keys, _ = _block_words(data, at, ~held)
            codes, _ = _block_grams(data, at, ~held)
            count, value = np.zeros(len(keys), np.int64), np.zeros(len(codes))
            goes = {"word": (count, _bucket_of(keys, buckets)), "gram": (value, _bucket_of(codes, buckets))}
            for kind, bucket, values in zip(totals.column("kind").to_pylist(), totals.column("bucket").to_pylist(), totals.column("totals"), strict=True):
                into, b = goes[kind]
                into[b == bucket] = np.frombuffer(values.as_buffer(), into.dtype)
            logs = np.log10((count + 1) / (whole + kinds + 1))
            size = len(at) - 1
            n_tokens, n_known, base, score = np.ones(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            end = int(np.searchsorted(keys, END_KEY))
            n_known += int(count[end] > 0)
            base += logs[end]
            for i, j in steps(at):
                piece = data[at[i] : at[j]]
                h, row = _word_keys(LOWER[piece], at[i : j + 1] - at[i])
                spot = np.searchsorted(keys, h)
                n_tokens[i:j] += np.bincount(row, minlength=j - i)
                n_known[i:j] += np.bincount(row, weights=count[spot] > 0, minlength=j - i).astype(np.int64)
                base[i:j] += np.bincount(row, weights=logs[spot], minlength=j - i)
                code, bounds = grams(piece, at[i : j + 1] - at[i])
                order = np.argsort(code)
                each = np.empty(len(code))
                each[order] = value[np.searchsorted(codes, code[order])]
                score[i:j] = np.add.reduceat(each, bounds[:-1])
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(size, whole), "base_score": base, "score": score})

    return run


def scored(spark: SparkSession, docs: DataFrame, folds: int = FOLDS, held: int = HELD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from rows outside the held-out fold and scores all. Null text is empty and has the end alone. Repeated
    rows are counted each and get the same scores. A null doc_id is a learning row. An empty table gives no
    rows. Other columns are not looked at.
    """
    ship(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = -(-blocks // BLOCKS_A_BUCKET)
    # Dealt at random, whatever rows have in common, and written, so that both passes see the same blocks.
    dealt = base.withColumn("held_out", fold(F.col("doc_id"), folds) == held).withColumn("block", F.floor(F.rand(SEED) * blocks).cast("long"))
    dealt = keep(spark, dealt, "dealt")
    counted = keep(spark, dealt.groupBy("block").applyInArrow(_counting(buckets), "kind string, bucket long, block long, keys binary, counts binary"), "counts")
    answer = "kind string, block long, bucket long, totals binary"
    totals = keep(spark, counted.filter("kind = 'word'").groupBy("bucket").applyInArrow(_answer_words, f"{answer}, n long, v long"), "totals")
    n, v = (x or 0 for x in totals.agg(F.sum("n"), F.sum("v")).first())
    back = totals.select("kind", "block", "bucket", "totals").unionByName(_rated(spark, counted, buckets))
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scoring(buckets, n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_score": op10_lm_score}
SQL: dict[str, str] = {}
