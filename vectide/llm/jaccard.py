"""Exact n-gram Jaccard self-join with set-relation skipping.

Each document is the set of its five-word shingles' 64-bit hashes. Equal sets collapse to one
representative. A set posts only the rarest part of its lowest hashes, so that any two sets that reach the
threshold meet in a list:

* the block of the lowest ``n - ceil(t n) + f(n)`` hashes of two linked sets shares ``f`` or more positions,
  so a set with fewer repeated hashes in that block is skipped whole, before its full set is ever moved;
* of the rest, a set whose repeated hashes are fewer than the least overlap is skipped too;
* the others post their repeated hashes, rarest first, but for the last ``ceil(t n) - 1``, each with what is left
  of the set after it; where two sets first meet, the shorter rest must hold the overlap still missing.

Within lists, answers come from a similar set's answers. Each set refers to the most central set that it
meets (the one whose repeated hashes are the most frequent on average) and is compared with it once, which also gives its
delta: the hashes that only one of the two has. Two sets of one reference differ exactly where their deltas
differ, so if one of them doesn't link to the reference they can only link by sharing enough of their deltas:
those are indexed in turn, rarest part first, and meeting pairs are compared. Sets of different references
that meet in a list and aren't in one component yet are compared last; lists are cut in blocks by size there,
and an entry skips the blocks out of its position's reach. So a group of copies costs one comparison a copy,
not one a pair, and no link that would change a component is lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import LOWER, flat, forget, in_arrow, keep, mix, near_texts, span_hashes, steps, table, words
from vectide.llm.native import LOWERED, SPACED, UPPER

WIDTH = 5
#: Sizes within this ratio share a block of a list.
STEP = 1.12
#: Steps from a set to its reference, beyond the first.
HOPS = 2
#: The threshold as a fraction of whole numbers, so that no rounding decides a link.
NUMER, DENOM = 4, 5

_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WIDTH):
    """The sorted distinct shingle hashes of each row of a flat buffer, in order."""
    for i, j in steps(at):
        piece = LOWER[data[at[i] : at[j]]]
        bounds = at[i : j + 1] - at[i]
        starts, ends, row = words(piece, bounds)
        w = span_hashes(piece, starts, ends)
        edge = np.searchsorted(row, np.arange(j - i + 1))
        if len(w) >= width:
            full = np.zeros(len(w) - width + 1, np.uint64)
            for k in range(width):
                full += w[k : len(w) - width + 1 + k] * _WEIGHTS[k % 5] * np.uint64(2 * (k // 5) + 1)
            full = mix(full)
        for k in range(j - i):
            a, b = int(edge[k]), int(edge[k + 1])
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                short = np.uint64(b - a) * _WEIGHTS[4]
                for x, m in zip(w[a:b], _WEIGHTS, strict=False):
                    short = short + x * (m ^ np.uint64(0xFF51AFD7ED558CCD))
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def needed(n: int) -> int:
    """Least overlap with any set that a set of n can link to."""
    return -(-NUMER * n // DENOM)


def shared(n: int) -> int:
    """Repeated low hashes that two linked sets have at least, the smaller being of size n."""
    return 1 + n // 16


def low_length(n: int) -> int:
    return min(n, n - needed(n) + shared(n))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _print(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _sketches(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            data, at = flat(batch.column("text"))
            sizes, prints, lows = [], [], []
            for found in shingle_sets(data, at):
                sizes.append(len(found))
                prints.append(_print(found))
                lows.append(found[: low_length(len(found))].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), _lists(lows)], ["doc_id", "mark", "n", "fp", "low"])


def _whole_sets(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            data, at = flat(batch.column("text"))
            found = list(shingle_sets(data, at))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in found], pa.int64()), _lists([x.view(np.int64) for x in found])], ["id", "n", "members"])


def _overlaps(deltas: bool):
    def run(batches):
        for batch in batches:
            common, apart = [], []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                both = np.concatenate([x.values.to_numpy(), y.values.to_numpy()])
                both.sort()
                same = both[1:] == both[:-1]
                common.append(int(np.count_nonzero(same)))
                if deltas:
                    once = np.ones(len(both), bool)
                    once[1:] &= ~same
                    once[:-1] &= ~same
                    apart.append(both[once])
            columns = {k: batch.column(k) for k in ("a", "b", "n_a", "n_b")} | {"common": pa.array(common, pa.int64())}
            if deltas:
                columns["delta"] = _lists(apart)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _compared(pairs: DataFrame, sets: DataFrame, deltas: bool) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("members_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("members_b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "members_a", "members_b")
    found = in_arrow(met, _overlaps(deltas), "a long, b long, n_a long, n_b long, common long" + ", delta array<long>" * deltas)
    return found.withColumn("linked", F.col("common") * DENOM >= (F.col("n_a") + F.col("n_b") - F.col("common")) * NUMER)


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlap of each pair (a, b): adds n_a, n_b, common and linked."""
    return _compared(pairs, sets, deltas=False)


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``compare``, with ``delta``: the hashes that one of the two sets has."""
    return _compared(pairs, sets, deltas=True)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each endpoint of (a, b) reaches, by label spreading with jumps."""
    both = keep(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = keep(spark, both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        spread = labels.join(near, "id").select("id", "component", F.least("component", "m").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = keep(spark, spread.join(jump, "next", "left").select("id", F.col("component").alias("was"), F.least("next", "far").alias("component")), "labels")
        if moved.filter("component <> was").isEmpty():
            return moved.select("id", "component")
        labels = moved.select("id", "component")


def _fits(a: str, b: str):
    """Sizes that can reach the threshold."""
    return (F.least(a, b) * DENOM) >= (F.greatest(a, b) * NUMER)


def _band(n) -> Column:
    """The block of a list that sets of size n stand in: sizes within STEP of each other."""
    return F.floor(F.log(n) / math.log(STEP))


def mark_of(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def jaccard_components(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, links): (doc_id, mark, n_shingles, component_id, component), and the compared pairs (a, b, n_a, n_b,
    common) of representatives that linked, by the least doc_id of each; components follow from them.

    Null, empty and wordless texts have no shingles and link with nothing. Equal sets are linked, so repeated
    rows share a component; rows that repeat a doc_id each keep a row (``mark`` tells their texts apart), and where
    their texts differ each text's links count. Rows with a null doc_id link like all others; component_id, the least
    doc_id of the component, is null where none of its rows has one. ``component`` names components in this result
    alone; it is null without shingles. An empty table gives no rows. Other columns are not looked at.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(text).alias("mark"), text.alias("text"))
    sketch = keep(spark, in_arrow(base, _sketches, "doc_id long, mark long, n long, fp binary, low array<long>"), "sketches")
    # A set's id is its group's own: one doc_id may stand for several texts, and be the least of several groups.
    group = sketch.filter("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("least"), F.min_by("mark", F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("mark"), F.first("low").alias("low"))
    group = keep(spark, group.withColumn("id", F.monotonically_increasing_id()), "groups")
    low = group.select("id", F.explode("low").alias("h"))
    # What joins a list by its hash is written first: both sides are then plain shuffles, of which Spark splits a hot hash's.
    common = keep(spark, low.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h"), "common")
    least = F.floor(F.ceil(F.col("n") * NUMER / DENOM) / 16) + 1
    likely = low.join(common, "h").groupBy("id").agg(F.count("*").alias("met")).join(group.drop("low"), "id").filter(F.col("met") >= least).select("id", "fp", "n", "least", F.col("mark").alias("of"))
    likely = keep(spark, likely, "likely")
    # One text of each group, by its least doc_id and mark. Where several rows have both, one of them: sets then need no
    # shuffle to be told apart.
    wanted = near_texts(keep(spark, likely.select("id", F.col("least").alias("of_id"), "of"), "wanted"))
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of"))).select("id", "text")
    twice = sketch.groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of")).agg(F.count("*").alias("rows")).filter("rows > 1")
    twice = keep(spark, likely.join(twice, F.col("least").eqNullSafe(F.col("of_id")) & (likely["of"] == twice["of"])).select("id"), "twice")
    if not twice.isEmpty():
        texts = texts.join(twice, "id", "left_anti").unionByName(texts.join(twice, "id", "left_semi").dropDuplicates(["id"]))
    sets = keep(spark, in_arrow(texts, _whole_sets, "id long, n long, members array<long>"), "sets")
    forget(common, likely, twice)

    # The likely sets whole: those with too many hashes of their own go, the others post their rarest repeated ones.
    whole = sets.select("id", F.explode("members").alias("h"))
    often = keep(spark, whole.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    met = whole.join(often, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("met"))
    posts = met.join(sets.select("id", "n"), "id").withColumn("take", (F.size("met") - F.ceil(F.col("n") * NUMER / DENOM) + 1).cast("int")).filter("take > 0")
    posts = posts.withColumn("c", F.aggregate("met", F.lit(0.0), lambda t, m: t + F.log(m["df"])) / F.col("n")).withColumn("last", F.size("met") - 1)
    posts = posts.select("id", "n", "c", "last", F.posexplode(F.slice("met", F.lit(1), "take")).alias("i", "m")).select("id", "n", "c", (F.col("last") - F.col("i")).alias("rest"), F.col("m.h").alias("h"))
    posts = keep(spark, posts, "posts")
    # Ties go to the smallest id in every list alike, so that a group of copies has one reference.
    lists = keep(spark, posts.groupBy("h").agg(F.max(F.struct("c", -F.col("id"))).alias("lead"), F.count("*").alias("size")).filter("size > 1"), "lists")
    active = keep(spark, posts.join(lists, "h").select("h", "id", "n", "rest", "lead"), "active")
    forget(often, posts, lists)

    # Round 1: each set against its reference.
    seen = active.groupBy("id", "n").agg((-F.max("lead")["col2"]).alias("ref"))
    for _ in range(HOPS):  # the reference's own reference is more central still, so that stars of one group meet
        seen = keep(spark, seen, "references")
        up = seen.select(F.col("id").alias("ref"), F.col("ref").alias("higher"))
        seen = seen.join(up, "ref").select("id", "n", F.col("higher").alias("ref"))
    seen = keep(spark, seen, "references")
    delta = keep(spark, differences(seen.filter("id <> ref").select(F.col("id").alias("a"), F.col("ref").alias("b")), sets), "deltas")
    links = delta.filter("linked").select("a", "b", "n_a", "n_b", "common")
    reached = components(spark, links)

    # Round 2: sets of one reference, of which at least one doesn't link to it, by their deltas.
    apart = F.col("n_a") + F.col("n_b") - 2 * F.col("common")
    star = delta.select(F.col("a").alias("id"), F.col("n_a").alias("n"), F.col("b").alias("ref"), "linked", apart.alias("apart"), "delta").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = delta.groupBy(F.col("b").alias("ref")).agg(F.count("*").alias("size"), F.bool_and("linked").alias("all")).filter("size > 1 and not `all`").select("ref")
    star = star.join(open_, "ref")
    part = star.select("ref", "id", F.explode("delta").alias("e"))
    often = keep(spark, part.groupBy("ref", "e").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    rare = part.join(often, ["ref", "e"]).groupBy("ref", "id").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("met"))
    floor_ = F.when(F.col("linked"), F.ceil(F.col("apart") * NUMER / (NUMER + DENOM))).otherwise(F.col("apart") - F.floor(F.col("n") * (DENOM - NUMER) / NUMER))
    posted = rare.join(star.drop("delta"), ["ref", "id"]).withColumn("take", F.size("met") - F.greatest(floor_, F.lit(1)) + 1).filter("take > 0")
    posted = keep(spark, posted.select("ref", "id", "n", "linked", "apart", "component", (F.size("met") - 1).alias("last"), F.posexplode(F.slice("met", F.lit(1), F.col("take").cast("int"))).alias("i", "m")).select("ref", "id", "n", "linked", "apart", "component", (F.col("last") - F.col("i")).alias("rest"), F.col("m.e").alias("e")), "delta-posts")
    x = posted.filter("not linked").select("ref", "e", *(F.col(c).alias(f"x_{c}") for c in ("id", "n", "apart", "rest", "component")))
    y = posted.select("ref", "e", "linked", *(F.col(c).alias(f"y_{c}") for c in ("id", "n", "apart", "rest", "component")))
    # In the first hash that two deltas share, what is left after it must hold the rest of the overlap they need.
    enough = 2 * (NUMER + DENOM) * (1 + F.least("x_rest", "y_rest")) >= (NUMER + DENOM) * (F.col("x_apart") + F.col("y_apart")) - (DENOM - NUMER) * (F.col("x_n") + F.col("y_n"))
    room = F.abs(F.col("x_apart") - F.col("y_apart")) * (NUMER + DENOM) <= (F.col("x_n") + F.col("y_n")) * (DENOM - NUMER)
    once = F.col("linked") | (F.col("x_id") < F.col("y_id"))
    pairs = x.join(y, ["ref", "e"]).filter((F.col("x_id") != F.col("y_id")) & once & enough & (F.col("x_component") != F.col("y_component")) & room & _fits("x_n", "y_n"))
    second = keep(spark, compare(pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct(), sets), "compared")
    more = links.union(second.filter("linked").select("a", "b", "n_a", "n_b", "common"))
    reached = components(spark, more)

    # Round 3: sets of different references that meet in a list. A list's entries stand in blocks by size, and an entry
    # skips the blocks that it can't reach from its position: sizes for which what is left of it is too little.
    placed = active.select("h", "id", "n", "rest").join(seen.select("id", "ref"), "id").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("ref").alias("first"), F.max("ref").alias("last")).filter("lo < hi and first < last").select("h")
    placed = keep(spark, placed.join(keep(spark, mixed, "mixed"), "h"), "placed")
    x = placed.select("h", *(F.col(c).alias(f"x_{c}") for c in ("id", "n", "rest", "ref", "component")))
    y = placed.select("h", _band(F.col("n")).alias("band"), *(F.col(c).alias(f"y_{c}") for c in ("id", "n", "rest", "ref", "component")))
    most = F.least(F.col("x_n") * DENOM / NUMER, (F.col("x_rest") + 1) * (NUMER + DENOM) / NUMER - F.col("x_n"))
    x = x.withColumn("most", most).filter("most >= x_n").withColumn("band", F.explode(F.sequence(_band(F.col("x_n")), _band(F.col("most"))))).drop("most")
    enough = (NUMER + DENOM) * (1 + F.least("x_rest", "y_rest")) >= NUMER * (F.col("x_n") + F.col("y_n"))
    once = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_id") < F.col("y_id")))
    pairs = x.join(y, ["h", "band"]).filter(once & enough & (F.col("x_ref") != F.col("y_ref")) & (F.col("x_ref") != F.col("y_id")) & (F.col("y_ref") != F.col("x_id")) & (F.col("x_component") != F.col("y_component")) & _fits("x_n", "y_n"))
    third = keep(spark, compare(pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct(), sets), "compared")
    late = third.filter("linked").select("a", "b", "n_a", "n_b", "common")
    if not late.isEmpty():
        more = more.union(late)
        reached = components(spark, more)

    joined = group.select("fp", "n", "least", "id").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = joined.join(keep(spark, named, "named"), "component").select("fp", "n", "component", "component_id")
    out = sketch.select("doc_id", "mark", "n", "fp").join(whole, ["fp", "n"], "left")
    for end in ("a", "b"):
        more = more.join(group.select(F.col("id").alias(end), F.col("least").alias(f"doc_{end}")), end).drop(end).withColumnRenamed(f"doc_{end}", end)
    more = more.select("a", "b", "n_a", "n_b", "common")
    forget(active, seen, placed, posted)
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component"), more


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


SQL = {
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{SPACED}') AS w FROM documents),
        spot AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS k FROM spot),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT edge.a, c FROM reach JOIN edge ON edge.b = reach.doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n"""
}
QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
