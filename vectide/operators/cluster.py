"""Clustering of weighted points: a one-pass sketch by shards, and trimmed ball k-means.

centroids: id BIGINT, w DOUBLE, v ARRAY<DOUBLE>. A sketch is sequential within a shard. By default the input's
partitions are the shards, read as they come, without a shuffle. With a number of shards these are keyed by
``pmod(id, shards)``, read in id order and seeded by (seed, shard), so that the result depends on the parameters and
not on Spark's partitioning, at the price of a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vec
from vectide.operators.search import MAX_BROADCAST, paired, projection
from vectide.operators.searchers import UpdatableSearcher, create
from vectide.plans.ship import ship
from vectide.plans.store import keep

CENTROIDS = "id long, w double, v array<double>"


@dataclass
class Sketch:
    """State of the one-pass sketch: centroids with weights, the distance cutoff and the target number of clusters.

    ``index`` names the searcher that the centroids are kept in, or makes one of a dimension.
    """

    target: int
    cutoff: float
    beta: float = 1.3
    log_factor: float = 10.0
    overshoot: float = 0.2
    seed: int = 0
    count: int = 0
    index: str | Callable[[int], UpdatableSearcher] = "brute"
    at: UpdatableSearcher | None = None
    w: list[float] = field(default_factory=list)
    rng: np.random.Generator | None = None

    def __post_init__(self):
        if self.rng is None:
            self.rng = np.random.default_rng(self.seed)

    def _place(self, x: np.ndarray, weight: float) -> None:
        """Merge into the nearest centroid, or open one with probability distance / cutoff."""
        if self.at is None:
            self.at = create(self.index, len(x))
        near, d = self.at.nearest(x)
        if near >= 0:
            opens = d > 0 if self.cutoff <= 0 else self.rng.random() < d / self.cutoff
            if not opens:
                whole = self.w[near] + weight
                if whole > 0:
                    self.at.move(near, self.at.v[near] + (x - self.at.v[near]) * (weight / whole))
                self.w[near] = whole
                return
        self.at.add(x)
        self.w.append(weight)

    def _collapse(self) -> None:
        """Re-cluster the centroids themselves in random order; raise the cutoff if that left too many."""
        self.target = int(max(self.target, self.log_factor * math.log(max(self.count, 1))))
        old_v, old_w = self.centroids()
        self.w = []
        self.at.clear()
        for k in self.rng.permutation(len(old_w)):
            self._place(old_v[k], old_w[k])
        if len(self.w) > self.overshoot * self.target:
            self.cutoff = self.cutoff * self.beta if self.cutoff > 0 else 1e-12

    def add(self, x: np.ndarray, weight: float = 1.0) -> None:
        self._place(np.asarray(x, float), float(weight))
        self.count += 1
        if len(self.w) > self.target:
            self._collapse()

    def extend(self, x: np.ndarray, w: np.ndarray) -> Sketch:
        for row, weight in zip(x, w, strict=True):
            self.add(row, weight)
        return self

    def centroids(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.at.v[: len(self.w)].copy(), np.array(self.w)) if self.w else (np.zeros((0, 0)), np.zeros(0))

    def restore(self, v: np.ndarray, w: list[float]) -> Sketch:
        """Take centroids as they are."""
        self.w, self.at = list(w), create(self.index, v.shape[1]) if len(v) else None
        if len(v):
            self.at.add_all(v)
        return self


def distance_cutoff(points: DataFrame, sample: int = 100, metric: str = "euclidean") -> DataFrame:
    """(cutoff): the least distance between two of the first ``sample`` points by id; infinite for fewer than two."""
    first = points.orderBy("id").limit(sample).select("id", "v")
    a, b = first.select(F.col("id").alias("i"), F.col("v").alias("x")), first.select(F.col("id").alias("j"), F.col("v").alias("y"))
    least = F.min(vec.distance(metric, "x", "y"))
    return a.join(b, F.col("i") < F.col("j")).agg(F.coalesce(least, F.lit(float("inf"))).alias("cutoff"))


def shard_sketches(points: DataFrame, start: Sketch, shards: int | None = None) -> DataFrame:
    """(shard, cutoff, count, w, v): each shard's centroids after one pass. No shards given: each partition of the input is
    one, in the order in which it is read."""
    ship(points.sparkSession)
    schema = "shard long, cutoff double, count long, w double, v array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[int, Sketch] = {}
        for pdf in frames:
            for shard, rows in pdf.groupby("shard", sort=True):
                state = states.setdefault(shard, replace(start, seed=start.seed * 1_000_003 + int(shard), rng=None, w=[], at=None))
                state.extend(np.stack(rows["v"].to_numpy()), rows["w"].to_numpy())
        for shard, state in states.items():
            v, w = state.centroids()
            yield pd.DataFrame({"shard": shard, "cutoff": state.cutoff, "count": state.count, "w": w, "v": list(v)})

    if shards is None:
        dealt = points.withColumn("shard", F.spark_partition_id().cast("long"))
    else:
        dealt = points.withColumn("shard", F.pmod("id", F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "id")
    return dealt.select("shard", "w", "v").mapInPandas(run, schema)


def merged(sketches: DataFrame, start: Sketch, per_shard: bool = False) -> DataFrame:
    """Centroids of the shards' centroids: one more pass over them from the least of their cutoffs, towards target * ln(rows)
    centroids, or target * shards if ``per_shard``. Where the shards have no more than these, all of them stay: a pass from
    a cutoff that the shards raised would merge most.

    The input is bounded: at most target + log_factor * ln(rows) centroids a shard.
    """
    ship(sketches.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "place"])
        each = pdf.drop_duplicates("shard")
        times = len(each) if per_shard else math.log(max(int(each["count"].sum()), 2))
        state = replace(start, target=int(max(start.target, start.target * times)), cutoff=float(pdf["cutoff"].min()), rng=None, w=[], at=None)
        v, w = np.stack(pdf["v"].to_numpy()), pdf["w"].to_numpy()
        if len(w) > state.target:
            v, w = state.extend(v, w).centroids()
        return pd.DataFrame({"id": np.arange(len(w)), "w": w, "v": list(v)})

    return sketches.withColumn("place", F.monotonically_increasing_id()).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, CENTROIDS)


def streaming_kmeans(points: DataFrame, k: int, shards: int | None = None, cutoff: float | None = None, seed: int = 0, per_shard: bool = False, **options) -> DataFrame:
    """One-pass sketch of about k ln(n) weighted centroids: shards side by side, then their union. No points: no rows.
    ``options`` are those of ``Sketch``, its index among them."""
    if cutoff is None:
        cutoff = distance_cutoff(points).first()["cutoff"]
    start = Sketch(k, cutoff if math.isfinite(cutoff) else 1.0, seed=seed, **options)
    return merged(keep(points.sparkSession, shard_sketches(points, start, shards), "sketches"), start, per_shard)


def split_kmeans(points: DataFrame, k: int, splits: int, seed: int = 0, **options) -> DataFrame:
    """The sketch over contiguous blocks of ids, towards splits * k centroids in the end."""
    return streaming_kmeans(split(points, splits).select(*points.columns), k, seed=seed, per_shard=True, **options)


# --- means ------------------------------------------------------------------------------------------------


def centroid(points: DataFrame) -> DataFrame:
    """(pos, x): components of the weighted mean of all points."""
    parts = points.select("w", F.posexplode("v").alias("pos", "x"))
    return parts.groupBy("pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))


def mean_of(points: DataFrame) -> list[float]:
    return [r["x"] for r in centroid(points).orderBy("pos").collect()]


def total_radius(points: DataFrame, center: list[float]) -> DataFrame:
    """(radius): sum of squared distances to the centre, unweighted."""
    return points.agg(F.sum(vec.sq_l2("v", vec.literal(center))).alias("radius"))


def seed_probabilities(points: DataFrame) -> DataFrame:
    """(id, p): the chance of each point to be the first seed, in proportion to radius + weight * squared distance to the mean."""
    center = mean_of(points)
    if not center:
        return points.select("id", F.lit(0.0).alias("p"))
    d = points.select("id", "w", vec.sq_l2("v", vec.literal(center)).alias("d"))
    total = d.agg(F.sum(F.col("w") * F.col("d")).alias("radius"), F.sum("w").alias("weight")).first()
    share = F.col("w") * (F.lit(total["radius"]) + F.lit(total["weight"]) * F.col("d"))
    return d.select("id", (share / F.lit(2 * total["radius"] * total["weight"])).alias("p")) if total["radius"] else d.select("id", (F.col("w") / F.lit(total["weight"])).alias("p"))


def _uniform(seed: int, n: int):
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def seeds(points: DataFrame, k: int, seed: int = 0) -> list[tuple[int, list[float]]]:
    """k seeds: the first by ``seed_probabilities``, each further one in proportion to weight times squared distance to
    the nearest seed. One pass each; a draw keeps the least of -ln(u) / weight, of each batch and then of all, so no task
    holds all points and the plan doesn't grow with the seeds."""
    ship(points.sparkSession)
    got: list[tuple[int, list[float]]] = []

    def draw(df: DataFrame, column: str):
        # u depends on (seed, draw, id) alone, whatever the partitioning.
        chances = df.select("id", "v", F.col(column).alias("p"), (-F.log(F.greatest(_uniform(seed, len(got)), F.lit(1e-300)))).alias("u"))
        c = np.array([v for _, v in got], float)

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in frames:
                p = batch.column("p").to_numpy(zero_copy_only=False).astype(float)
                if len(c) and len(p):
                    x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                    p = p * _numpy_distances("sqeuclidean", x, c).min(1)
                on = np.flatnonzero(p > 0)
                if len(on):
                    key = batch.column("u").to_numpy()[on] / p[on]
                    best = on[np.lexsort((batch.column("id").to_numpy()[on], key))[0]]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(best, 1), batch.column("v").slice(best, 1), pa.array([key.min()])], ["id", "v", "key"])

        return chances.mapInArrow(run, "id long, v array<double>, key double").orderBy("key", "id").first()

    first = draw(points.join(seed_probabilities(points), "id"), "p")
    while first is not None:
        got.append((first["id"], first["v"]))
        if len(got) == k:
            return got
        first = draw(points, "w")
    raise ValueError(f"{k} distinct points are needed, got {len(got)}")


# --- assignment and ball k-means --------------------------------------------------------------------------


def _numpy_distances(metric: str, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows, centroids) distances, with differences taken one by one, as the Column forms do."""
    if metric == "cosine":
        return 1 - (x @ c.T) / np.sqrt((x * x).sum(1)[:, None] * (c * c).sum(1)[None])
    out = np.empty((len(x), len(c)))
    for k in range(len(c)):
        diff = x - c[k]
        out[:, k] = np.abs(diff).sum(1) if metric == "manhattan" else (diff * diff).sum(1)
    return np.sqrt(out) if metric == "euclidean" else out


IN_NUMPY = ("euclidean", "sqeuclidean", "manhattan", "cosine")


def _few(centroids: DataFrame, metric) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, vectors) by id on the driver, where they are at most MAX_BROADCAST and numpy has the metric."""
    if metric not in IN_NUMPY:
        return None
    rows = centroids.select("id", "v").limit(MAX_BROADCAST + 1).collect()
    if len(rows) > MAX_BROADCAST:
        return None
    rows.sort(key=lambda r: r["id"])
    return np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], float)


def _batches(frames: Iterator[pa.RecordBatch], metric: str, c: np.ndarray):
    """(batch, vectors, place of the nearest centroid, distance); ties go to the first."""
    for batch in frames:
        if batch.num_rows and len(c):
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            d = _numpy_distances(metric, x, c)
            best = d.argmin(1)
            yield batch, x, best, d[np.arange(len(x)), best]


def nearest(points: DataFrame, centroids: DataFrame, metric: str = "euclidean", dim: int | None = None) -> DataFrame:
    """(id, centroid_id, distance): each point's nearest centroid; ties go to the smallest id. Points stay where they are:
    the centroids go to them, up to MAX_BROADCAST; more, or another metric, are met block by block."""
    few = _few(centroids, metric)
    if few is None:
        c = centroids.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        pairs = paired(points.select("id", "v"), c).select("id", "query_id", vec.distance(metric, "v", "q", dim).alias("d"))
        best = pairs.groupBy("id").agg(F.min(F.struct("d", "query_id")).alias("m"))
        return best.select("id", F.col("m.query_id").alias("centroid_id"), F.col("m.d").alias("distance"))
    ids, c = few
    ship(points.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, d in _batches(frames, metric, c):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids[best]), pa.array(d)], ["id", "centroid_id", "distance"])

    return points.select("id", "v").mapInArrow(run, "id long, centroid_id long, distance double")


def gaps(centroids: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(centroid_id, gap): the distance to the nearest other centroid; infinite for a single one."""
    a = centroids.select(F.col("id").alias("centroid_id"), F.col("v").alias("a"))
    b = centroids.select(F.col("id").alias("query_id"), F.col("v").alias("b"))
    found = paired(a, b, F.col("centroid_id") != F.col("query_id")).groupBy("centroid_id").agg(F.min(vec.distance(metric, "a", "b")).alias("gap"))
    return a.select("centroid_id").join(found, "centroid_id", "left").select("centroid_id", F.coalesce("gap", F.lit(float("inf"))).alias("gap"))


def ball_step(points: DataFrame, centroids: DataFrame, trim: float = 0.9, metric: str = "euclidean", dim: int | None = None) -> DataFrame:
    """One trimmed Lloyd step: weighted means of the points nearer than ``trim`` times their centroid's gap. A centroid
    without such points keeps its place with weight 0. Each batch of points sends on one weighted sum a centroid."""
    few = _few(centroids, metric)
    if few is not None:
        return _summed_step(points, centroids, few, trim, metric)
    rows = assigned(points, centroids, trim, metric, dim).filter("not trimmed")
    parts = rows.join(points.select("id", "w", "v"), "id").select("centroid_id", "w", F.posexplode("v").alias("pos", "x"))
    means = parts.groupBy("centroid_id", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), F.sum("w").alias("w"))
    moved = means.groupBy("centroid_id").agg(F.max("w").alias("w_new"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v_new"))
    return centroids.join(moved, F.col("id") == F.col("centroid_id"), "left").select("id", F.coalesce("w_new", F.lit(0.0)).alias("w"), F.coalesce("v_new", "v").alias("v"))


def _summed_step(points: DataFrame, centroids: DataFrame, few: tuple[np.ndarray, np.ndarray], trim: float, metric: str) -> DataFrame:
    ids, c = few
    ship(points.sparkSession)
    gap = np.full(len(c), np.inf)
    for k in range(len(c)):
        others = np.delete(_numpy_distances(metric, c[k : k + 1], c)[0], k)
        gap[k] = others.min(initial=np.inf)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, best, d in _batches(frames, metric, c):
            w = batch.column("w").to_numpy()
            near = d < trim * gap[best]
            on, row = np.unique(best[near], return_inverse=True)
            weight, total = np.zeros(len(on)), np.zeros((len(on), x.shape[1]))
            np.add.at(weight, row, w[near])
            np.add.at(total, row, x[near] * w[near][:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(weight), pa.array(list(total), pa.list_(pa.float64()))], ["centroid_id", "w", "total"])

    sums = points.select("w", "v").mapInArrow(run, "centroid_id long, w double, total array<double>")
    parts = sums.select("centroid_id", "w", F.posexplode("total").alias("pos", "x")).groupBy("centroid_id", "pos").agg((F.sum("x") / F.sum("w")).alias("x"), F.sum("w").alias("w"))
    moved = parts.groupBy("centroid_id").agg(F.max("w").alias("w_new"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v_new"))
    return centroids.join(moved, F.col("id") == F.col("centroid_id"), "left").select("id", F.coalesce("w_new", F.lit(0.0)).alias("w"), F.coalesce("v_new", "v").alias("v"))


def assigned(points: DataFrame, centroids: DataFrame, trim: float = 0.9, metric: str = "euclidean", dim: int | None = None) -> DataFrame:
    """(id, centroid_id, distance, trimmed)."""
    return nearest(points, centroids, metric, dim).join(gaps(centroids, metric), "centroid_id").select("id", "centroid_id", "distance", (F.col("distance") >= trim * F.col("gap")).alias("trimmed"))


def ball_kmeans(points: DataFrame, k: int, iterations: int = 20, trim: float = 0.9, seed: int = 0, start: DataFrame | None = None, tolerance: float = 0.0, metric: str = "euclidean") -> DataFrame:
    """Trimmed k-means from k-means++-style seeds (or ``start``), until no centroid moves beyond ``tolerance``."""
    if k <= 0 or iterations <= 0:
        raise ValueError("k and iterations must be above 0")
    spark = points.sparkSession
    if start is None:
        start = spark.createDataFrame([(n, 0.0, v) for n, (_, v) in enumerate(seeds(points, k, seed))], CENTROIDS)
    for _ in range(iterations):
        moved = keep(spark, ball_step(points, start, trim, metric), "centroids")
        far = moved.select("id", F.col("v").alias("a")).join(start.select("id", F.col("v").alias("b")), "id").agg(F.max(vec.l2("a", "b"))).first()[0]
        start = moved
        if far is None or far <= tolerance:
            break
    return start


def sketch_then_ball(points: DataFrame, k: int, shards: int | None = None, iterations: int = 20, seed: int = 0) -> DataFrame:
    """The two-stage clustering: the sketch's weighted centroids, refined to k. A sketch's collapses are random and may leave
    fewer than k distinct centroids; the points themselves are refined then."""
    sketch = keep(points.sparkSession, streaming_kmeans(points, 10 * k, shards, seed=seed), "sketch")
    if sketch.select("v").distinct().count() < k:
        sketch = points
    return ball_kmeans(sketch, k, iterations, seed=seed)


def split(points: DataFrame, parts: int) -> DataFrame:
    """``points`` with ``part``: contiguous blocks of id, of nearly equal size."""
    spread = points.repartitionByRange(parts, "id")
    return spread.withColumn("part", F.spark_partition_id())


def sample_rows(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn uniformly: those of least seeded digest."""
    return points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


# --- quality ----------------------------------------------------------------------------------------------


def weight_by_mean(centroids: DataFrame, means: DataFrame) -> DataFrame:
    """(centroid_id, weight) of the true means: the weight of the centroids nearest to each."""
    return nearest(centroids, means).join(centroids.select("id", "w"), "id").groupBy("centroid_id").agg(F.sum("w").alias("weight"))


def rmse(points: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """(rmse) of replacing each point by its nearest centroid, per component."""
    return nearest(points, centroids, dim=dim).agg(F.sqrt(F.avg(F.col("distance") * F.col("distance")) / dim).alias("rmse"))


def rmse_both(points: DataFrame, centroids: DataFrame, basis: list[list[float]], search_size: int) -> DataFrame:
    """(rmse, approximate): ``rmse``, and the same by nearest centroids from a projection search."""
    dim = len(basis[0])
    asked = points.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = projection(centroids.select("id", "v"), asked, 1, basis, search_size)
    rough = found.agg(F.sqrt(F.avg(F.col("distance") * F.col("distance")) / dim).alias("approximate"))
    return rmse(points, centroids, dim).join(rough, F.lit(True))


def singular_values(points: DataFrame) -> list[float]:
    """Those of the matrix whose rows are the points, largest first, by its Gram matrix: a sum of (dimension x dimension)
    parts, one a batch."""
    ship(points.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for batch in frames:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                gram = x.T @ x + (0 if gram is None else gram)
        if gram is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(gram)), pa.int64()), pa.array(list(gram), pa.list_(pa.float64()))], ["i", "row"])

    parts = points.select("v").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    if not parts:
        return []
    gram = np.zeros((max(r["i"] for r in parts) + 1,) * 2)
    for r in parts:
        gram[r["i"], r["j"]] = r["x"]
    return [float(x) for x in np.sqrt(np.maximum(np.linalg.eigvalsh(gram), 0))[::-1]]
