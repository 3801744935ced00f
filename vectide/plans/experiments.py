"""Experiments on generated points: how fast and how good searches and clusterings are as their parameters change.

Each gives a DataFrame with one row a setting, which ``files.write_report`` puts down; ``python -m
vectide.plans.experiments NAME FOLDER`` does both. Sizes are parameters; the defaults take minutes on one machine.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import basis as bases
from vectide.operators import cluster, search
from vectide.plans.store import keep
from vectide.sources import files, generate


def _asked(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def _timed(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def overlap(spark: SparkSession, n: int = 1_000_000, dim: int = 10, queries: int = 100, depth: int = 2000) -> DataFrame:
    """(query_id, overlap, ratio, seconds): the fast projection index with 2 * dim directions and 4 * depth places against
    exact search by expansion; ``overlap`` is a share of ``depth``, ``ratio`` that of the radii, ``seconds`` a query's."""
    points = keep(spark, generate.normal(spark, n, dim, seed=1), "points")
    asked = keep(spark, _asked(generate.normal(spark, queries, dim, seed=2)), "queries")
    exact = keep(spark, search.expansion(points, asked, depth).withColumn("distance", F.sqrt("distance")), "exact")
    index = search.FastIndex(points, bases.gaussian(2 * dim, dim, seed=3, unit=True), 4 * depth)
    began = time.time()
    found = keep(spark, index.search(asked, depth), "found")
    each = (time.time() - began) / queries
    return search.overlap(found, exact).join(search.radius_ratio(found, exact), "query_id").select("query_id", (F.col("overlap") / depth).alias("overlap"), "ratio", F.lit(each).alias("seconds"))


def brute_speed(spark: SparkSession, n: int = 10_000, dim: int = 250, queries: int = 100, tasks=(1, 2, 4, 8), limits=(1, 10, 50)) -> DataFrame:
    """(tasks, k, seconds): exact search by the number of tasks and of neighbours."""
    points = keep(spark, generate.normal(spark, n, dim, seed=1), "points")
    asked = keep(spark, _asked(generate.normal(spark, queries, dim, seed=2)), "queries")
    rows = [(t, k, _timed(search.expansion(points.repartition(t), asked, k))) for t in tasks for k in limits]
    return spark.createDataFrame(rows, "tasks int, k int, seconds double")


def sketch_grid(spark: SparkSession, n: int = 100_000, dim: int = 10, k: int = 20, splits=(1, 2, 4, 8), indexes=("brute", "projection", "hash")) -> DataFrame:
    """(splits, index, microseconds a row): the sketch over splits, by what centroids are kept in."""
    points = keep(spark, generate.normal(spark, n, dim, seed=1), "points")
    rows = [(s, i, 1e6 * _timed(cluster.split_kmeans(points, k, s, index=i)) / n) for s in splits for i in indexes]
    return spark.createDataFrame(rows, "splits int, index string, micros double")


def projection_scaling(spark: SparkSession, n: int = 10_000, queries: int = 20, k: int = 10, search_size: int = 100, dims=(5, 10, 20, 50, 100, 200, 500)) -> DataFrame:
    """(dim, distance_ratio, depth): search on one direction against exact search: the mean ratio of the nearest distances,
    and the mean rank of what it finds first, where that is among the exact ``k``."""
    out = None
    for dim in dims:
        points = keep(spark, generate.normal(spark, n, dim, seed=1), "points")
        asked = keep(spark, _asked(generate.normal(spark, queries, dim, seed=2)), "queries")
        found = keep(spark, search.single_projection(points, asked, k, bases.gaussian(1, dim, seed=3, unit=True)[0], search_size), "found")
        exact = keep(spark, search.brute(points, asked, k, dim=dim), "exact")
        both = search.distance_ratio(found, exact).join(search.rank_depth(found, exact), "query_id")
        row = both.agg(F.lit(dim).alias("dim"), F.avg("ratio").alias("distance_ratio"), F.avg("depth").alias("depth"))
        out = row if out is None else out.unionByName(row)
    return out


def sketch_quality(spark: SparkSession, n: int = 10_000, held: int = 1000, dim: int = 30, k: int = 20, splits=(1, 2, 4, 8, 16)) -> DataFrame:
    """(splits, centroids, rmse, approximate): held-out points replaced by their nearest centroid, by exact and by projection
    search."""
    every = keep(spark, generate.lumpy(spark, n + held, dim, radius=1.0, alpha=5.0, seed=1), "points")
    learnt, rest = every.filter(F.col("id") < n), every.filter(F.col("id") >= n)
    basis, out = bases.gaussian(4, dim, seed=3, unit=True), None
    for s in splits:
        centroids = keep(spark, cluster.split_kmeans(learnt, k, s), "centroids")
        row = cluster.rmse_both(rest, centroids, basis, 10).select(F.lit(s).alias("splits"), F.lit(centroids.count()).alias("centroids"), "rmse", "approximate")
        out = row if out is None else out.unionByName(row)
    return out


EXPERIMENTS = {f.__name__: f for f in (overlap, brute_speed, sketch_grid, projection_scaling, sketch_quality)}


def main(name: str, folder: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    files.write_report(EXPERIMENTS[name](spark), folder)


if __name__ == "__main__":
    main(*sys.argv[1:3])
