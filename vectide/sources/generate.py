"""Seeded synthetic points. Each row's noise depends on (seed, id) alone, whatever the partitioning."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *keys: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def noise(dim: int, seed: int, id: str = "id") -> Column:
    """An array of independent standard normal numbers, by two seeded uniforms each."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.log(_uniform(seed, F.col(id), i))) * F.cos(2 * np.pi * _uniform(seed + 1, F.col(id), i)))


def normal(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """n points of independent N(0, 1) components."""
    return spark.range(n).select("id", F.lit(1.0).alias("w"), noise(dim, seed).alias("v"))


def corners(spark: SparkSession, dim: int) -> DataFrame:
    """The corners of the unit cube; the first component is the highest bit of the id."""
    bits = F.transform(F.sequence(F.lit(dim - 1), F.lit(0)), lambda i: F.col("id").bitwiseAND(F.pow(F.lit(2), i).cast("long")).cast("boolean").cast("double"))
    return spark.range(2**dim).select("id", F.lit(1.0).alias("w"), bits.alias("v"))


def hypercube(spark: SparkSession, n: int, dim: int, radius: float = 0.01, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(points, means): point i is normal noise of that radius around corner i modulo 2^dim."""
    corner = F.transform(F.sequence(F.lit(dim - 1), F.lit(0)), lambda i: F.pmod(F.col("id"), F.lit(2**dim)).bitwiseAND(F.pow(F.lit(2), i).cast("long")).cast("boolean").cast("double"))
    around = F.zip_with(corner, noise(dim, seed), lambda c, e: c + e * radius)
    return spark.range(n).select("id", F.lit(1.0).alias("w"), around.alias("v")), corners(spark, dim)


def _frame(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, 1.0, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, w double, v array<double>")


def lumpy(spark: SparkSession, n: int, dim: int, radius: float = 0.05, alpha: float = 10.0, seed: int = 0) -> DataFrame:
    """Points around centres that a Chinese restaurant process opens; a driver-side fixture, sequential by nature."""
    rng = np.random.default_rng(seed)
    centres, sizes, rows = [], [], np.empty((n, dim))
    for i in range(n):
        k = len(centres)
        pick = rng.random() * (i + alpha)
        if pick >= i or not k:
            centres.append(rng.normal(size=dim))
            sizes.append(0)
        else:
            k = int(np.searchsorted(np.cumsum(sizes), pick, "right"))
        sizes[k] += 1
        rows[i] = centres[k] + radius * rng.normal(size=dim)
    return _frame(spark, rows)


def cubish(spark: SparkSession, radius: float = 0.01, dim: int = 10, axes: int = 5, seed: int = 0) -> DataFrame:
    """100 points around the origin and 1000 around six times each of the first unit vectors."""
    centre = F.when(F.col("id") < 100, -1).otherwise(F.floor((F.col("id") - 100) / 1000))
    at = F.zip_with(F.sequence(F.lit(0), F.lit(dim - 1)), noise(dim, seed), lambda i, e: F.when(i == centre, 6.0).otherwise(0.0) + e * radius)
    return spark.range(100 + 1000 * axes).select("id", F.lit(1.0).alias("w"), at.alias("v"))


def grid(spark: SparkSession) -> DataFrame:
    """The eight corners of a box of sides 0.5, 2 and 1."""
    return _frame(spark, np.array(list(itertools.product((0, 0.5), (0, 2), (0, 1))), float))


def perturbed(queries: DataFrame, sigma: float = 0.01, seed: int = 0) -> DataFrame:
    """Queries with normal noise."""
    dim = queries.select(F.size("q")).first()[0]
    return queries.select("query_id", F.zip_with("q", noise(dim, seed, "query_id"), lambda x, e: x + e * sigma).alias("q"))
