"""Weighted points as DataFrames, and the maintenance that every index shares.

points: id BIGINT, w DOUBLE, v ARRAY<DOUBLE>. An index never changes in place: adding and removing give a new
DataFrame, as bags keyed by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vec


def points(df: DataFrame, id: str = "id", v: str = "v", w: str | None = None) -> DataFrame:
    """Rows as points; weight 1 where no column gives it."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    return df.select(F.col(id).cast("long").alias("id"), weight.alias("w"), F.col(v).cast("array<double>").alias("v"))


def validated(df: DataFrame, dim: int) -> DataFrame:
    """Points without null vectors; a vector of another size is an error."""
    return df.filter("v is not null").withColumn("v", vec.checked("v", dim))


def dimension(df: DataFrame) -> int | None:
    """The size of any one vector; None for no points."""
    row = df.select(F.size("v").alias("d")).first()
    return row["d"] if row else None


def add(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.unionByName(more)


def add_rows(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """Append matrix rows as points of weight one; the row number is the id."""
    return df.unionByName(matrix.select("id", F.lit(1.0).alias("w"), "v"))


def total_weight(df: DataFrame, w: str = "w") -> DataFrame:
    return df.agg(F.sum(F.coalesce(F.col(w), F.lit(1.0))).alias("total_weight"))


def remove_nearest(df: DataFrame, target: list[float], epsilon: float, metric: str = "euclidean", first: str = "id") -> DataFrame:
    """Delete at most one point closer than ``epsilon``: the smallest id, or the nearest with ``first="distance"``."""
    near = df.select("id", vec.distance(metric, "v", vec.literal(target)).alias("d")).filter(F.col("d") < epsilon)
    order = ("d", "id") if first == "distance" else ("id",)
    return df.join(near.orderBy(*order).limit(1).select("id"), "id", "left_anti")


def remove_equal(df: DataFrame, victims: DataFrame) -> DataFrame:
    """Delete every point whose vector equals one of the victims'."""
    return df.join(victims.select("v").distinct(), "v", "left_anti").select(*df.columns)


def within(df: DataFrame, queries: DataFrame, epsilon: float, metric: str = "euclidean", dim: int | None = None) -> DataFrame:
    """Pairs (query_id, id, distance) closer than ``epsilon``."""
    from vectide.operators.search import TERMS, measured, paired

    if dim and metric in TERMS:
        return measured(df, queries, {"distance": metric}, dim, lambda d, ids: d < epsilon).filter("distance is not null")
    return paired(df, queries).select("query_id", "id", vec.distance(metric, "q", "v", dim).alias("distance")).filter(F.col("distance") < epsilon)
