"""Seeded Gaussian directions, as numbers, as a DataFrame and as SQL."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession


def gaussian(count: int, dim: int, seed: int = 1, unit: bool = False) -> list[list[float]]:
    """``count`` directions with independent normal components; of length one if ``unit``."""
    rng = random.Random(seed)
    rows = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(count)]
    if unit:
        rows = [[x / math.sqrt(sum(y * y for y in r)) for x in r] for r in rows]
    return rows


def frame(spark: SparkSession, basis: list[list[float]]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(basis)), "basis_id int, bv array<double>")


def values(basis: list[list[float]]) -> str:
    """DuckDB rows (basis_id, bv, wt), wt being the bit's value in a 64-bit hash."""
    rows = []
    for i, b in enumerate(basis):
        weight = str(1 << i) if i < 63 else "(-9223372036854775807 - 1)"
        rows.append(f"({i}, [{', '.join(f'{x:.17e}' for x in b)}]::DOUBLE[], {weight}::BIGINT)")
    return "(VALUES " + ", ".join(rows) + ")"
