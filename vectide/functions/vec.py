"""Scalar functions of dense vectors (``ARRAY<DOUBLE>`` columns) as Column expressions.

With ``dim`` given, an expression is written out per component and runs inside whole-stage codegen; without
it, higher-order functions fold over arrays of any length in the same order, so both give the same bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Column | str


def _col(v: Vec) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _fold(a: Vec, b: Vec, each: Callable[[Column, Column], Column], dim: int | None) -> Column:
    a, b = _col(a), _col(b)
    if dim:
        return reduce(lambda x, y: x + y, (each(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(dim)))
    return F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda s, x: s + x)


def dot(a: Vec, b: Vec, dim: int | None = None) -> Column:
    return _fold(a, b, lambda x, y: x * y, dim)


def sq_l2(a: Vec, b: Vec, dim: int | None = None) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y), dim)


def l2(a: Vec, b: Vec, dim: int | None = None) -> Column:
    return F.sqrt(sq_l2(a, b, dim))


def manhattan(a: Vec, b: Vec, dim: int | None = None) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y), dim)


def norm2(v: Vec, dim: int | None = None) -> Column:
    """Squared length."""
    return dot(v, v, dim)


def norm(v: Vec, dim: int | None = None) -> Column:
    return F.sqrt(norm2(v, dim))


def norm1(v: Vec) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + F.abs(x))


def cosine(a: Vec, b: Vec, dim: int | None = None) -> Column:
    """Cosine of the angle; null where a vector has no length."""
    return F.try_divide(dot(a, b, dim), F.sqrt(norm2(a, dim) * norm2(b, dim)))


def cosine_distance(a: Vec, b: Vec, dim: int | None = None) -> Column:
    return F.lit(1.0) - cosine(a, b, dim)


def add(a: Vec, b: Vec) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def subtract(a: Vec, b: Vec) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def scale(v: Vec, by: Column) -> Column:
    return F.transform(_col(v), lambda x: x * by)


def normalize(v: Vec) -> Column:
    """Unit vector; components are null where the vector has no length."""
    length = norm(v)
    return F.transform(_col(v), lambda x: F.try_divide(x, length))


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


#: Metrics by name; ``register`` adds more. Each takes (a, b, dim) and returns a Column.
METRICS: dict[str, Callable[..., Column]] = {"euclidean": l2, "sqeuclidean": sq_l2, "manhattan": manhattan, "cosine": cosine_distance}


def register(name: str, metric: Callable[..., Column]) -> None:
    METRICS[name] = metric


def distance(metric: str | Callable[..., Column], a: Vec, b: Vec, dim: int | None = None) -> Column:
    return (METRICS[metric] if isinstance(metric, str) else metric)(a, b, dim)


def checked(v: Vec, dim: int) -> Column:
    """The vector, or an error that names the first wrong size."""
    v = _col(v)
    return F.when(F.assert_true(F.size(v) == dim, F.concat(F.lit(f"a vector of {dim} is needed, got "), F.size(v).cast("string"))).isNull(), v)


# --- sign hashes ------------------------------------------------------------------------------------------


def sign_hash(v: Vec, basis: list[list[float]]) -> Column:
    """Bit i says whether the vector lies strictly on the positive side of basis vector i; up to 64 bits."""
    bits = [F.when(dot(v, literal(b)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i, b in enumerate(basis)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def hamming(a: Vec, b: Vec) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def masked(h: Vec, bits: int = 64) -> Column:
    """The low ``bits`` bits of a hash."""
    return _col(h) if bits >= 64 else _col(h).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
