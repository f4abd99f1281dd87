"""Vector expressions over ``array<float>`` and ``array<double>`` columns, folded in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A stored vector this close to length 1 is left as it is.
UNIT_TOLERANCE = 1e-6


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Left fold of products; null elements of unequal lengths make the result null."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero, an error where lengths differ."""
    product = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(product == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(product != 0, product))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def unit(v: Column) -> Column:
    """Length 1, as float; zero and already-unit vectors stay untouched."""
    n = norm(v)
    scaled = F.transform(_doubles(v), lambda x: (x / n).cast("float"))
    return F.when((n == 0) | (F.abs(n - 1) < UNIT_TOLERANCE), v.cast("array<float>")).otherwise(scaled)


def truncate(v: Column, dims: int) -> Column:
    """The first ``dims`` dimensions, not normalised again."""
    return F.slice(v, 1, dims)


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def l2_to_cosine(distance: Column) -> Column:
    """Cosine of unit vectors from their Euclidean distance."""
    return 1 - distance * distance / 2
