"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 if either vector is null or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(-1.0))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = norm(v)
    return F.transform(doubles(v), lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)))


def is_valid(v: Column, dim: int) -> Column:
    """Right length, no null, NaN or infinity, and not all zero."""
    finite = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & finite & (norm(v) > 0), F.lit(False))
