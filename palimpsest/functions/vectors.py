"""Distances of dense vectors, as Column expressions for small sides and tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def inner(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector has no length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size >= 1e-10), inner(a, b) / size).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    """Unit length; a vector of (nearly) no length stays as it is."""
    size = norm(a)
    return F.when(size * size < 1e-10, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / size))
