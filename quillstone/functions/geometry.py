"""Distances between points held as arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(column: str, point: Sequence[float]) -> Column:
    """Squared Euclidean distance; one term per dimension keeps it inside generated code."""
    total = F.lit(0.0)
    for i, x in enumerate(point):
        d = F.get(F.col(column), F.lit(i)).cast("double") - F.lit(float(x))
        total = total + d * d
    return total


def distance(column: str, point: Sequence[float]) -> Column:
    return F.sqrt(squared_distance(column, point))


def in_box(column: str, point: Sequence[float], radius: float) -> Column:
    """The axis-aligned box around a ball: cheap terms that reject most rows."""
    out = F.size(column) == len(point)
    for i, x in enumerate(point):
        out = out & F.get(F.col(column), F.lit(i)).between(float(x) - radius, float(x) + radius)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)
