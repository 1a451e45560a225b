"""Radius and nearest-neighbour search over array columns.

Both are single scans: the radius filter has box terms before the exact distance; the nearest rows
come from per-task top-k lists, so only k rows per task move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance, in_box


def within(df: DataFrame, column: str, point: Sequence[float], radius: float) -> DataFrame:
    """Rows at most radius away; a negative radius or another dimension finds none."""
    return df.where(in_box(column, point, radius) & (distance(column, point) <= float(radius)))


def nearest(df: DataFrame, column: str, point: Sequence[float], k: int, key: str) -> DataFrame:
    """The k nearest rows, nearest first, ties by key; k below one or another dimension finds none."""
    near = df.where(F.size(column) == len(point)).withColumn("_distance", distance(column, point))
    return near.orderBy("_distance", key).limit(max(0, k)).drop("_distance")
