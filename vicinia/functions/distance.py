"""Distances as Spark columns. All are squared; sums run from the first dimension to the last, so they repeat exactly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str


def _column(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sq_distance(a: Sequence[Name], b: Sequence[Name]) -> Column:
    """Squared Euclidean distance of two lists of columns: for few dimensions, all in generated code."""
    if not a or len(a) != len(b):
        raise ValueError("two lists of as many columns are needed")
    return reduce(lambda x, y: x + y, [(_column(p) - _column(q)) * (_column(p) - _column(q)) for p, q in zip(a, b)])


def sq_distance_arrays(a: Name, b: Name) -> Column:
    """Squared Euclidean distance of two array<double> columns; null if their lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def sq_distance_float32(a: Sequence[Name], b: Sequence[Name]) -> Column:
    """As `sq_distance`, every step rounded to 32 bits."""
    pairs = [(_column(p).cast("float"), _column(q).cast("float")) for p, q in zip(a, b, strict=True)]
    return reduce(lambda x, y: (x + y).cast("float"), [((p - q).cast("float") * (p - q).cast("float")).cast("float") for p, q in pairs])


def box_distance(point: Sequence[Name], low: Sequence[Name], high: Sequence[Name]) -> Column:
    """Squared distance of a point to a box, 0 inside."""
    over = [F.greatest(_column(lo) - _column(x), F.lit(0.0), _column(x) - _column(hi)) for x, lo, hi in zip(point, low, high, strict=True)]
    return reduce(lambda x, y: x + y, [o * o for o in over])


def hyperplane_offset(x: Name, split: Name | float) -> Column:
    """Signed distance of a coordinate to a split."""
    return _column(x) - (F.lit(split) if isinstance(split, (int, float)) else _column(split))


def right_of(x: Name, split: Name | float) -> Column:
    """Which side of a split a coordinate is on: right beyond it, left at it."""
    return hyperplane_offset(x, split) > 0
