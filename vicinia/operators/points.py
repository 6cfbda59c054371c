"""Tables of points: an id and coordinates, as (id BIGINT, coords ARRAY<DOUBLE>)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points(df: DataFrame, id_column: str, coordinates: str | Sequence[str], invalid: str = "raise", dims: int | None = None) -> DataFrame:
    """(id, coords) from an array column or from a list of numeric columns.

    A row is invalid if its id, its coordinates or one of them is null, or one is not finite, or if it has not `dims` of
    them where that is given; such rows are dropped, or the query that meets one fails. (A point at infinity has no
    distance to itself, so it could not be its own neighbour.)
    """
    coords = F.col(coordinates).cast("array<double>") if isinstance(coordinates, str) else F.array(*[F.col(c).cast("double") for c in coordinates])
    out = df.select(F.col(id_column).cast("long").alias("id"), coords.alias("coords"))
    bad = F.col("id").isNull() | F.col("coords").isNull() | F.exists("coords", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dims is not None:
        bad = bad | (F.size("coords") != dims)
    bad = F.coalesce(bad, F.lit(True))
    if invalid == "drop":
        return out.where(~bad)
    if invalid != "raise":
        raise ValueError("invalid must be raise or drop")
    checked = F.when(bad, F.raise_error(F.lit("a point has no id, or a coordinate that is null or NaN or infinite, or too few"))).otherwise(F.col("coords"))
    return out.withColumn("coords", checked.cast("array<double>"))


def columns_of(pts: DataFrame, dims: int) -> DataFrame:
    """(id, x0, x1, ...): one column a dimension, for few dimensions."""
    return pts.select("id", *[F.element_at("coords", i + 1).alias(f"x{i}") for i in range(dims)])


def random_points(spark, n: int, dims: int, seed: int = 0) -> DataFrame:
    """`n` points, uniform in the unit cube."""
    return spark.range(n).select("id", F.array(*[F.rand(seed + i) for i in range(dims)]).alias("coords"))
