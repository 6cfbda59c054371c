"""Cells beyond what can be shipped: an upper tree that every task has, and lower trees that are a table.

The upper tree's cells are each split again by a tree of their own, made from a bounded
sample of the cell's points. Its leaves are rows (upper, cell, low, high): a point finds
its cell by an equi-join on the upper cell and a comparison with the bounds that splits
left, a query its routes by a walk down the upper tree and the same join with the boxes.
Joins of plain tables they are, so a hot upper cell's rows can be split over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import box_distance
from .cells import CellTree, split_sample

#: Points of the sample that a lower cell is made from, about.
POINTS_A_CELL = 64
#: The most cells, as their numbers are 32 bits.
MOST_CELLS = 1 << 30


def lower_trees(upper_celled: DataFrame, upper: CellTree, rows: int, wanted: int, policy: str) -> DataFrame:
    """(upper, cell, low, high): the leaves of the trees below each upper cell, about `wanted` in all, and what their splits
    leave them. `upper_celled` is (id, coords, cell) with the upper cell, `rows` of them."""
    each = -(-wanted // upper.cells)
    if upper.cells * each > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells cannot be numbered; cell_rows must be larger")
    share = min(1.0, POINTS_A_CELL * each * upper.cells / max(1, rows))
    sample = upper_celled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * share)).select("cell", "coords")
    dims = upper.dims

    def grow(bounds: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = []
        for of, low, high in bounds[["of", "low", "high"]].itertuples(index=False, name=None):
            tree = split_sample(points["coords"].to_list(), each, dims, policy)
            for node in tree.nodes:
                if node.cell is not None:
                    out.append((of, of * each + node.cell, [max(a, b) for a, b in zip(low, node.low)], [min(a, b) for a, b in zip(high, node.high)]))
        return pd.DataFrame(out, columns=["upper", "cell", "low", "high"])

    bounds = upper.bounds(upper_celled.sparkSession)
    return bounds.groupBy("of").cogroup(sample.groupBy("cell")).applyInPandas(grow, "upper int, cell int, low array<double>, high array<double>")


def _within(dims: int) -> Column:
    """Whether `coords` lies where the splits left (low, high]."""
    inside = F.lit(True)
    for i in range(dims):
        inside = inside & (F.col("coords")[i] > F.col("low")[i]) & (F.col("coords")[i] <= F.col("high")[i])
    return inside


def with_lower_cell(upper_celled: DataFrame, lower: DataFrame, dims: int) -> DataFrame:
    """`upper_celled` with the cell of the lower tree in place of the upper one."""
    columns = upper_celled.columns
    rows = upper_celled.withColumnRenamed("cell", "upper_cell")
    met = rows.join(lower.select("upper", "cell", "low", "high"), (F.col("upper_cell") == F.col("upper")) & _within(dims))
    return met.select(columns)


def lower_routes(upper_routes: DataFrame, lower: DataFrame, boxes: DataFrame, dims: int, float32: bool = False) -> DataFrame:
    """(q, coords, bound, cell, near, place) of the lower cells within the bound of `upper_routes`, but for the query's own.
    All are visited in one round."""
    known = lower.join(boxes.select(F.col("cell").alias("boxed"), "lo", "hi"), F.col("cell") == F.col("boxed")).drop("boxed")
    rows = upper_routes.select("q", "coords", "bound", F.col("cell").alias("upper_cell"))
    met = rows.join(known, F.col("upper_cell") == F.col("upper")).where(~_within(dims))
    near = box_distance(*[[F.col(side)[i] for i in range(dims)] for side in ("coords", "lo", "hi")])
    slack = 1 - 1e-4 if float32 else 1.0  # what rounding to 32 bits may take
    return met.withColumn("near", near * slack).where("near <= bound").select("q", "coords", "bound", "cell", "near", F.lit(0).alias("place"))
