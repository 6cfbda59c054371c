"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import skew
from ._common import hot_keys, release, spread_join, staged


def _hubs(edges: DataFrame, end: str, n: int) -> list[tuple]:
    return hot_keys(edges.groupBy(end).agg(F.count(F.lit(1)).alias("n")), n) if n > skew.FEW else []


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours are tied to its least one; the neighbours of a hub are dealt over tasks. `n`: edges there are."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
    met = spread_join(both.where("b > a"), least, ["a"], ["u"], "b", _hubs(edges, "b", n))
    return met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of those, a hub's by several tasks. `edges` go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    met = spread_join(edges, least, ["a"], ["u"], "b", _hubs(edges, "a", n))
    moved = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _round(edges: DataFrame, n: int, name: str) -> DataFrame:
    turned = _large_star(edges, n)
    if n > skew.FEW:  # it is read twice, for its hubs too
        turned = staged(turned, name)
    out = staged(_small_star(turned, n), name)
    release(edges, turned)
    return out


def _ended(edges: DataFrame) -> tuple[int, bool]:
    """How many `edges` there are, and whether they are stars already: every larger end has one edge and is no edge's smaller end."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, between = nodes.agg(F.sum("up"), F.count(F.when(F.col("up") + F.col("down") > 1, 1))).first()
    return n or 0, not between


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the (a, b) `edges`: the least node that it reaches.

    Each round is written to the shared folder; rounds end when all edges form stars around the least nodes.
    """
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not (state := _ended(now))[1]:
        now = _round(now, state[0], name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
