"""The whole run: read points, describe them, put them into cells, find neighbours, cluster them on demand, and write all of it.

The points are read once and staged; one tree is built, written, and searched. Every
phase's rows are counted by the pass that it makes anyway, and so is whether each point
lies within its cell.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import KnnConfig
from ..operators.cells import CellTree, cell_offsets, with_cell
from ..operators.clusters import density_clusters
from ..operators.knn import PRUNED_DIMS, knn, partition, prepare
from ..operators.points import points
from ..operators.stats import mean_std
from ..operators.topk import nested
from ..sources import read_points, write_cells, write_nodes, write_table
from ..staging import scope, staged


@dataclass
class Run:
    """`phases`: (phase, rows, seconds) in order; `clusters`: (query_id, cluster, label, halo), where asked for."""

    stats: DataFrame
    tree: CellTree
    offsets: DataFrame
    neighbours: DataFrame
    phases: DataFrame
    clusters: DataFrame | None = None


class Phases:
    """Tables staged with their rows counted on the way, and how long each took."""

    def __init__(self, spark: SparkSession):
        self.spark, self.told = spark, []

    def stage(self, df: DataFrame, name: str, **counted) -> tuple[DataFrame, dict]:
        """`df`, staged, and what was counted of its rows as they were written."""
        seen, began = Observation(name), time.perf_counter()
        out = staged(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counted.items()]), name)
        self.told.append((name, int(seen.get["rows"]), time.perf_counter() - began))
        return out, seen.get

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.told, "phase string, rows long, seconds double")


def misplaced(celled: DataFrame, tree: CellTree) -> DataFrame:
    """`celled` with `outside`: whether the point is not where its cell's splits put it."""
    bounds = F.broadcast(tree.bounds(celled.sparkSession))  # a row a cell of a shipped tree
    inside = F.forall(F.arrays_zip("coords", "low", "high"), lambda z: (z["coords"] > z["low"]) & (z["coords"] <= z["high"]))
    return celled.join(bounds, F.col("cell") == F.col("of"), "left").select(*celled.columns, (~F.coalesce(inside, F.lit(False))).alias("outside"))


def run(spark: SparkSession, path: str, config: KnnConfig, out: str | None = None, mode: str = "errorifexists", assignment: str | None = None) -> Run:
    """Neighbours of the raw points at `path`; below `out`, if given: points by cell, nodes, nested neighbours, statistics
    and phases. With `assignment`, points are clustered by density peaks, and their clusters are written there."""
    if config.dims is None:
        raise ValueError("dims is needed to read raw points")
    if assignment is not None and config.k < 5:
        raise ValueError("clusters need k of 5 or more")
    phases = Phases(spark)
    with scope(spark) as own:
        pts, seen = phases.stage(points(read_points(spark, path, config.dims, config.dtype), "id", "coords", config.invalid, config.dims), "points")
        total = seen["rows"]
        columns = [f"x{i}" for i in range(config.dims)]
        stats, _ = phases.stage(mean_std(pts.select(*[F.element_at("coords", i + 1).alias(c) for i, c in enumerate(columns)]), columns), "stats")
        tree = partition(pts, total, config.dims, config)
        celled, seen = phases.stage(misplaced(with_cell(pts, tree), tree), "cells", outside=F.count_if("outside"))
        if seen["outside"]:
            raise RuntimeError(f"{seen['outside']} points lie outside of their cells")
        celled = celled.drop("outside")
        # Beyond PRUNED_DIMS the search takes cells of pivots, and the tree is one cell.
        ready = prepare(pts, config.k, config, tree if config.dims <= PRUNED_DIMS else None)
        neighbours, _ = phases.stage(knn(pts, config.k, config, float32=config.compute == "f32", ready=ready), "neighbours")
        offsets, _ = phases.stage(cell_offsets(celled), "offsets")
        clusters = None
        if assignment is not None:
            clusters, _ = phases.stage(density_clusters(neighbours, total, config.dims, config.z), "clusters")
            write_table(clusters, assignment, mode)
        if out is not None:
            write_cells(celled, f"{out}/points", mode)
            write_nodes(tree, spark, f"{out}/nodes", mode)
            write_table(nested(neighbours), f"{out}/neighbours", mode)
            write_table(stats, f"{out}/stats", mode)
            write_table(phases.table(), f"{out}/phases", mode)
        for kept in (stats, neighbours, offsets, clusters):
            if kept is not None:
                own.keep(kept)
        return Run(stats, tree, offsets, neighbours, phases.table(), clusters)
