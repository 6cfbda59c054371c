"""python -m vicinia -i POINTS -t f32|f64 -d DIMS [-k K] [-o OUT] [-a CLUSTERS [-z Z]]: nearest neighbours and clusters of raw points."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import DEFAULT_K, DEFAULT_Z, DTYPES, KnnConfig
from .plans.pipeline import run
from .staging import scope


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("vicinia", description="Exact nearest neighbours of every point of a raw file.")
    parser.add_argument("-i", "--in-data", required=True, help="a raw file of points, or a folder of such files")
    parser.add_argument("-t", "--dtype", required=True, choices=sorted(DTYPES), help="the type of its numbers")
    parser.add_argument("-d", "--in-dims", required=True, type=int, help="how many of them a point has")
    parser.add_argument("-o", "--out-data", help="a folder for points by cell, nodes, neighbours and statistics")
    parser.add_argument("-k", "--kngbh", type=int, default=DEFAULT_K, help="neighbours of each point, itself among them")
    parser.add_argument("-a", "--out-assignment", help="a folder for the density-peak cluster of each point: label n if it is core, -n - 1 if it is halo")
    parser.add_argument("-z", "--z", type=float, default=DEFAULT_Z, help="how many errors a peak has to stand out by")
    parser.add_argument("--cell-rows", type=int, default=KnnConfig.cell_rows, help="points that a cell is meant to hold")
    parser.add_argument("--block-rows", type=int, default=KnnConfig.block_rows, help="points that meet others at once in a task")
    parser.add_argument("--policy", choices=["widest", "round_robin"], default=KnnConfig.policy, help="how the dimension of a split is chosen")
    parser.add_argument("--compute", choices=sorted(DTYPES), default=KnnConfig.compute, help="the precision of distances")
    parser.add_argument("--invalid", choices=["raise", "drop"], default=KnnConfig.invalid, help="what becomes of points that are not finite")
    parser.add_argument("--overwrite", action="store_true")
    given = parser.parse_args(args)
    config = KnnConfig(k=given.kngbh, dims=given.in_dims, dtype=given.dtype, compute=given.compute, policy=given.policy, cell_rows=given.cell_rows, block_rows=given.block_rows, invalid=given.invalid, z=given.z)
    spark = SparkSession.builder.appName("vicinia").getOrCreate()
    with scope(spark):
        done = run(spark, given.in_data, config, given.out_data, "overwrite" if given.overwrite else "errorifexists", given.out_assignment)
        done.stats.show(truncate=False)
        if given.out_data is None:
            done.neighbours.show()


if __name__ == "__main__":
    main()
