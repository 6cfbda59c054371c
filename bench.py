"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one line of JSON.

Each query runs once cold and then once warm; `queries` holds the warm seconds, `cold` the cold ones. The phases of
the two-phase search are timed by themselves, and the two-phase plan against the one without cells.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from vicinia import queries as core
from vicinia.config import KnnConfig
from vicinia.operators.cells import sample_tree, with_cell
from vicinia.operators.knn import knn, locations

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["stats_mean_std", "histogram20", "cell_assignment", "route_pairs", "knn_self_array", "knn_self_columns", "knn_two_phase_2d", "knn_two_phase_5d", "knn_ties", "knn_query_vs_base", "knn_radius", "raw_round_trip"]


def session() -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.files.maxPartitionBytes": "8m"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = session()
    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = timed(lambda: core.QUERIES[name](spark, SF))
        warm[name] = timed(lambda: core.QUERIES[name](spark, SF))
    points = core.part2(spark, SF)
    tree = sample_tree(points, 64, 2)
    phases = {
        "load": timed(lambda: points),
        "cells": timed(lambda: with_cell(points, tree)),
        "locations": timed(lambda: locations(points, 10)),
        "knn_part2_k10_cells": timed(lambda: knn(points, 10)),
        "knn_part2_k10_one_cell": timed(lambda: knn(points, 10, KnnConfig(cell_rows=1 << 30))),
        "knn_part2_k300_cells": timed(lambda: knn(points, 300)),
    }
    print(json.dumps({"metric": "total warm seconds of the headline queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "phases": phases, "sf": os.path.basename(SF.rstrip("/"))}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
