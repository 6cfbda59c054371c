"""Where results go: tables by cell, neighbours, and the nodes of a tree as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import CellTree


def write_cells(celled: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Points as Parquet, a folder for each cell. Points are ranged by (cell, id): a task holds a few cells or a part of one."""
    celled.repartitionByRange("cell", "id").write.mode(mode).partitionBy("cell").parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def node_lines(tree: CellTree, spark: SparkSession) -> DataFrame:
    """(place, line): level, owner, split_dim, split_val, then the lower and the upper bounds, comma-separated, in preorder."""
    nodes = tree.table(spark)
    fields = ["level", "owner", "split_dim", "split_val"]
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in fields], F.col("lb").cast("array<string>"), F.col("ub").cast("array<string>"))
    return nodes.select("place", line.alias("line"))


def write_nodes(tree: CellTree, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
    """One text file, without a header; a tree has few nodes."""
    node_lines(tree, spark).coalesce(1).sortWithinPartitions("place").select("line").write.mode(mode).text(path)
