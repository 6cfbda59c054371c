"""The k nearest of each query, from rows of (query_id, neighbor_id, d2).

Where ids repeat, a column `query_row`, as `knn` gives it on demand, tells the queries
of one id apart; everything here goes by both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def query_keys(rows: DataFrame) -> list[str]:
    """The columns that a query is known by."""
    return ["query_id", "query_row"] if "query_row" in rows.columns else ["query_id"]


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The first `k` rows of each query by (d2, neighbor_id), with their rank from 1; each task keeps k of its own before the shuffle."""
    keys = query_keys(pairs)
    order = Window.partitionBy(*keys).orderBy("d2", "neighbor_id")
    return pairs.select(*keys, "neighbor_id", "d2").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_top_k(tables: list[DataFrame], k: int, disjoint: bool = False) -> DataFrame:
    """The top k of several top-k tables.

    Tables of bases that overlap may name one neighbour each: it counts as often as the table that names it most, so points
    of a base that share id and distance stay. With `disjoint` no point is in two bases, and every row is one of its own.
    """
    keys = [*query_keys(tables[0]), "neighbor_id", "d2"]
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    rows = None
    for table in tables:
        own = table.select(keys) if disjoint else table.select(*keys, again.alias("again"))
        rows = own if rows is None else rows.unionByName(own)
    return top_k(rows if disjoint else rows.distinct(), k)


def nested(neighbours: DataFrame) -> DataFrame:
    """(query_id, neighbors): one row a query, its neighbours as an array of (value, array_idx) in order."""
    by_rank = F.array_sort(F.collect_list(F.struct("rank", F.col("d2").alias("value"), F.col("neighbor_id").alias("array_idx"))))  # k at most
    return neighbours.groupBy(*query_keys(neighbours)).agg(F.transform(by_rank, lambda r: F.struct(r["value"].alias("value"), r["array_idx"].alias("array_idx"))).alias("neighbors"))


def flat(nested_neighbours: DataFrame) -> DataFrame:
    """`nested` undone."""
    keys = query_keys(nested_neighbours)
    return nested_neighbours.select(*keys, F.posexplode("neighbors").alias("pos", "n")).select(*keys, F.col("n.array_idx").alias("neighbor_id"), F.col("n.value").alias("d2"), (F.col("pos") + 1).alias("rank"))


def sorted_neighbours(neighbours: DataFrame) -> DataFrame:
    """Neighbours of each query in order of (d2, neighbor_id), queries together in a partition."""
    keys = query_keys(neighbours)
    return neighbours.repartition(*keys).sortWithinPartitions(*keys, "d2", "neighbor_id")
