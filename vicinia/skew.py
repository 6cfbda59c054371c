"""Joins whose keys may be hot: a key that holds much of all rows is dealt over several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: A key with more than one part in PARTS of all rows, and more than LEAST, is dealt over several tasks. There can be no
#: more than PARTS such keys, so they are known to the driver and to every task.
PARTS, LEAST = 4096, 64
#: Rows in all up to which no key is looked for.
FEW = 1024


def hot_keys(counts: DataFrame, total: int | None = None) -> list[tuple]:
    """(key columns..., tasks) of the hot keys of `counts` (key columns, then how many rows have them, `total` in all): PARTS
    at most."""
    *keys, n = counts.columns
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    if total <= FEW:
        return []
    each = max(total // PARTS, LEAST)
    return [tuple(r) for r in counts.where(F.col(n) > each).select(*keys, F.ceil(F.col(n) / each).cast("int")).collect()]


def spread_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], by: str, hot: list[tuple], how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which has a row a key. The rows of `hot` keys are dealt over tasks by the hash of the
    column `by`, and the row that they meet is repeated for each of those tasks."""
    on = [F.col(a) == F.col(b) for a, b in zip(left_on, right_on, strict=True)]
    if hot:
        sides = []
        for side, df, columns in (("l", left, left_on), ("r", right, right_on)):
            names = [f"__{side}_{c}" for c in columns]
            fields = [StructField(name, right.schema[c].dataType) for name, c in zip(names, right_on)]
            tasks = df.sparkSession.createDataFrame(hot, StructType([*fields, StructField(f"__{side}_tasks", IntegerType())]))
            marked = df.join(F.broadcast(tasks), [F.col(a) == F.col(b) for a, b in zip(columns, names)], "left")
            wide = F.coalesce(f"__{side}_tasks", F.lit(1))
            task = F.pmod(F.xxhash64(by), wide).cast("int") if side == "l" else F.explode(F.sequence(F.lit(0), wide - 1))
            sides.append(marked.select(*df.columns, task.alias(f"__{side}_task")))
        left, right = sides
        on.append(F.col("__l_task") == F.col("__r_task"))
    return left.join(right, on, how).drop("__l_task", "__r_task")
