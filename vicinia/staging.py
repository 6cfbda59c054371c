"""Tables written once to the folder that driver and executors share, so later steps neither recompute them nor depend on executors.

What nothing reads any longer can go: `release` deletes a staged table whose successors
are written, a `scope` deletes at its end all that was written inside of it, in its own
thread, but for what it was told to keep, and `clear` all that the application wrote.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: The folders that each application has written and not deleted, and those of staged tables.
_MADE: dict[str, dict[str, None]] = {}
_STAGED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


class Scope:
    """The folders written inside of a `with scope(spark)` block; those of another thread, or of a block within, are not among them."""

    def __init__(self, spark: SparkSession, outer: Scope | None):
        self.spark, self.outer, self.paths = spark, outer, {}

    def keep(self, table: DataFrame) -> DataFrame:
        """`table`, whose folder now outlives the block; it belongs to the block around it, if there is one."""
        path = _STAGED.get(table)
        if path in self.paths:
            del self.paths[path]
            if self.outer is not None:
                self.outer.paths[path] = None
        return table

    def close(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths.clear()


_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """A block whose staged tables are deleted at its end, be it by an error; lazy results that still read one must be staged and kept."""
    own = Scope(spark, _SCOPE.get())
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)
        own.close()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-vicinia-')}"
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/vicinia/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, {})[path] = None
    if (own := _SCOPE.get()) is not None:
        own.paths[path] = None
    return path


def left(spark: SparkSession) -> list[str]:
    """The folders that the application has written and not deleted."""
    return list(_MADE.get(spark.sparkContext.applicationId, {}))


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """`df`, written and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete the folder of a `scratch_path`."""
    made = _MADE.get(spark.sparkContext.applicationId, {})
    if path in made:
        del made[path]
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any longer."""
    for table in tables:
        if (path := _STAGED.pop(table, None)) is not None:
            discard(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that the application has written; results that still read it are lost."""
    for path in left(spark):
        discard(spark, path)
