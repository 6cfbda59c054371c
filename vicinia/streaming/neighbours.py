"""Nearest neighbours for a stream of queries against a fixed base; an extension, as batches are what the rest is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import KnnConfig
from ..operators.knn import knn_join, prepare
from ..staging import scope


def stream_knn(queries: DataFrame, base: DataFrame, k: int, path: str, checkpoint: str, config: KnnConfig = KnnConfig(), trigger: dict | None = None) -> StreamingQuery:
    """Write the neighbours of each micro-batch of `queries` (id, coords) below `path`, a folder for each batch.

    The base is prepared once, and is there until its owner releases it. A batch that is run again after a failure replaces
    its folder, so each query's rows are there once; what a batch stages is deleted once its rows are written.
    """
    ready = prepare(base, k, config)

    def batch(some: DataFrame, number: int) -> None:
        with scope(some.sparkSession):
            knn_join(some, base if ready is None else ready, k, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
