"""Raw point files: headerless rows of little-endian floats, row by row, as a Spark data source that reads and writes.

A task writes below `_pending`; what Spark commits is moved into the folder and listed,
and all else goes, so attempts that failed or came second leave nothing, and a job that
fails leaves what was there before. Files are read in ranges of rows through Arrow's file systems, so one of any size
is split over tasks. A point's id is its place in the files, taken in order of
their names; what is left over of a row at a file's end is ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..config import DTYPES

#: Bytes of a task's range, and rows of a batch.
RANGE, BATCH = 32 << 20, 1 << 14
#: A neighbour as it is packed, and the file that names the files of a folder that count.
PAIR, LISTED = np.dtype([("value", "<f8"), ("array_idx", "<u8")]), "_files"
#: Where files are until they are committed, in a folder for each job.
PENDING = "_pending"
#: The file that says how many pairs a query has, and, a fixed value, the id that stands for no neighbour.
LENGTH, NONE = "_length", 2**64 - 1


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class RawRange(InputPartition):
    def __init__(self, file: str, start: int, rows: int, first: int):
        self.file, self.start, self.rows, self.first = file, start, rows, first


class RawReader(DataSourceReader):
    kind_of = staticmethod(lambda options: np.dtype(DTYPES[options.get("dtype", "f64")]))

    def __init__(self, options: dict):
        self.path, self.dims, self.kind = options["path"], int(options["dims"]), self.kind_of(options)
        self.files = [f for f in options.get("files", "").split("\n") if f]
        self.range = int(options.get("range", RANGE))
        if self.dims < 1:
            raise ValueError("dims must be 1 or more")

    def partitions(self) -> list[RawRange]:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if not self.files and info.type == pyarrow.fs.FileType.Directory:
            self.files = written_files(self.path)
        if self.files:
            found = fs.get_file_info([f"{root}/{f}" for f in self.files])
        else:
            found = fs.get_file_info(pyarrow.fs.FileSelector(root)) if info.type == pyarrow.fs.FileType.Directory else [info]
        found = sorted((f for f in found if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)
        if not found and fs.get_file_info(f"{root}/{LISTED}").type == pyarrow.fs.FileType.File:
            return [RawRange(root, 0, 0, 0)]  # written without rows
        if not found:
            raise FileNotFoundError(self.path)
        row, out, first = self.dims * self.kind.itemsize, [], 0
        for f in found:
            rows, step = f.size // row, max(1, self.range // row)
            out += [RawRange(f.path, s, min(step, rows - s), first + s) for s in range(0, rows, step)]
            first += rows
        return out or [RawRange(found[0].path, 0, 0, 0)]

    def read(self, partition: RawRange) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        fs, _ = _open(self.path)
        width = self.dims * self.kind.itemsize
        with fs.open_input_file(partition.file) as source:
            for start in range(0, partition.rows, BATCH):
                n = min(BATCH, partition.rows - start)
                yield self.batch(source.read_at(n * width, (partition.start + start) * width), partition.first + start)

    def batch(self, data: bytes, first: int) -> pa.RecordBatch:
        numbers = np.frombuffer(data, self.kind).astype(np.float64)
        n = len(numbers) // self.dims
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.dims)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + first), pa.ListArray.from_arrays(offsets, pa.array(numbers))], names=["id", "coords"])


class Written(WriterCommitMessage):
    """A task's file below `_pending`, and how many rows it has."""

    def __init__(self, part: int, file: str, rows: int):
        self.part, self.file, self.rows = part, file, rows


class RawWriter(DataSourceArrowWriter):
    """Each partition as one file of what `pack` makes of its batches."""

    suffix = staticmethod(lambda options: options.get("dtype", "f64"))

    def __init__(self, options: dict):
        self.options, self.path, self.job = options, options["path"], uuid.uuid4().hex
        self.end = self.suffix(options)
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/{PENDING}/{self.job}", recursive=True)  # here and not by tasks, which could be late for an abort

    def pack(self, batch: pa.RecordBatch) -> bytes:
        return batch.column("coords").flatten().to_numpy(zero_copy_only=False).astype(DTYPES[self.end]).tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        part, rows = TaskContext.get().partitionId(), 0
        file = f"part-{part:06d}-{uuid.uuid4().hex}.{self.end}"
        with fs.open_output_stream(f"{root}/{PENDING}/{self.job}/{file}", compression=None) as out:
            for batch in iterator:
                out.write(self.pack(batch))
                rows += batch.num_rows
        return Written(part, file, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        names = [m.file for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.part)]
        for name in names:
            fs.move(f"{root}/{PENDING}/{self.job}/{name}", f"{root}/{name}")
        with fs.open_output_stream(f"{root}/{LISTED}", compression=None) as out:  # from here on they count
            out.write("\n".join(names).encode())
        self._clean(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_open(self.path))

    def _clean(self, fs: pyarrow.fs.FileSystem, root: str) -> None:
        pending = f"{root}/{PENDING}"
        for folder in (f"{pending}/{self.job}", pending):
            if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory and (folder != pending or not fs.get_file_info(pyarrow.fs.FileSelector(pending))):
                fs.delete_dir(folder)


class RawPoints(DataSource):
    """Options: path (a file or folder), dims, dtype (f32 or f64). Written are the `coords` of rows, in their order."""

    @classmethod
    def name(cls) -> str:
        return "rawpoints"

    def schema(self) -> str:
        return "id long, coords array<double>"

    def reader(self, schema) -> RawReader:
        return RawReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(dict(self.options))


def read_points(spark: SparkSession, path: str, dims: int, dtype: str = "f64", files: list[str] | None = None) -> DataFrame:
    """(id, coords) of the raw files at `path`."""
    if dtype not in DTYPES:
        raise ValueError(f"dtype must be one of {', '.join(DTYPES)}")
    spark.dataSource.register(RawPoints)
    reader = spark.read.format("rawpoints").option("dims", dims).option("dtype", dtype)
    return (reader.option("files", "\n".join(files)) if files else reader).load(path)


def written_files(path: str) -> list[str]:
    """The files that count of a folder that was written here; none where it was not."""
    fs, root = _open(path)
    if fs.get_file_info(f"{root}/{LISTED}").type != pyarrow.fs.FileType.File:
        return []
    with fs.open_input_stream(f"{root}/{LISTED}") as source:
        return [name for name in source.read().decode().split("\n") if name]


def write_points(pts: DataFrame, path: str, dtype: str = "f64") -> list[str]:
    """Write the coordinates in order of id, a file for each range of ids; the names of the files, in order.

    Only the names returned count. They are also kept beside the files, so that whoever reads the folder reads no others.
    """
    if dtype not in DTYPES:
        raise ValueError(f"dtype must be one of {', '.join(DTYPES)}")
    pts.sparkSession.dataSource.register(RawPoints)
    ordered = pts.select("id", "coords").repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.format("rawpoints").option("dtype", dtype).mode("append").save(path)
    return written_files(path)


def write_neighbours(nested: DataFrame, path: str, k: int | None = None) -> list[str]:
    """Write (query_id, neighbors) in order of query as packed (value f64, array_idx u64) pairs, `k` of each query, or as
    many as the longest list has; the names of the files. What a shorter list lacks is filled with NONE at an infinite
    distance. The number of pairs a query is kept beside the files."""
    longest = nested.agg(F.max(F.size("neighbors"))).first()[0] or 0
    k = longest if k is None else k
    if longest > k:
        raise ValueError(f"a list of {longest} neighbours does not fit into {k}")
    order = [c for c in ("query_id", "query_row") if c in nested.columns]
    nested.sparkSession.dataSource.register(RawPairs)
    flat = nested.select(*order, F.col("neighbors.value").alias("value"), F.col("neighbors.array_idx").alias("array_idx")).repartitionByRange(*order).sortWithinPartitions(*order)
    flat.write.format("rawpairs").option("k", k).mode("append").save(path)
    files = written_files(path)
    fs, root = _open(path)
    with fs.open_output_stream(f"{root}/{LENGTH}", compression=None) as out:
        out.write(str(k).encode())
    return files


def neighbours_a_query(path: str) -> int | None:
    """How many pairs a query has in a folder that was written here."""
    fs, root = _open(path)
    if fs.get_file_info(f"{root}/{LENGTH}").type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{LENGTH}") as source:
        return int(source.read())


class RawPairReader(RawReader):
    kind_of = staticmethod(lambda options: PAIR)

    def batch(self, data: bytes, first: int) -> pa.RecordBatch:
        pairs = np.frombuffer(data, self.kind)
        ids = pa.array(np.arange(len(pairs), dtype=np.int64) + first)
        return pa.RecordBatch.from_arrays([ids, pa.array(pairs["value"].copy()), pa.array(pairs["array_idx"].astype(np.int64))], names=["id", "d2", "neighbor_id"])


class RawPairWriter(RawWriter):
    """Lists (value, array_idx), each filled up to the option `k`."""

    suffix = staticmethod(lambda options: "ngbh")

    def pack(self, batch: pa.RecordBatch) -> bytes:
        k = int(self.options["k"])
        out = np.empty((batch.num_rows, k), PAIR)
        out["value"], out["array_idx"] = np.inf, NONE
        lengths = np.array([len(v) for v in batch.column("value")], np.int64)
        row, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        for c in PAIR.names:
            out[c][row, place] = batch.column(c).flatten().to_numpy(zero_copy_only=False)
        return out.tobytes()


class RawPairs(DataSource):
    """Packed neighbours; options: path, and for writing k, the pairs of a query."""

    @classmethod
    def name(cls) -> str:
        return "rawpairs"

    def schema(self) -> str:
        return "id long, d2 double, neighbor_id long"

    def reader(self, schema) -> RawReader:
        return RawPairReader({**self.options, "dims": 1})

    def writer(self, schema, overwrite: bool) -> RawPairWriter:
        return RawPairWriter(dict(self.options))


def read_neighbours(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(place, neighbor_id, d2, rank) of packed neighbours; a query is its place in order. `k` is needed where the folder does
    not say how many pairs a query has."""
    told = neighbours_a_query(path)
    if k is None and told is None:
        raise ValueError("k is needed: the folder does not say how many neighbours a query has")
    if k is not None and told is not None and k != told:
        raise ValueError(f"the folder has {told} neighbours a query, not {k}")
    k = max(1, told if k is None else k)
    spark.dataSource.register(RawPairs)
    pairs = spark.read.format("rawpairs").load(path).where(F.col("neighbor_id") != int(np.uint64(NONE).astype(np.int64)))
    return pairs.select(F.floor(F.col("id") / k).alias("place"), "neighbor_id", "d2", (F.col("id") % k + 1).cast("int").alias("rank"))
