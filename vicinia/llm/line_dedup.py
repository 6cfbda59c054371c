"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed, sorted table of (h1, h2, n): 128 bits of a line's key and
the number of documents seen with it. Every batch of documents is counted,
merge-anti-joined with the keys that are already known to be frequent, and
added as a run of its own; when a level holds `fanout` runs they are compacted
by one merge aggregation into a run of the next level, which is written once: its
keys that have reached the threshold are the frequent ones, and the next merge leaves
them out as it reads. All tables are bucketed alike, so
a merge of two runs takes no shuffle: a task reads one bucket of each, puts their
rows in order (Spark sorts again what is sorted already) and writes that bucket of
the next run. (With a `fanout` above 2, the third run and every further one is met by
a shuffle of what is merged so far.) Their files lie in the shared folder, in as many
buckets as the keys' number asks for; runs are dropped at the end, be it an error.
Nothing depends on the batches' order or number but the work.

Nulls and edges: a null or empty text is one empty line with an empty key; with
`min_length` >= 1 that key is never dropped. Rows with a null or repeated doc_id
count as documents of their own. An empty table gives an empty result. Other
columns pass through, but for the two this adds.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, discard, fresh, release, scratch_path, staged, text_key, text_or_empty

BATCHES = 4
FANOUT = 2
#: Keys of a bucket, about, where there are more buckets than shuffle partitions.
BUCKET_KEYS = 1 << 21


def line_key(line: Column) -> Column:
    """A line without white space at its ends; A-Z is lowered beforehand, over the whole text."""
    return F.btrim(line, F.lit(SPACES))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def line_hashes(text: Column, min_length: int) -> Column:
    """Hash pairs of the lines of `text`, in order; null for a key that is too short to drop."""

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_length, text_key(key))

    return F.transform(F.split(lowered(text), "\n", -1), hashed)


class LineRuns:
    """The levelled runs. `add` takes (h1, h2, n) rows of one batch, each key once per partition or oftener."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.frequent: list[str] = []
        self.merged: set[str] = set()  # runs whose frequent keys are told apart: a merge leaves these out
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame, in_place: bool = False) -> str:
        """A run of `rows`; `in_place`, each task holds the rows of one bucket already."""
        name = f"{self.name}_{len(self.paths)}"
        self.paths[name] = scratch_path(self.spark, name)
        keys = ["h1", "h2"]  # both, as a join takes tables as co-located only where its keys are the buckets'
        (rows if in_place else rows.repartition(self.buckets, *keys)).write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, self.paths[name])

    def _read(self, name: str) -> DataFrame:
        rows = self.spark.table(name)
        return rows.where(F.col("n") < self.min_docs) if name in self.merged else rows

    def _union(self, names: list[str]) -> DataFrame:
        """The named runs' rows, bucket by bucket: each is read without a shuffle and summed with its like."""
        summed = self._read(names[0])
        for name in names[1:]:
            other = self._read(name).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("n").alias("m"))
            summed = summed.join(other, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "full").select(
                F.coalesce("h1", "o1").alias("h1"), F.coalesce("h2", "o2").alias("h2"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")
            )
        return summed

    def add(self, counts: DataFrame) -> None:
        new = counts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        for name in self.frequent:
            new = new.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._push(0, self._write(new))

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        run = self._write(self._union(names), len(names) == 2)
        self.frequent.append(self._write(self.spark.table(run).where(F.col("n") >= self.min_docs)))
        self.merged.add(run)
        self._drop(names)
        self._push(level + 1, run)

    def drop(self) -> None:
        """Drop every run there is or was."""
        self._drop(list(self.paths))

    def found(self) -> DataFrame:
        """The (h1, h2) of all keys found in `min_docs` documents or more, staged."""
        left = [name for level in self.levels for name in level]
        parts = [self.spark.table(name).select("h1", "h2") for name in self.frequent]
        if left:
            parts.append(self._union(left).where(F.col("n") >= self.min_docs).select("h1", "h2"))
        frequent = parts[0]
        for part in parts[1:]:
            frequent = frequent.union(part)
        return staged(frequent.distinct(), "frequent-lines")


def hashed_lines(docs: DataFrame, min_length: int) -> DataFrame:
    """(key, lines) for each row of `docs`: what stands for its text, and the hash pairs of its lines; staged."""
    text = text_or_empty()
    return staged(docs.select(text_key(text).alias("key"), line_hashes(text, min_length).alias("lines")), "line-hashes")


def frequent_lines(hashed: DataFrame, min_docs: int, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2) of the line keys in at least `min_docs` rows of `hashed`."""
    lines = hashed.select(F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int").alias("batch"), F.explode(F.array_distinct("lines")).alias("h")).where("h is not null")
    counts = staged(lines.groupBy("batch", F.col("h.a").alias("h1"), F.col("h.b").alias("h2")).agg(F.count(F.lit(1)).alias("n")).select("h1", "h2", "n", "batch"), "line-counts", "batch")
    spark = hashed.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // (BUCKET_KEYS * batches)))  # counted from the files' footers
    runs = LineRuns(spark, min_docs, fanout, wide)
    try:
        for batch in range(batches):
            runs.add(counts.where(F.col("batch") == batch).drop("batch"))
        return runs.found()
    finally:
        runs.drop()
        release(counts)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """`docs` with n_lines (before), n_dropped, and in `text` only the lines whose key fewer than `min_docs` documents have.

    A text that loses no line is returned as it was, null too.
    """
    hashed = hashed_lines(docs, min_length)
    frequent = frequent_lines(hashed, min_docs, batches, fanout)
    # The places of each text's frequent lines: few against the texts, and equal texts share them.
    lines = hashed.select("key", F.posexplode("lines").alias("place", "h")).where("h is not null")
    hits = lines.join(frequent, (F.col("h.a") == F.col("h1")) & (F.col("h.b") == F.col("h2")), "left_semi")
    # Written first, so that the join below has a plain table on either side and a hot text's rows can be split.
    key, places = fresh(docs, "__key"), fresh(docs, "__bad")
    bad = staged(hits.groupBy(F.col("key.a").alias("a"), F.col("key.b").alias("b")).agg(F.collect_set("place").alias(places)), "frequent-places")
    bad = bad.select(F.struct("a", "b").alias(fresh(docs, "__of")), places)
    release(frequent, hashed)
    text = text_or_empty()
    out = docs.withColumn(key, text_key(text)).join(bad, F.col(key) == F.col(bad.columns[0]), "left")
    split = F.split(text, "\n", -1)
    n = F.size(split)
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col(places))
    # The lines are bound once, as the only element of an array, so that picking them by place takes no new split.
    kept = F.transform(F.array(split), lambda own: F.transform(left, lambda i: F.get(own, i)))[0]
    rebuilt = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(places).isNull(), 0).otherwise(F.size(places))
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[rebuilt.alias("text") if c == "text" else F.col(c) for c in others], n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
