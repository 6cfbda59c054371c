"""MinHash near-dedup over fast similarity sketches.

A sketch has COORDINATES places. In round i every shingle is hashed to a place
and a value, and a place takes the least i + value that came to it; from round
COORDINATES on, all shingles go to one place, a new one each round, so that
every place is filled after twice as many rounds at most, and after one where a
set is large. The share of equal places estimates the Jaccard similarity within
Chernoff bounds, as of independent places.

Bands of ROWS places put texts into buckets. Texts of equal words are one node
from the start. Then

1. every node is compared on the full sets with one node, that which is the least of
   the most of its buckets; such links are pointers to lesser nodes, which are followed
   for a few steps;
2. nodes that still share a bucket but no pointers' end are compared all: in small
   buckets pair by pair, in large ones block against block, so that no pair is
   written unless it links. The blocks of a large bucket are dealt into strips, so
   that it is a square of tasks, and joins by a bucket or by a text deal its rows over
   tasks (`spread_join`), and joins by a node that many others point to are left to
   Spark's skew handling. Components are then formed of the ends alone.

The second leaves out pairs whose sizes or whose estimates rule the similarity out
(an estimate by more than six deviations); what is linked is always confirmed on
full sets. A pair of similarity 0.8 shares no bucket with a probability of 5e-8.

Nulls and edges: a null or wordless text has no shingles, links with nothing and
is kept; rows with a null doc_id link like others, their component_id is null
where no linked row has an id, and only then they can be kept; rows that repeat a
doc_id are linked each by its own text, and kept says whether a row's id is its
component's, so `deduplicated`, which keeps one row of each component, goes by rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, hot_keys, release, rows_id, spread_join, staged
from .components import components
from .shingles import mix, seeds, sequence_key, shingle_hashes, word_hashes

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Members of a bucket beyond which it is compared in blocks, and shingles of a block.
SMALL, BLOCK = 8, 1 << 17
#: Deviations by which an estimate must miss the threshold to rule a pair out.
DEVIATIONS = 6.2

_ROUNDS = seeds(2 * COORDINATES, 20_000)
_BANDS = seeds(COORDINATES, 30_000) | np.uint64(1)
_PLACE_BITS = COORDINATES.bit_length() - 1
#: A value's bits leave room above for the round.
_VALUE_BITS = 64 - _PLACE_BITS - 8


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The places of a set of one shingle or more: round and value in one number each."""
    none = np.uint64(2**64 - 1)
    places = np.full(COORDINATES, none)
    step = max(1, min(COORDINATES, 2048 // len(shingles)))
    for first in range(0, COORDINATES, step):
        rounds = np.arange(first, min(first + step, COORDINATES), dtype=np.uint64)
        x = mix(shingles[None] ^ _ROUNDS[first : first + len(rounds), None])
        value = (x >> np.uint64(8)) & np.uint64((1 << _VALUE_BITS) - 1) | rounds[:, None] << np.uint64(_VALUE_BITS)
        np.minimum.at(places, (x >> np.uint64(64 - _PLACE_BITS)).astype(np.int64).ravel(), value.ravel())
        if (places != none).all():
            return places
    for place in np.flatnonzero(places == none).tolist():
        x = mix(shingles ^ _ROUNDS[COORDINATES + place])
        places[place] = (x.min() >> np.uint64(_PLACE_BITS + 8)) | np.uint64(COORDINATES + place) << np.uint64(_VALUE_BITS)
    return places


def bands_of(places: np.ndarray) -> np.ndarray:
    """A bucket for each band; buckets of different bands differ."""
    return mix((places * _BANDS).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def marks_of(places: np.ndarray) -> bytes:
    """A byte of each place, to estimate by."""
    return (mix(places) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_equal(similarity: float) -> int:
    """Equal marks below which a pair of at least this similarity lies by more than DEVIATIONS."""
    p = similarity + (1 - similarity) / 256
    return ceil(COORDINATES * p - DEVIATIONS * (COORDINATES * p * (1 - p)) ** 0.5)


def sketches(docs: DataFrame, size: int, row: Column) -> DataFrame:
    """(row, id, doc_id, k1, k2, n_shingles, bands, marks) for each row; k1 and k2 stand for the words."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part["text"]:
                words = word_hashes(text)
                shingles = np.unique(shingle_hashes(words, size))
                if len(shingles):
                    places = sketch(shingles)
                    rows.append((*sequence_key(words), len(shingles), bands_of(places), marks_of(places)))
                else:
                    rows.append((0, 0, 0, [], b""))
            out = pd.DataFrame(rows, columns=["k1", "k2", "n_shingles", "bands", "marks"])
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            out.insert(0, "id", part["id"].to_numpy())
            out.insert(0, "row", part["row"].to_numpy())
            yield out

    source = docs.select(row.alias("row"), rows_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInPandas(batches, "row long, id long, doc_id long, k1 long, k2 long, n_shingles long, bands array<long>, marks binary")


def sets_of_nodes(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """`wanted` (node, n_shingles, bands, marks, ...) with the shingle hashes of the text whose id is the node, sorted, eight bytes each."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = [np.unique(shingle_hashes(word_hashes(t), size)).tobytes() for t in part["text"]]
            yield part.drop(columns="text").assign(shingles=sets)

    own = docs.select(rows_id().alias("id"), F.col("text").cast("string").alias("text"))
    met = own.join(wanted.drop("id"), F.col("id") == F.col("node")).select("node", "n_shingles", "bands", "marks", "text")
    return met.mapInPandas(batches, "node long, n_shingles long, bands array<long>, marks binary, shingles binary")


def sets_of_texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """`sets_of_nodes` where ids repeat: one row for each of `wanted` (node, id, k1, k2, ...), whose texts are told by their words."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for id_, text in zip(part["id"], part["text"]):
                words = word_hashes(text)
                rows.append((id_, *sequence_key(words), np.unique(shingle_hashes(words, size)).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "t1", "t2", "shingles"])

    source = docs.select(rows_id().alias("id"), F.col("text").cast("string").alias("text")).join(wanted.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left_semi")
    # Copies go before their sets are made; what differs in white space only goes after.
    own = source.dropDuplicates(["id", "text"]).mapInPandas(batches, "id long, t1 long, t2 long, shingles binary").withColumnRenamed("id", "of")
    met = own.join(wanted, (F.col("of") == F.col("id")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")))
    sets = met.groupBy(F.col("node").alias("of")).agg(F.first("shingles").alias("shingles"))
    return wanted.join(sets, F.col("node") == F.col("of")).select("node", "n_shingles", "bands", "marks", "shingles")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of `pairs` (a, b, ...) whose estimates do not rule them out."""
    floor = least_equal(percent / 100)
    left, right = (sets.select(F.col("node").alias(f"{side}_node"), F.col("marks").alias(f"{side}_marks")) for side in "xy")
    both = pairs.join(left, F.col("a") == F.col("x_node")).join(right, F.col("b") == F.col("y_node"))

    def estimate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x, y = (np.frombuffer(b"".join(part[c]), np.uint8).reshape(-1, COORDINATES) for c in ("x_marks", "y_marks"))
                yield part.drop(columns=["x_marks", "y_marks"])[(x == y).sum(1) >= floor]

    return both.select(*pairs.columns, "x_marks", "y_marks").mapInPandas(estimate, pairs.schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of `pairs` (a, b, ...) whose full sets have at least `percent` of their union in common."""
    left, right = (sets.select(F.col("node").alias(f"{side}_node"), F.col("shingles").alias(f"{side}_set")) for side in "xy")
    both = pairs.join(left, F.col("a") == F.col("x_node")).join(right, F.col("b") == F.col("y_node"))

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ok = []
            for x, y in zip(part["x_set"], part["y_set"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield part.drop(columns=["x_set", "y_set"])[np.array(ok, bool)]

    return both.select(*pairs.columns, "x_set", "y_set").mapInPandas(compare, pairs.schema)


def followed(links: DataFrame, jumps: int = 2) -> DataFrame:
    """(a, b) of the pointers `links` (a, b), one for each a and to a lesser node, with b as far as 2 ** `jumps` of them lead."""
    now = links
    for _ in range(jumps):
        up = now.select(F.col("a").alias("of"), F.col("b").alias("up"))
        led = staged(now.join(up, F.col("b") == F.col("of"), "left").select("a", F.coalesce("up", "b").alias("b")), "minhash-ends")
        release(now)
        now = led
    return now


def unpacked(rows: pa.StructArray) -> SimpleNamespace:
    """The columns of a block's rows (component, n_shingles, bands, marks, shingles) as arrays, all shingles in one."""
    component, n, bands, marks, shingles = (rows.field(c) for c in ("component", "n_shingles", "bands", "marks", "shingles"))
    marks, shingles = (np.frombuffer(b"".join(c.to_pylist()), kind) for c, kind in ((marks, np.uint8), (shingles, np.uint64)))
    return SimpleNamespace(component=component.to_numpy(), n=n.to_numpy(), bands=bands.flatten().to_numpy().reshape(-1, BANDS), marks=marks.reshape(-1, COORDINATES), shingles=shingles)


def links_of_blocks(x: SimpleNamespace, y: SimpleNamespace, bucket: int, percent: int) -> list[tuple[int, int]]:
    """The components that links join over the `unpacked` rows of `x` and `y`, in as few pairs as do. A pair is compared in
    the first bucket that it shares only."""
    floor = least_equal(percent / 100)
    xb, yb, xm, ym, xn, yn, xc, yc = x.bands, y.bands, x.marks, y.marks, x.n, y.n, x.component, y.component
    sizes, flat = yn, y.shingles
    starts = np.cumsum(sizes) - sizes
    sets = np.split(x.shingles, np.cumsum(xn)[:-1])
    out, joined = [], {}

    def root(c: int) -> int:
        while (up := joined.get(c, c)) != c:
            joined[c] = joined.get(up, up)
            c = up
        return c

    for i, mine in enumerate(sets):
        near = (yc != xc[i]) & (100 * np.minimum(yn, xn[i]) >= percent * np.maximum(yn, xn[i]))
        rows = np.flatnonzero(near)
        rows = rows[(ym[rows] == xm[i]).sum(1) >= floor]
        if not len(rows):
            continue
        same = yb[rows] == xb[i]
        rows = rows[yb[rows, same.argmax(1)] == bucket]
        if not len(rows):
            continue
        lengths = sizes[rows]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1]) + np.repeat(starts[rows] - (ends - lengths), lengths)
        theirs = flat[take]
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        common = np.add.reduceat((mine[at] == theirs).astype(np.int64), ends - lengths)
        linked = rows[100 * common >= percent * (len(mine) + lengths - common)]
        for j in linked.tolist():
            p, q = root(int(xc[i])), root(int(yc[j]))
            if p != q:
                joined[max(p, q)] = min(p, q)
                out.append((int(xc[i]), int(yc[j])))
    return out


def links_in_large(members: DataFrame, sets: DataFrame, percent: int, hot: list[tuple]) -> DataFrame:
    """(a, b): the components that links join within each bucket of `members` (bucket, node, n_shingles, component); `hot` are
    the keys among the buckets."""
    counted = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    main = counted.groupBy("bucket").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.ceil(F.sum("shingles") / BLOCK).alias("wide"), F.count(F.lit(1)).alias("parts"))
    sizes = main.where("parts > 1").select(F.col("bucket").alias("of"), "main", "wide")
    row = F.struct("component", "n_shingles", "bands", "marks", "shingles")
    placed = (
        spread_join(members.drop("n_shingles"), sizes, ["bucket"], ["of"], "node", hot)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("wide")))
        .withColumn("apart", F.col("component") != F.col("main"))
        .join(sets, "node")
    )
    # Members outside the bucket's main component meet all others; those inside only meet them.
    blocks = staged(placed.groupBy("bucket", "block", "wide", "apart").agg(F.collect_list(row).alias("rows")), "minhash-blocks")
    strips = F.ceil(F.sqrt("wide"))
    strip, facing = F.pmod("block", strips), F.explode(F.sequence(F.lit(0).cast("long"), strips - 1))
    apart = blocks.where("apart").select(F.col("bucket").alias("x_bucket"), F.col("block").alias("x_block"), strip.alias("x_strip"), facing.alias("x_facing"), F.col("rows").alias("x"))
    every = blocks.select("bucket", F.col("block").alias("y_block"), F.col("apart").alias("y_apart"), strip.alias("y_strip"), facing.alias("y_facing"), F.col("rows").alias("y"))
    on = (F.col("x_bucket") == F.col("bucket")) & (F.col("x_strip") == F.col("y_facing")) & (F.col("x_facing") == F.col("y_strip"))
    tasks = apart.join(every, on & (~F.col("y_apart") | (F.col("x_block") <= F.col("y_block")))).select("bucket", "x", "y")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for bucket, x, y in zip(part["bucket"].to_pylist(), part["x"], part["y"]):
                found += links_of_blocks(unpacked(x.values), unpacked(y.values), bucket, percent)
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tasks.mapInArrow(compare, "a long, b long").distinct()


def links_in_small(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the components that links join within each bucket of `members`."""
    own = members.select("bucket", F.col("node").alias("a"), F.col("component").alias("x"), F.col("n_shingles").alias("m"))
    other = members.select(F.col("bucket").alias("of"), F.col("node").alias("b"), F.col("component").alias("y"), F.col("n_shingles").alias("n"))
    met = own.join(other, (F.col("bucket") == F.col("of")) & (F.col("a") < F.col("b")) & (F.col("x") != F.col("y")))
    pairs = met.where(100 * F.least("m", "n") >= percent * F.greatest("m", "n")).select("a", "b", "x", "y").distinct()
    return confirmed(staged(likely(pairs, sets, percent), "minhash-pairs"), sets, percent).select(F.col("x").alias("a"), F.col("y").alias("b"))


def labelled_rows(docs: DataFrame, size: int, percent: int, row: Column) -> DataFrame:
    """(row, id, doc_id, n_shingles, node, component) for each row of `docs`: node is null where a row has neither copy nor
    link, else the label of its component, and component the component's least id."""
    rows = staged(sketches(docs, size, row), "minhash-sketches")
    worded = rows.where("n_shingles > 0")
    alike = worded.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("n_shingles", "bands", "marks")).alias("own"))
    # A text's node is its least id, or, where ids repeat and texts can have one in common, its number in their order.
    repeated = not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if repeated:
        alike = staged(alike, "minhash-texts").orderBy("id", "k1", "k2")
    node = F.monotonically_increasing_id() if repeated else F.col("id")
    nodes = staged(alike.select("k1", "k2", "id", node.alias("node"), "copies", "own.*"), "minhash-nodes")

    placed = nodes.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("least")).where("members > 1")
    shared = staged(shared.withColumnRenamed("bucket", "of"), "minhash-buckets")
    hot_buckets = hot_keys(shared.select("of", "members"))
    members = staged(spread_join(placed, shared, ["bucket"], ["of"], "node", hot_buckets).select("bucket", "node", "n_shingles", "members", "least"), "minhash-members")
    release(shared)
    wanted = nodes.join(members.select(F.col("node").alias("partnered")), F.col("node") == F.col("partnered"), "left_semi")
    sets = staged((sets_of_texts if repeated else sets_of_nodes)(docs, wanted, size), "minhash-sets")

    # 1. Every node with what is the least of the most of its buckets; of one bucket alone it is so by chance, mostly.
    met = members.where("node != least").repartition("node").groupBy("node", "least").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    best = met.groupBy(F.col("node").alias("a")).agg(F.max_by("least", F.struct("n", -F.col("least"))).alias("b"))
    ends = followed(staged(confirmed(best, sets, percent), "minhash-links"))

    # 2. What still shares a bucket across components; where there are more pointers to follow, it is only compared again.
    formed = ends.select(F.col("a").alias("formed"), F.col("b").alias("component"))
    labelled = members.join(formed, F.col("node") == F.col("formed"), "left").select("bucket", "node", "n_shingles", "members", F.coalesce("component", "node").alias("component"))
    labelled = staged(labelled, "minhash-labelled")
    release(members)
    small, large = labelled.where(F.col("members") <= SMALL), labelled.where(F.col("members") > SMALL)
    more = links_in_small(small, sets, percent).union(links_in_large(large, sets, percent, hot_buckets))
    upward = ends.join(ends.select(F.col("b").alias("end")).distinct(), F.col("a") == F.col("end"), "left_semi")
    joined = components(more.union(upward), "components-all").select(F.col("node").alias("end"), F.col("component").alias("whole"))
    release(labelled, sets)
    # Every node of a link with the end of its pointers, and the component of that.
    linked = ends.union(ends.select("b", "b")).union(joined.select("end", "end")).toDF("node", "label")
    found = linked.join(joined, F.col("label") == F.col("end"), "left").select("node", F.coalesce("whole", "label").alias("component")).distinct()

    # Rows with neither copy nor link belong to themselves.
    moved = nodes.join(found.withColumnRenamed("node", "found"), F.col("node") == F.col("found"), "left").withColumn("component", F.coalesce("component", "node")).where("copies > 1 or found is not null")
    moved = moved.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), "component")
    if repeated:  # a component's label is the node of its least id
        names = nodes.select(F.col("node").alias("label"), F.col("id").alias("least_id"))
        moved = moved.join(names, F.col("component") == F.col("label"))
    else:
        moved = moved.withColumn("label", F.col("component")).withColumn("least_id", F.col("component"))
    # Wordless rows share a key that no text has, so they are left out of the join.
    hot_texts = hot_keys(nodes.select("k1", "k2", "copies"))
    told = spread_join(worded, moved, ["k1", "k2"], ["m1", "m2"], "row", hot_texts, "left").select(*rows.columns, "label", "least_id")
    own = told.union(rows.where("n_shingles = 0").select("*", F.lit(None).cast("long"), F.lit(None).cast("long")))
    return own.select("row", "id", "doc_id", "n_shingles", F.col("label").alias("node"), F.coalesce("least_id", "id").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """(id, doc_id, n_shingles, component_id, kept) for each row of `docs`: word shingles of `size`, links from `percent` on."""
    own = labelled_rows(docs, size, percent, F.monotonically_increasing_id())
    component = F.when(F.col("component") < 2**62, F.col("component"))
    return own.select("id", "doc_id", "n_shingles", component.alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that are kept, with their columns: of each group of near-duplicates one row, of the least doc_id."""
    row = fresh(docs, "__row")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "minhash-rows")
    own = labelled_rows(keyed, size, percent, F.col(row)).where("node is not null").select("row", "id", "node")
    linked = staged(own, "minhash-linked")
    first = linked.groupBy("node").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias("kept"))
    dropped = linked.join(first, F.col("row") == F.col("kept"), "left_anti").select(F.col("row").alias(fresh(keyed, "__dropped")))
    return keyed.join(dropped, F.col(row) == F.col(dropped.columns[0]), "left_anti").select(docs.columns)
