"""Space partitioning: a tree of median splits, the cell of each point, and tables of the cells.

Whatever its shape, a tree never changes the answer of a search. It is built from
a bounded sample of points, or from all by one pair of aggregations a level.
Points at a split go left.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..staging import scope, staged
from .stats import at_places

#: Coordinates of the sample that a tree is built from, in all.
SAMPLE_COORDINATES = 1 << 22
#: Cells up to which a point's cell is a CASE expression in generated code; beyond, it is looked up in numpy.
CASE_CELLS = 64
#: Items of a sketch that a split is read from; a share read from k items is REACH / k ** 0.9 off at most, as good as surely.
SKETCH, REACH = 4096, 5.0
#: How monotonically_increasing_id is made: the partition above this many bits.
PARTITION_BITS = 33
#: The most cells whose offsets are shipped to every task.
MOST_OFFSETS = 1 << 20


@dataclass
class Node:
    """A leaf if `cell` is not None, else a split of dimension `dim` at `value`, with places of its children."""

    level: int
    low: np.ndarray
    high: np.ndarray
    cell: int | None = None
    dim: int = -1
    value: float = 0.0
    left: int = -1
    right: int = -1


@dataclass
class CellTree:
    dims: int
    nodes: list[Node] = field(default_factory=list)

    @property
    def cells(self) -> int:
        return sum(n.cell is not None for n in self.nodes)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(cell or -1, left, right, dim, value) of the nodes: what a task needs to find cells."""
        cell = np.array([-1 if n.cell is None else n.cell for n in self.nodes], np.int64)
        return cell, *(np.array([getattr(n, a) for n in self.nodes], np.int64) for a in ("left", "right", "dim")), np.array([n.value for n in self.nodes])

    def assign(self, coords: np.ndarray) -> np.ndarray:
        """The cell of each row of `coords`."""
        return assigned(coords, self.arrays())

    def boxed(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cell or -1, left, right, low, high) of each node, whose box holds those of its cells; a cell without points
        has a box that nothing is near to. `low` and `high` are the cells' boxes, by number."""
        cell, left, right, _, _ = self.arrays()
        lows, highs = np.full((len(cell), self.dims), np.inf), np.full((len(cell), self.dims), -np.inf)
        lows[cell >= 0], highs[cell >= 0] = low[cell[cell >= 0]], high[cell[cell >= 0]]
        for i in self._children_first(cell):
            lows[i], highs[i] = np.minimum(lows[left[i]], lows[right[i]]), np.maximum(highs[left[i]], highs[right[i]])
        return cell, left, right, lows, highs

    def held(self, counts: np.ndarray) -> np.ndarray:
        """How many points lie below each node, by those of each cell."""
        cell, left, right, _, _ = self.arrays()
        out = np.zeros(len(cell), np.int64)
        out[cell >= 0] = counts[cell[cell >= 0]]
        for i in self._children_first(cell):
            out[i] = out[left[i]] + out[right[i]]
        return out

    def _children_first(self, cell: np.ndarray) -> list[int]:
        return [i for i in np.argsort([-n.level for n in self.nodes], kind="stable").tolist() if cell[i] < 0]

    def expression(self, coords: Column | str) -> Column:
        """The cell as nested CASE expressions."""

        def walk(i: int) -> Column:
            n = self.nodes[i]
            if n.cell is not None:
                return F.lit(n.cell)
            return F.when(F.element_at(coords, n.dim + 1) > F.lit(float(n.value)), walk(n.right)).otherwise(walk(n.left))

        return walk(0)

    def preorder(self) -> Iterator[Node]:
        """The nodes as a walk from the root meets them, left before right."""
        stack = [0]
        while stack:
            n = self.nodes[stack.pop()]
            yield n
            if n.cell is None:
                stack += [n.right, n.left]

    def bounds(self, spark: SparkSession) -> DataFrame:
        """(of, low, high): the cells and what their splits leave them, above `low` and up to `high` in every dimension."""
        rows = [(n.cell, n.low.tolist(), n.high.tolist()) for n in self.nodes if n.cell is not None]
        return spark.createDataFrame(rows, "of int, low array<double>, high array<double>")

    def table(self, spark: SparkSession) -> DataFrame:
        """(place, level, owner, split_dim, split_val, lb, ub) in preorder; owner is -1 for a split, split_dim for a leaf."""
        rows = [(i, n.level, -1 if n.cell is None else n.cell, n.dim, float(n.value), n.low.tolist(), n.high.tolist()) for i, n in enumerate(self.preorder())]
        return spark.createDataFrame(rows, "place int, level int, owner int, split_dim int, split_val double, lb array<double>, ub array<double>")


def assigned(coords: np.ndarray, nodes: tuple[np.ndarray, ...]) -> np.ndarray:
    """The cell of each row of `coords` by a tree's `arrays`, level by level for all rows at once."""
    cell, left, right, dim, value = nodes
    at, rows = np.zeros(len(coords), np.int64), np.arange(len(coords))
    while len(rows):
        rows = rows[cell[at[rows]] < 0]
        own = at[rows]
        at[rows] = np.where(coords[rows, dim[own]] > value[own], right[own], left[own])
    return cell[at]


def flat_coords(column: pa.Array) -> np.ndarray:
    """A column of coordinates as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def split_dimension(node: Node, low: np.ndarray, high: np.ndarray, policy: str, dims: int) -> int:
    return int(np.argmax(high - low)) if policy == "widest" else node.level % dims


def sample_tree(pts: DataFrame, cells: int, dims: int, policy: str = "widest", rows: int | None = None, exact: bool = False) -> CellTree:
    """A tree of at most `cells` leaves from a bounded sample: the points whose ids have the least hashes.

    Of `rows` points, where there are more than the sample takes, those are kept in the scan whose hashes lie below the
    share wanted; so no task sorts, and none sends on more than its part of the sample. With `exact` the splits are the
    medians of all points in any case: where the sample is a part of them it only tells where to look.
    """
    most = max(1, SAMPLE_COORDINATES // dims)
    if cells <= 1:
        return split_sample(np.zeros((0, dims)), cells, dims, policy)
    rows = pts.count() if rows is None else rows
    if rows <= most:
        return split_sample(_gathered(pts, dims), cells, dims, policy)
    kept = pts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * most / rows))
    sample = _gathered(kept.select("coords").limit(2 * most), dims)  # the limit only bounds what chance might add
    return refined_tree(pts, sample, cells, dims, policy) if exact else split_sample(sample, cells, dims, policy)


def _gathered(pts: DataFrame, dims: int) -> np.ndarray:
    """The coordinates of a few points as a matrix. They come to the driver packed, as eight bytes each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([flat_coords(batch.column("coords")).tobytes()], pa.binary())], names=["packed"])

    packed = [r["packed"] for r in pts.select("coords").mapInArrow(pack, "packed binary").collect()]
    return np.frombuffer(b"".join(packed)).reshape(-1, dims)


def split_sample(sample: list | np.ndarray, cells: int, dims: int, policy: str) -> CellTree:
    """A tree of at most `cells` leaves by medians of the points of `sample`."""
    coords = np.array(sample, float).reshape(len(sample), dims)
    endless = np.full(dims, np.inf)
    tree = CellTree(dims, [Node(0, -endless, endless)])
    made, queue = 0, deque([(0, np.arange(len(coords)), cells)])
    while queue:
        place, own, wanted = queue.popleft()
        node, split = tree.nodes[place], None
        if wanted > 1 and len(own) > 1:
            low, high = coords[own].min(0), coords[own].max(0)
            for dim in [split_dimension(node, low, high, policy, dims), int(np.argmax(high - low))]:
                x = np.sort(coords[own, dim])
                share = wanted // 2 / wanted
                value = x[min(max(int(len(x) * share) - 1, 0), len(x) - 1)]
                if value == x[-1]:  # nothing would go right: split below the largest value
                    value = x[max(np.searchsorted(x, value) - 1, 0)]
                if value < x[-1]:
                    split = dim, float(value)
                    break
        if split is None:
            node.cell, made = made, made + 1
            continue
        node.dim, node.value = split
        for side in ("left", "right"):
            low, high = node.low.copy(), node.high.copy()
            (high if side == "left" else low)[node.dim] = node.value
            setattr(node, side, len(tree.nodes))
            tree.nodes.append(Node(node.level + 1, low, high))
        right = coords[own, node.dim] > node.value
        queue += [(node.left, own[~right], wanted // 2), (node.right, own[right], wanted - wanted // 2)]
    return tree


def refined_tree(pts: DataFrame, sample: np.ndarray, cells: int, dims: int, policy: str = "widest") -> CellTree:
    """The tree that `split_sample` makes of all points, though `sample` holds a part of them only: a level at a time, the
    boxes and counts of its nodes by one aggregation, and their medians by counting on both sides of where the sample has them."""
    endless = np.full(dims, np.inf)
    tree = CellTree(dims, [Node(0, -endless, endless)])
    own, wanted, open_, made = {0: np.arange(len(sample))}, {0: cells}, [0], 0
    while open_:
        boxes = [f(F.element_at("coords", i + 1)).alias(f"{s}{i}") for i in range(dims) for s, f in (("lo", F.min), ("hi", F.max))]
        parted = [p for p in open_ if wanted[p] > 1]
        seen = {r["node"]: r for r in _placed(pts, tree, parted).groupBy("node").agg(F.count(F.lit(1)).alias("n"), *boxes).collect()} if parted else {}  # a row a node
        asked = {}
        for place in parted:
            if place in seen:
                n = seen[place]["n"]
                low, high = (np.array([seen[place][f"{s}{i}"] for i in range(dims)]) for s in ("lo", "hi"))
                dim = split_dimension(tree.nodes[place], low, high, policy, dims)
                dim = dim if low[dim] < high[dim] else int(np.argmax(high - low))
                if low[dim] < high[dim]:
                    rank = min(max(int(n * (wanted[place] // 2 / wanted[place])) - 1, 0), n - 1)
                    asked[place] = (dim, *_bracket(sample[own[place], dim], rank / n, low[dim], high[dim]), rank, high[dim])
        value = _split_values(pts, tree, asked)
        following = []
        for place in open_:
            node = tree.nodes[place]
            if place not in asked:
                node.cell, made = made, made + 1
                continue
            node.dim, node.value = asked[place][0], value[place]
            right = sample[own[place], node.dim] > node.value
            for side, mine, n in (("left", own[place][~right], wanted[place] // 2), ("right", own[place][right], wanted[place] - wanted[place] // 2)):
                low, high = node.low.copy(), node.high.copy()
                (high if side == "left" else low)[node.dim] = node.value
                setattr(node, side, len(tree.nodes))
                own[len(tree.nodes)], wanted[len(tree.nodes)] = mine, n
                following.append(len(tree.nodes))
                tree.nodes.append(Node(node.level + 1, low, high))
        open_ = following
    return tree


def _bracket(x: np.ndarray, share: float, low: float, high: float) -> tuple[float, float]:
    """Two numbers between which the `share` of all rows falls, as good as surely, by a sample `x` of them; else `low` and `high`."""
    x, reach = np.sort(x), 2 * np.sqrt(len(x)) + 2  # four deviations at least
    first, last = int(share * len(x) - reach), int(share * len(x) + reach) + 1
    return float(x[first]) if first >= 0 and len(x) else float(low), float(x[last]) if last < len(x) else float(high)


def _split_values(pts: DataFrame, tree: CellTree, asked: dict[int, tuple[int, float, float, int, float]]) -> dict[int, float]:
    """The element at a place of each node's points, in the order of one dimension: of `asked`, by node, (dimension, low, high,
    place, largest). Where it is the largest, so that nothing would go right of it, the next below.

    One aggregation counts what lies before `low` and up to `high`; if the place is not there, all of the node is searched.
    """
    if not asked:
        return {}
    spark, dims = pts.sparkSession, np.ones(len(tree.nodes), int)
    for place, (dim, *_) in asked.items():
        dims[place] = dim + 1
    with scope(spark):
        x = F.element_at("coords", F.element_at(F.lit(dims.tolist()), F.col("node") + 1)) if tree.dims > 1 else F.element_at("coords", 1)
        rows = _placed(pts, tree, list(asked)).select("node", x.alias("x"))
        around = spark.createDataFrame([(n, low, high) for n, (_, low, high, *_) in asked.items()], "of int, low double, high double")
        held = F.col("x").between(F.col("low"), F.col("high"))
        counted = rows.join(F.broadcast(around), F.col("node") == F.col("of")).groupBy("node")  # a row a node
        told = counted.agg(F.count_if(F.col("x") < F.col("low")).alias("below"), F.count_if(held).alias("inside"), F.min(F.when(held, F.col("x"))).alias("lo"), F.max(F.when(held, F.col("x"))).alias("hi"), F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        places = []
        for r in told.collect():
            at = asked[r["node"]][3] - r["below"]
            places.append((r["node"], 0, r["lo"], r["hi"], at, r["inside"]) if 0 <= at < r["inside"] else (r["node"], 0, r["least"], r["most"], asked[r["node"]][3], r["n"]))
        found = at_places(rows, spark.createDataFrame(places, "node int, tag int, low double, high double, place long, left long"), ["node"])
        value = {r["node"]: r["x"] for r in found.collect()}
        if tops := [(n, value[n]) for n in asked if value[n] == asked[n][4]]:
            largest = spark.createDataFrame(tops, "of int, top double")
            below = rows.join(F.broadcast(largest), F.col("node") == F.col("of")).where("x < top").groupBy("node").agg(F.max("x").alias("x"))
            value |= {r["node"]: r["x"] for r in below.collect()}
    return value


def level_tree(pts: DataFrame, cells: int, dims: int, policy: str = "widest", accuracy: int = 1000) -> CellTree:
    """A tree from all points: a level at a time, the boxes of its nodes by one aggregation and their medians by another."""
    endless = np.full(dims, np.inf)
    tree = CellTree(dims, [Node(0, -endless, endless)])
    wanted, open_, made = {0: cells}, [0], 0
    while open_:
        at = _place(tree, open_)
        placed = pts.select(at.alias("node"), "coords").where("node >= 0")
        boxes = {r["node"]: r for r in placed.groupBy("node").agg(*[f(F.element_at("coords", i + 1)).alias(f"{s}{i}") for i in range(dims) for s, f in (("lo", F.min), ("hi", F.max))]).collect()}  # a row a node
        dim = {}
        for place in open_:
            if place in boxes and wanted[place] > 1:
                low, high = (np.array([boxes[place][f"{s}{i}"] for i in range(dims)]) for s in ("lo", "hi"))
                d = split_dimension(tree.nodes[place], low, high, policy, dims)
                d = d if low[d] < high[d] else int(np.argmax(high - low))
                if low[d] < high[d]:
                    dim[place] = d
        value = {}
        if dim:
            x = F.coalesce(*[F.when(F.col("node") == p, F.element_at("coords", d + 1)) for p, d in dim.items()])
            for share in sorted({wanted[p] // 2 / wanted[p] for p in dim}):
                own = [p for p in dim if wanted[p] // 2 / wanted[p] == share]
                value |= {r["node"]: r["x"] for r in placed.where(F.col("node").isin(own)).groupBy("node").agg(F.percentile_approx(x, share, accuracy).alias("x")).collect()}
        following = []
        for place in open_:
            node = tree.nodes[place]
            if place not in dim:
                node.cell, made = made, made + 1
                continue
            node.dim, v = dim[place], value[place]
            node.value = float(v) if v < boxes[place][f"hi{node.dim}"] else float(boxes[place][f"lo{node.dim}"])
            for side in ("left", "right"):
                low, high = node.low.copy(), node.high.copy()
                (high if side == "left" else low)[node.dim] = node.value
                setattr(node, side, len(tree.nodes))
                wanted[len(tree.nodes)] = wanted[place] // 2 if side == "left" else wanted[place] - wanted[place] // 2
                following.append(len(tree.nodes))
                tree.nodes.append(Node(node.level + 1, low, high))
        open_ = following
    return tree


def sketch_tree(pts: DataFrame, cells: int, dims: int, policy: str = "widest", k: int = SKETCH, exact: bool = False) -> CellTree:
    """A tree from all points by one pass a level: every node's box and, for each dimension, a mergeable sketch of its
    coordinates with `k` items, from which the split is read. While a node has no more than `k` points its split is exact;
    with `exact` it always is, as the points on both sides of what the sketch says are then counted.

    Points find their nodes in arrays, so thousands of nodes are as good as a few; the driver gets a row a node.
    """
    endless = np.full(dims, np.inf)
    tree = CellTree(dims, [Node(0, -endless, endless)])
    wanted, open_, made = {0: cells}, [0] if cells > 1 else [], 0
    reach = REACH / k**0.9 if exact else 0.0
    while open_:
        shares = sorted({wanted[p] // 2 / wanted[p] for p in open_})
        around = [min(max(s + e, 0.0), 1.0) for e in (0, -reach, reach) for s in shares]
        x = [F.element_at("coords", i + 1) for i in range(dims)]
        boxes = [f(x[i]).alias(f"{s}{i}") for i in range(dims) for s, f in (("lo", F.min), ("hi", F.max))]
        sketches = [F.kll_sketch_agg_double(x[i], F.lit(k)).alias(f"sketch{i}") for i in range(dims)]
        splits = [F.kll_sketch_get_quantile_double(f"sketch{i}", F.array(*[F.lit(s) for s in around])).alias(f"at{i}") for i in range(dims)]
        placed = _in_nodes(pts, tree, open_).where("node >= 0")
        seen = {r["node"]: r for r in placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *boxes, *sketches).select("node", "n", *[f"{s}{i}" for i in range(dims) for s in ("lo", "hi")], *splits).collect()}
        following, asked, split = [], {}, {}
        for place in (p for p in open_ if p in seen):
            r, node = seen[place], tree.nodes[place]
            low, high = (np.array([r[f"{s}{i}"] for i in range(dims)]) for s in ("lo", "hi"))
            dim = split_dimension(node, low, high, policy, dims)
            dim = dim if low[dim] < high[dim] else int(np.argmax(high - low))
            if not low[dim] < high[dim]:
                continue
            share = wanted[place] // 2 / wanted[place]
            value, before, behind = (float(v) for v in r[f"at{dim}"][shares.index(share) :: len(shares)])
            split[place] = dim, value if value < high[dim] else float(low[dim])
            if exact and r["n"] > k:
                asked[place] = dim, before, behind, max(math.ceil(r["n"] * share) - 1, 0), high[dim]
        values = _split_values(pts, tree, asked)
        for place, (dim, value) in split.items():
            node = tree.nodes[place]
            node.dim, node.value = dim, values.get(place, value)
            for side, n in (("left", wanted[place] // 2), ("right", wanted[place] - wanted[place] // 2)):
                lo, hi = node.low.copy(), node.high.copy()
                (hi if side == "left" else lo)[dim] = node.value
                setattr(node, side, len(tree.nodes))
                wanted[len(tree.nodes)] = n
                if n > 1:
                    following.append(len(tree.nodes))
                tree.nodes.append(Node(node.level + 1, lo, hi))
        open_ = following
    for node in tree.nodes:
        if node.dim < 0:
            node.cell, made = made, made + 1
    return tree


def _in_nodes(pts: DataFrame, tree: CellTree, open_: list[int]) -> DataFrame:
    """(coords, node): the open node that each point is in, or -1, by the nodes' arrays."""
    _, left, right, dim, value = tree.arrays()
    ends = np.where(dim < 0, np.arange(len(dim)), -1)  # where a walk ends
    named = np.full(len(dim), -1)
    named[open_] = open_
    shipped = pts.sparkSession.sparkContext.broadcast(((ends, left, right, dim, value), named))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes, names = shipped.value
                node = names[assigned(flat_coords(batch.column("coords")), nodes)]
                yield pa.RecordBatch.from_arrays([batch.column("coords"), pa.array(node.astype(np.int32))], names=["coords", "node"])

    return pts.select("coords").mapInArrow(place, "coords array<double>, node int")


def _placed(pts: DataFrame, tree: CellTree, open_: list[int]) -> DataFrame:
    """(coords, node) of the points in open nodes; while these are few, by a CASE expression."""
    placed = pts.select("coords", _place(tree, open_).alias("node")) if len(tree.nodes) <= CASE_CELLS else _in_nodes(pts, tree, open_)
    return placed.where("node >= 0")


def _place(tree: CellTree, open_: list[int]) -> Column:
    """The open node that a point is in, or -1."""

    def walk(i: int) -> Column:
        n = tree.nodes[i]
        if i in open_ or n.dim < 0:
            return F.lit(i if i in open_ else -1)
        return F.when(F.element_at("coords", n.dim + 1) > F.lit(n.value), walk(n.right)).otherwise(walk(n.left))

    return walk(0)


def with_cell(pts: DataFrame, tree: CellTree) -> DataFrame:
    """`pts` with `cell`."""
    if tree.cells <= CASE_CELLS:
        return pts.withColumn("cell", tree.expression("coords").cast("int"))
    shipped = pts.sparkSession.sparkContext.broadcast(tree.arrays())  # five numbers a node
    kept = [c for c in pts.columns if c != "cell"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = assigned(flat_coords(batch.column("coords")), shipped.value) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cells.astype(np.int32))], names=[*kept, "cell"])

    return pts.select(kept).mapInArrow(place, StructType([*(pts.schema[c] for c in kept), StructField("cell", IntegerType())]))


def cell_table(celled: DataFrame, dims: int, weight: str | None = None) -> DataFrame:
    """(cell, n, lo, hi): the points of each cell, or the sum of their `weight`, and the box around them."""
    boxes = [[f(F.element_at("coords", i + 1)) for i in range(dims)] for f in (F.min, F.max)]
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")
    return celled.groupBy("cell").agg(counted.alias("n"), F.array(*boxes[0]).alias("lo"), F.array(*boxes[1]).alias("hi"))


def cell_offsets(celled: DataFrame) -> DataFrame:
    """(cell, n, start): how many points lie in the cells before; the window runs over one row a cell."""
    counts = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def global_numbers(celled: DataFrame) -> DataFrame:
    """`celled` with `number`: points numbered from 0, cell by cell and by id within a cell.

    Ranges of (cell, id) are sorted each in its task and numbered behind those before, so a cell that holds much of all
    points is dealt over tasks. The window runs over one row a range.
    """
    placed = staged(celled.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").withColumn("number", F.monotonically_increasing_id()), "numbered-points")
    part = F.shiftright("number", PARTITION_BITS)
    ranges = placed.groupBy(part.alias("part")).agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select("part", (before - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(shifts), part == F.col("part")).select(*celled.columns, (F.col("number") + F.col("shift")).alias("number"))


def owner_of(numbers: DataFrame, offsets: DataFrame) -> DataFrame:
    """(number, cell): the cell in whose range of numbers each one lies, by bisection in the starts of MOST_OFFSETS cells at most."""
    starts = [(r["start"], r["n"], r["cell"]) for r in offsets.where("n > 0").orderBy("start").limit(MOST_OFFSETS + 1).collect()]
    if len(starts) > MOST_OFFSETS:
        raise ValueError(f"more than {MOST_OFFSETS} cells cannot be shipped to every task")
    start, n, cell = (np.array([r[i] for r in starts], np.int64) for i in range(3))
    shipped = numbers.sparkSession.sparkContext.broadcast((start, n, cell))

    @F.pandas_udf("int")
    def owner(number: Iterator[pd.Series]) -> Iterator[pd.Series]:
        start, n, cell = shipped.value
        for part in number:
            at = np.searchsorted(start, part.to_numpy(), "right") - 1
            inside = (at >= 0) & (part.to_numpy() < (start + n)[at]) if len(start) else np.zeros(len(part), bool)
            yield pd.Series(np.where(inside, cell[at] if len(start) else -1, -1), dtype="int32")

    return numbers.select("number", owner("number").alias("cell")).where("cell >= 0")
