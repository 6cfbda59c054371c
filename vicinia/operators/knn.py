"""Exact nearest neighbours as Spark joins of blocks of points.

Points of equal coordinates are one location with its k least ids, so that no
crowd of copies meets itself. Locations are put into cells: leaves of a tree of boxes,
or, in many dimensions, what is nearest to one of a few pivots. In the local phase
every query meets the blocks of its own cell (where there are more cells than can be
shipped to tasks, the tree has a lower level that is joined as a table), which gives it a radius: its k-th
distance there, or, if the cell holds fewer than k points, the distance within which
the cells that lie wholly there hold k. In the remote phase it meets the cells
that can lie within that radius - at it, too, where a smaller id may wait -, the
nearest first, in rounds: what a round finds shrinks the radius, and cells that are
then beyond it are left out of the next. All phases are equi-joins of blocks on the
cell; a task compares one block with another by an index of the block, keeps k of
each query, and what it keeps is merged by query.

The result has, for every query, the min(k, N) points of least (d2, id), itself
included where it is one of the points.

Nulls and edges: invalid points, those at infinity too, are for `points` to drop or
to refuse; no points give no rows; fewer than k give all; equal points are all there,
by id; constant columns and points on splits need no care. Ids may repeat: every row
of the base is a point of its own, and every row of the queries has neighbours of its
own, so rows with one id have k each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import KnnConfig
from ..functions import sq_distance
from ..skew import hot_keys, spread_join
from ..staging import release, scope, staged
from .cells import CellTree, cell_table, flat_coords, sample_tree, with_cell
from .deep import lower_routes, lower_trees, with_lower_cell
from .kernel import box_distances, boxes_within, counted_bounds, filtered_within, indexed_within
from .pivots import MOST_PIVOTS, SLACK, SLACK32, Pivots, counted_radius, distances, gaps, pivot_table, sample_pivots, with_pivot_cell

#: Dimensions beyond which boxes exclude next to nothing, so that cells are those of pivots.
PRUNED_DIMS = 16
#: Pairs of query and cell that are routed together, about; the share of all pairs beyond which cells of pivots are not
#: worth their routes; rounds of the remote phase grow by this factor.
ROUTED, WORTH, WIDER = 1 << 22, 0.25, 8
#: Blocks of a cell up to which one task compares all of them, and the least points of a block.
FEW_BLOCKS, LEAST_BLOCK = 4, 64
#: Beyond PRUNED_DIMS: points that a block may hold at least, as products of matrices want many, and coordinates of a strip of
#: points that meets another in a task.
DENSE_BLOCK, STRIP_COORDINATES = 4096, 1 << 21
#: Points of a place that are listed together, pairs of places that are compared at once, and ids that are sent on together.
CROWD, COMPARED, LISTED = 512, 1 << 21, 1 << 19
#: Lists of a query up to which they are merged at once; more are merged by strips first.
MANY_LISTS = 256


def locations(pts: DataFrame, k: int) -> DataFrame:
    """(loc, coords, ids): each place that has points, with its `k` least ids; loc is the least of them."""
    least = pts.withColumn("r", F.row_number().over(Window.partitionBy("coords").orderBy("id"))).where(F.col("r") <= k)
    ids = F.array_sort(F.collect_list("id"))
    return least.groupBy("coords").agg(ids.alias("ids")).select(F.col("ids")[0].alias("loc"), "coords", "ids")


def dimension(pts: DataFrame) -> int | None:
    """The number of coordinates; None without points."""
    first = pts.select(F.size("coords").alias("d")).first()
    return None if first is None else first["d"]


def _blocks(rows: DataFrame, by: str, size: int, columns: list[str]) -> DataFrame:
    """`rows` of each value of `by` in blocks of about `size`, dealt by the hash of their first column: arrays of the
    `columns`, and of their coordinates one after another. The blocks of a cell that has many of them are dealt into
    strips, as many as the root of their number."""
    counts = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks")).withColumnRenamed(by, "of")  # a row a cell
    dealt = rows.join(counts, F.col(by) == F.col("of")).withColumn("block", F.pmod(F.xxhash64(columns[0]), F.col("blocks")))
    held = dealt.groupBy(by, "block", "blocks").agg(F.collect_list(F.struct(*columns, "coords")).alias("r"))
    wide = F.when(F.col("blocks") <= FEW_BLOCKS, 1).otherwise(F.ceil(F.sqrt("blocks"))).cast("int")
    return held.select(F.col(by).alias("cell"), wide.alias("wide"), F.pmod("block", wide).cast("int").alias("strip"), *[F.col(f"r.{c}").alias(c) for c in columns], F.flatten("r.coords").alias("flat"))


def _facing(blocks: DataFrame, others: DataFrame) -> DataFrame:
    """`blocks`, each once for every strip of the `others` in its cell, as `facing`."""
    strips = others.groupBy(F.col("cell").alias("of")).agg(F.max("wide").alias("strips"))  # a row a cell
    return blocks.join(strips, F.col("cell") == F.col("of")).withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).drop("of", "strips")


def _meet(queries: DataFrame, base: DataFrame, k: int | None, dims: int, float32: bool) -> DataFrame:
    """(q, near, strip): what each block of queries (cell, q, bound, flat) keeps of each block of the base (cell, loc, m, flat).

    Strips of queries meet strips of the base, so that a cell of many blocks is a square of tasks.
    """
    left = _facing(queries, base).select(F.col("cell").alias("q_cell"), F.col("strip").alias("q_strip"), F.col("facing").alias("q_facing"), "q", "bound", F.col("flat").alias("q_flat"))
    right = _facing(base, queries).select("cell", "strip", "facing", "loc", "m", F.col("flat").alias("p_flat"))
    kind = np.float32 if float32 else np.float64
    search = indexed_within if dims <= PRUNED_DIMS else filtered_within

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, bound, q_flat, loc, m, p_flat = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(6))
                strip = batch.column(6)[row].as_py()
                a, b = (x.astype(kind).reshape(-1, dims) for x in (q_flat, p_flat))
                order = np.argsort(loc, kind="stable")  # ties go by location
                rows, own, d2 = search(a, b[order], np.arange(len(b)), k, bound)
                own = order[own]
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                lists = [pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(x)) for x in (d2.astype(float), loc[own], m[own].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(q[rows[starts]]), *lists, pa.array(np.full(len(starts), strip, np.int32))], names=["q", "d2", "loc", "m", "strip"])

    on = (F.col("q_cell") == F.col("cell")) & (F.col("q_strip") == F.col("facing")) & (F.col("q_facing") == F.col("strip"))
    met = left.join(right, on).select("q", "bound", "q_flat", "loc", "m", "p_flat", "strip")
    return met.mapInArrow(compare, "q long, d2 array<double>, loc array<long>, m array<int>, strip int").select("q", F.arrays_zip("d2", "loc", "m").alias("near"), "strip")


def _meet_columns(queries: DataFrame, base: DataFrame, k: int, dims: int) -> DataFrame:
    """(q, near, strip) as `_meet` gives it, of rows (cell, q, bound, coords) and (cell, loc, m, coords), in generated code:
    an equi-join on the cell and a window that keeps k of each query before its shuffle."""
    left = queries.select(F.col("cell").alias("q_cell"), "q", "bound", F.col("coords").alias("q_coords"))
    d2 = sq_distance(*[[F.element_at(side, i + 1) for i in range(dims)] for side in ("q_coords", "coords")])
    pairs = left.join(base.select("cell", "loc", "m", "coords"), F.col("q_cell") == F.col("cell")).select("q", "bound", d2.alias("d2"), "loc", "m").where("d2 <= bound")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d2", "loc"))).where(F.col("r") <= k)
    return pairs.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d2", "loc", "m"))).alias("near")).withColumn("strip", F.lit(0))


def _first(lists: DataFrame, k: int, many: bool = False) -> DataFrame:
    """(q, near): the k nearest of what the blocks kept of each query; `many` lists are merged by strips of the base first,
    so that no task holds more than about the root of their number."""
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")
    if many:
        lists = lists.groupBy("q", "strip").agg(nearest)
    return lists.groupBy("q").agg(nearest)


def _radius(near: str, k: int):
    """The distance within which k points lie; infinite if `near` has fewer."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("r"))

    def step(seen, x):
        n = seen["n"] + x["m"]
        return F.struct(n.alias("n"), F.when((seen["n"] < k) & (n >= k), x["d2"]).otherwise(seen["r"]).alias("r"))

    return F.aggregate(near, start, step, lambda seen: seen["r"])


def _routed(queries: DataFrame, router: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, ...]]], counted: bool = False) -> DataFrame:
    """(q, coords, bound, cell, near, place) of what `router` gives for strips of (coords, cell, bound): (row, cell, near, bounds);
    or with `counted` only how many routes there are, as (n)."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, cell, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("q", "cell", "bound"))
            coords, total = flat_coords(batch.column("coords")), 0
            for at, i, j, near, bounds in router(coords, cell, bound):
                other = j != cell[at + i]
                i, j, near = i[other], j[other], near[other]
                total += len(i)
                if counted or not len(i):
                    continue
                order = np.lexsort((j, near, i))
                i, j, near = i[order], j[order], near[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                offsets = pa.array((np.arange(len(i) + 1) * coords.shape[1]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(coords[at + i].reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(q[at + i]), lists, pa.array(bounds[i]), pa.array(j.astype(np.int32)), pa.array(near), pa.array(place.astype(np.int32))], names=["q", "coords", "bound", "cell", "near", "place"])
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    return queries.select("q", "coords", "cell", "bound").mapInArrow(route, "n long" if counted else "q long, coords array<double>, bound double, cell int, near double, place int")


def routes(queries: DataFrame, cells: DataFrame, tree: CellTree, k: int | None = None, float32: bool = False) -> DataFrame:
    """(q, coords, bound, cell, near, place) for every other cell whose box lies within a query's bound, at it included:
    how near it is, and its place among the query's routes, the nearest first.

    `queries` has (q, coords, cell, bound); `cells` (cell, n, lo, hi) are the cells of `tree`, whose number its maker bounds:
    the tree of their boxes is shipped to every task, where all queries of a strip walk down it together. With `k`, an
    infinite bound is first lowered to a distance within which the cells' counts and far corners show `k` points.
    """
    low, high, n = np.full((tree.cells, tree.dims), np.inf), np.full((tree.cells, tree.dims), -np.inf), np.zeros(tree.cells, np.int64)
    for r in cells.select("cell", "n", "lo", "hi").collect():
        low[r["cell"]], high[r["cell"]], n[r["cell"]] = r["lo"], r["hi"], r["n"]
    kind = np.float32 if float32 else np.float64  # distances round as the kernel's do
    shipped = queries.sparkSession.sparkContext.broadcast((tree.boxed(low.astype(kind), high.astype(kind)), tree.held(n)))
    step = max(16, ROUTED // (tree.cells * 16))

    def router(coords: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        (own, left, right, lows, highs), counts = shipped.value
        lows, highs = lows.astype(kind), highs.astype(kind)
        node_of = np.zeros(tree.cells, np.int64)
        node_of[own[own >= 0]] = np.flatnonzero(own >= 0)
        for at in range(0, len(coords), step):
            x, bounds = coords[at : at + step].astype(kind), bound[at : at + step].copy()
            if k is not None and (endless := np.flatnonzero(np.isinf(bounds))).size:
                bounds[endless] = counted_bounds(x[endless], k, (own, left, right, lows, highs), counts)
            found = list(boxes_within(x, bounds, (own, left, right, lows, highs)))
            if found:
                i, j = (np.concatenate(part) for part in zip(*found))
                yield at, i, j, box_distances(x[i], lows[node_of[j]], highs[node_of[j]]).astype(float), bounds

    return _routed(queries, router)


def pivot_routes(queries: DataFrame, table: tuple[np.ndarray, np.ndarray, np.ndarray], pivots: Pivots, k: int, float32: bool = False, counted: bool = False) -> DataFrame:
    """As `routes`, for cells of pivots and their `pivot_table`; or how many routes there are."""
    shipped = queries.sparkSession.sparkContext.broadcast((pivots.at, *table))
    step, slack = max(1, ROUTED // pivots.cells**2), SLACK32 if float32 else SLACK

    def router(coords: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        at_, n, low, high = shipped.value
        for at in range(0, len(coords), step):
            d, bounds = distances(coords[at : at + step], at_), bound[at : at + step].copy()
            if (endless := np.flatnonzero(np.isinf(bounds))).size:
                bounds[endless] = counted_radius(d[endless], k, n, high, slack)
            near = gaps(d, low, high, slack)
            i, j = np.nonzero((near <= bounds[:, None]) & (n > 0))
            yield at, i, j, near[i, j], bounds

    return _routed(queries, router, counted)


def cells_for(rows: int, dims: int, config: KnnConfig) -> int:
    """Cells of about `config.cell_rows`; a few pivots' where boxes would not pay."""
    return max(1, min(-(-rows // config.cell_rows), config.routed_cells if dims <= PRUNED_DIMS else MOST_PIVOTS))


def partition(pts: DataFrame, rows: int, dims: int, config: KnnConfig) -> CellTree:
    """The tree of boxes that `rows` points (id, coords) are put into; one cell beyond PRUNED_DIMS."""
    return sample_tree(pts, cells_for(rows, dims, config) if dims <= PRUNED_DIMS else 1, dims, config.policy, rows)


def _block_rows(spark: SparkSession, rows: int, cells: int, dims: int, config: KnnConfig) -> int:
    """Points of a block: where there is one cell only, so few that every core gets some."""
    most = config.block_rows if dims <= PRUNED_DIMS else max(config.block_rows, DENSE_BLOCK)
    return most if cells > 1 else min(most, max(LEAST_BLOCK, rows // (2 * spark.sparkContext.defaultParallelism)))


@dataclass
class Prepared:
    """A base made ready for searches: its locations (loc, coords, ids, m, cell) and their blocks, staged; `rows` of them.

    `crowded`: some place has more than one point, or ids repeat, so that a location stands for other ids than its own.
    `pivots` and their table are there in place of boxes in many dimensions, and `lower` (staged) are the trees below the
    cells of `tree` where there are more cells than can be shipped; `upper` are then the boxes of the tree's own cells.
    """

    locs: DataFrame
    blocks: DataFrame
    cells: DataFrame
    tree: CellTree
    k: int
    dims: int
    rows: int
    block_rows: int
    crowded: bool
    config: KnnConfig
    pivots: Pivots | None = None
    table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    lower: DataFrame | None = None
    upper: DataFrame | None = None

    def with_cell(self, rows: DataFrame) -> DataFrame:
        if self.pivots is not None:
            return with_pivot_cell(rows, self.pivots)
        celled = with_cell(rows, self.tree)
        return celled if self.lower is None else with_lower_cell(celled, self.lower, self.dims)

    @property
    def n_cells(self) -> int:
        return self.tree.cells if self.pivots is None else self.pivots.cells

    def routes(self, bounded: DataFrame, k: int, float32: bool) -> DataFrame:
        """Where `bounded` (q, coords, cell, bound) have to look beyond their own cells."""
        if self.lower is None:
            return routes(bounded, self.cells, self.tree, k, float32)
        upper = routes(bounded.withColumn("cell", F.lit(-1)), self.upper, self.tree, k, float32)  # the query's own among them
        return lower_routes(upper, self.lower, self.cells, self.dims, float32)

    def release(self) -> None:
        """Delete what was staged of it."""
        release(self.locs, self.blocks, *[t for t in (self.lower, self.upper) if t is not None])


def _repeat(ids: DataFrame) -> bool:
    """Whether a value of the one column of `ids` repeats."""
    return not ids.groupBy(*ids.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def prepare(base: DataFrame, k: int, config: KnnConfig = KnnConfig(), tree: CellTree | None = None) -> Prepared | None:
    """The base (id, coords) of searches for up to `k` neighbours; None without points. A `tree` made elsewhere is taken as it is."""
    with scope(base.sparkSession) as own:
        locs = staged(locations(base, k), "locations")
        rows, dims, most = locs.agg(F.count(F.lit(1)), F.max(F.size("coords")), F.max(F.size("ids"))).first()
        if not rows:
            return None
        crowded = most > 1
        if _repeat(locs.select("loc")):  # places with one least id: numbers in the order of their ids stand for them
            crowded = True
            locs = staged(locs.orderBy("loc", "coords").withColumn("loc", F.monotonically_increasing_id()), "numbered-locations")
        named, weighed = locs.select(F.col("loc").alias("id"), "coords"), locs.withColumn("m", F.size("ids"))
        pivots = table = lower = upper = None
        deep = tree is None and dims <= PRUNED_DIMS and -(-rows // config.cell_rows) > config.routed_cells
        if tree is None and dims > PRUNED_DIMS and (wanted := cells_for(rows, dims, config)) > 1:
            found = sample_pivots(named, rows, dims, wanted)
            pivots = found if found.cells > 1 else None
        tree = tree if tree is not None else partition(named, rows, dims, config)
        celled = staged(with_cell(weighed, tree) if pivots is None else with_pivot_cell(weighed, pivots), "celled")
        if deep and tree.cells > 1:
            upper = own.keep(staged(cell_table(celled, dims, "m"), "upper-cells"))
            lower = own.keep(staged(lower_trees(celled.select(F.col("loc").alias("id"), "coords", "cell"), tree, rows, -(-rows // config.cell_rows), config.policy), "lower-cells"))
            celled = staged(with_lower_cell(celled, lower, dims), "celled")
        locs = own.keep(celled)
        if pivots is not None:
            table = pivot_table(locs, pivots, "m")
        size = _block_rows(base.sparkSession, rows, tree.cells if pivots is None else pivots.cells, dims, config)
        blocks = own.keep(staged(_blocks(locs, "cell", size, ["loc", "m"]), "base-blocks"))
        return Prepared(locs, blocks, cell_table(locs, dims, "m"), tree, k, dims, rows, size, crowded, config, pivots, table, lower, upper)


def _as_queries(blocks: DataFrame) -> DataFrame:
    """The base's blocks as blocks of queries without a bound."""
    return blocks.select("cell", "wide", "strip", F.col("loc").alias("q"), F.transform("loc", lambda _: F.lit(float("inf"))).alias("bound"), "flat")


def _search(queries: DataFrame | None, base: Prepared, k: int, float32: bool, columns: bool = False) -> DataFrame:
    """(q, near) for `queries` (q, coords), each q once, or for the base's own locations; staged. To be called in a scope."""

    def met(rows: DataFrame, name: str) -> DataFrame:
        if columns:
            return _meet_columns(rows, base.locs, k, base.dims)
        return _meet(staged(_blocks(rows, "cell", base.block_rows, ["q", "bound"]), name), base.blocks, k, base.dims, float32)

    placed = base.locs.select(F.col("loc").alias("q"), "coords", "cell") if queries is None else base.with_cell(queries)
    if queries is None and not columns:
        local = _meet(_as_queries(base.blocks), base.blocks, k, base.dims, float32)
    else:
        local = met(placed.withColumn("bound", F.lit(float("inf"))), "query-blocks")
    if base.n_cells == 1:
        return staged(_first(local, k, base.rows > MANY_LISTS * base.block_rows), "neighbours")
    many = base.rows > MANY_LISTS * base.block_rows * base.n_cells
    near = staged(_first(local, k, many), "neighbours")
    # A query whose cell has no points has met none; its bound stays infinite.
    bounded = placed.join(_bounds(near, k), F.col("q") == F.col("l_q"), "left").select("q", "coords", "cell", F.coalesce("l_bound", F.lit(float("inf"))).alias("bound"))
    if base.pivots is None:
        routed = base.routes(bounded, k, float32)
    else:
        asked = bounded.count()
        n = pivot_routes(bounded, base.table, base.pivots, k, float32, counted=True).agg(F.sum("n")).first()[0] or 0
        if n > WORTH * asked * (base.n_cells - 1):  # the pivots exclude too little: each query meets all
            return _compared_with_all(bounded, base, k, float32)
        routed = pivot_routes(bounded, base.table, base.pivots, k, float32)
    return _remote(staged(routed, "routes"), near, met, k, base.config.first_routes)


def _bounds(near: DataFrame, k: int) -> DataFrame:
    return near.select(F.col("q").alias("l_q"), _radius("near", k).alias("l_bound"))


def _remote(routed: DataFrame, near: DataFrame, met: Callable[[DataFrame, str], DataFrame], k: int, width: int) -> DataFrame:
    """`near` after the cells of `routed`, visited in rounds of the nearest `width`, then WIDER times as many."""
    while True:
        now = met(routed.where(F.col("place") < width), "routed-blocks").select("q", "near")
        closer = staged(_first(near.unionByName(now), k), "neighbours")
        release(near)
        near, rest = closer, routed.where(F.col("place") >= width)
        if rest.isEmpty():
            release(routed)
            return near
        bounds = _bounds(near, k)
        left = staged(rest.join(bounds, F.col("q") == F.col("l_q"), "left").withColumn("bound", F.least("bound", F.coalesce("l_bound", F.lit(float("inf"))))).where("near <= bound").select(routed.columns), "routes")
        release(routed)
        routed, width = left, width * WIDER


def _compared_with_all(bounded: DataFrame, base: Prepared, k: int, float32: bool) -> DataFrame:
    """(q, near) by comparing all with all, each query within its bound; staged.

    Both sides are dealt into strips of at most STRIP_COORDINATES, so that every task has two of them, and keeps k of each
    query of one in the other: what is shuffled grows with the number of strips, not of blocks.
    """
    kind, dims = np.float32 if float32 else np.float64, base.dims
    cores, most = base.locs.sparkSession.sparkContext.defaultParallelism, max(1, STRIP_COORDINATES // dims)
    asked = bounded.count()
    wide = [max(1, min(-(-n // LEAST_BLOCK), max(-(-n // most), int(np.ceil(np.sqrt(4 * cores)))))) for n in (asked, base.rows)]
    left = _strips(bounded, wide[0], {"q": np.int64, "bound": np.float64}, dims, "query-strips")
    right = _strips(base.locs, wide[1], {"loc": np.int64, "m": np.int32}, dims, "all-strips")
    left = left.withColumn("facing", F.explode(F.sequence(F.lit(0), F.lit(wide[1] - 1)))).withColumn("pair", F.col("strip") * wide[1] + F.col("facing"))
    right = right.withColumn("facing", F.explode(F.sequence(F.lit(0), F.lit(wide[0] - 1)))).withColumn("pair", F.col("facing") * wide[1] + F.col("strip"))

    def compare(queries: pa.Table, points: pa.Table) -> pa.Table:
        out = _NEAR.empty_table()
        if queries.num_rows and points.num_rows:
            (q, bound, x), (loc, m, y) = _unpacked(queries, ("q", "bound"), (np.int64, np.float64), dims), _unpacked(points, ("loc", "m"), (np.int64, np.int32), dims)
            order = np.argsort(loc, kind="stable")  # ties go by location
            loc, m = loc[order], m[order]
            rows, own, d2 = filtered_within(x.astype(kind), y.astype(kind)[order], np.arange(len(loc)), k, bound)
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            near = pa.StructArray.from_arrays([pa.array(v) for v in (d2.astype(float), loc[own], m[own])], ["d2", "loc", "m"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), near)
            out = pa.Table.from_arrays([pa.array(q[rows[starts]]), lists, pa.array(np.full(len(starts), points.column("strip")[0].as_py(), np.int32))], schema=_NEAR)
        return out

    met = left.select("pair", "q", "bound", "flat").groupBy("pair").cogroup(right.select("pair", "strip", "loc", "m", "flat").groupBy("pair"))
    found = met.applyInArrow(compare, "q long, near array<struct<d2: double, loc: long, m: int>>, strip int")
    return staged(_first(found, k, wide[1] > MANY_LISTS), "neighbours")


_NEAR = pa.schema([("q", pa.int64()), ("near", pa.list_(pa.struct([("d2", pa.float64()), ("loc", pa.int64()), ("m", pa.int32())]))), ("strip", pa.int32())])


def _strips(rows: DataFrame, wide: int, columns: dict[str, type], dims: int, name: str) -> DataFrame:
    """(strip, columns..., flat): `rows` dealt into `wide` strips, some at a time; numbers and coordinates are packed as bytes,
    in 32 bits where these say the same. Staged."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n * dims >= STRIP_COORDINATES:
                yield from packed(held)
                held, n = [], 0
        yield from packed(held)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        flat = flat_coords(table.column("coords").combine_chunks())
        single = flat.astype(np.float32)
        flat = single if (single == flat).all() else flat
        values = [table.column(c).to_numpy().astype(kind) for c, kind in columns.items()]
        for strip in range(min(wide, len(flat))):
            yield pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), *(pa.array([v[strip::wide].tobytes()], pa.binary()) for v in (*values, flat))], names=["strip", *columns, "flat"])

    made = rows.select(*columns, "coords").mapInArrow(deal, f"strip int, {', '.join(f'{c} binary' for c in columns)}, flat binary")
    return staged(made, name)


def _unpacked(table: pa.Table, columns: tuple[str, ...], kinds: tuple[type, ...], dims: int) -> tuple[np.ndarray, ...]:
    """The `columns` of packed rows, and their coordinates as a matrix."""
    out = [np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in zip(columns, kinds)]
    parts = []
    for ids, flat in zip(table.column(columns[0]).to_pylist(), table.column("flat").to_pylist()):
        double = len(flat) == len(ids) * dims  # ids have eight bytes each
        parts.append(np.frombuffer(flat, np.float64 if double else np.float32).reshape(-1, dims).astype(float))
    return *out, np.concatenate(parts)


def _rows(found: DataFrame, base: Prepared, k: int) -> DataFrame:
    """(q, near) of `found` (q, near), locations made their ids: the first `k` (rank, d2, neighbor_id) of each query."""
    if not base.crowded:
        return found.select("q", F.transform("near", lambda n, i: F.struct((i + 1).cast("int").alias("rank"), n["d2"].alias("d2"), n["loc"].alias("neighbor_id"))).alias("near"))
    near = found.select("q", F.explode("near").alias("n")).select("q", F.col("n.d2").alias("d2"), F.col("n.loc").alias("n_loc"))
    ids = near.join(base.locs.select("loc", "ids"), F.col("n_loc") == F.col("loc")).select("q", F.explode("ids").alias("neighbor_id"), "d2")
    order = Window.partitionBy("q").orderBy("d2", "neighbor_id")
    ranked = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "d2", "neighbor_id"))).alias("near"))


def _unlisted(lists: DataFrame, *keys: str) -> DataFrame:
    """(query_id, neighbor_id, d2, rank) of lists (id, near), with the columns `keys` behind."""
    return lists.select("id", *keys, F.explode("near").alias("n")).select(F.col("id").alias("query_id"), F.col("n.neighbor_id").alias("neighbor_id"), F.col("n.d2").alias("d2"), F.col("n.rank").alias("rank"), *keys)


def _none(pts: DataFrame, *keys: str) -> DataFrame:
    return pts.sparkSession.createDataFrame([], "query_id long, neighbor_id long, d2 double, rank int" + "".join(f", {k} long" for k in keys))


def knn_join(queries: DataFrame, base: DataFrame | Prepared, k: int, config: KnnConfig = KnnConfig(), float32: bool = False, keyed: bool = False) -> DataFrame:
    """(query_id, neighbor_id, d2, rank): the k nearest points of `base` for each of `queries`, both (id, coords).

    A base that many searches share is prepared once, for as many neighbours as the largest of them wants. With `keyed`
    there is a column `query_row` that tells queries of one id apart. What the search writes but its result is deleted.
    """
    keys = ["query_row"] if keyed else []
    with scope(queries.sparkSession) as own:
        ready = base if isinstance(base, Prepared) else prepare(base, k, config)
        if ready is None:
            return _none(queries, *keys)
        if k > ready.k:
            raise ValueError(f"the base was prepared for {ready.k} neighbours at most")
        if not keyed and not _repeat(queries.select("id")):
            found = _search(queries.select(F.col("id").alias("q"), "coords"), ready, k, float32)
            return _unlisted(_kept(own, found, ready, k).withColumnRenamed("q", "id"))
        rows = staged(queries.select("id", "coords", F.monotonically_increasing_id().alias("query_row")), "query-rows")
        found = _rows(_search(rows.select(F.col("query_row").alias("q"), "coords"), ready, k, float32), ready, k)
        lists = rows.select("id", "query_row").join(found, F.col("query_row") == F.col("q")).select("id", "query_row", "near")
        return _unlisted(own.keep(staged(lists, "neighbour-lists")), *keys)


def _kept(own, found: DataFrame, ready: Prepared, k: int) -> DataFrame:
    """The lists of `found` as the result reads them: `found` itself where locations are points."""
    return _rows(own.keep(found), ready, k) if not ready.crowded else own.keep(staged(_rows(found, ready, k), "neighbour-lists"))


def knn(pts: DataFrame, k: int, config: KnnConfig = KnnConfig(), float32: bool = False, columns: bool = False, keyed: bool = False, ready: Prepared | None = None) -> DataFrame:
    """(query_id, neighbor_id, d2, rank): the k nearest points of each point, itself among them.

    With `columns`, cells are compared as joins of rows in generated code, and not block against block in numpy; with
    `keyed` there is a column `query_row` that tells points of one id apart; `ready` is `pts` prepared before. What the
    search writes but its result is deleted.
    """
    if columns and float32:
        raise ValueError("the column form has no 32-bit distances")
    keys = ["query_row"] if keyed else []
    with scope(pts.sparkSession) as own:
        if ready is None and (ready := prepare(pts, k, config)) is None:
            return _none(pts, *keys)
        found = _search(None, ready, k, float32, columns)
        if not ready.crowded and (k > 1 or ready.rows == pts.count()):  # with k = 1 a place shows one id only
            lists = _kept(own, found, ready, k).withColumnRenamed("q", "id")
            return _unlisted(lists.withColumn("query_row", F.col("id")) if keyed else lists, *keys)
        # Every point of a location has the location's neighbours; the points of a crowd are dealt over tasks.
        placed = _rows(found, ready, k).join(ready.locs.select("loc", F.col("coords").alias("at")), F.col("q") == F.col("loc")).select("at", "near")
        placed = own.keep(staged(placed, "neighbour-lists"))
        crowds = hot_keys(pts.groupBy("coords").agg(F.count(F.lit(1)).alias("n")))
        rows = pts.select("id", "coords")
        if keyed:
            rows = own.keep(staged(rows.withColumn("query_row", F.monotonically_increasing_id()), "query-rows"))
        return _unlisted(spread_join(rows, placed, ["coords"], ["at"], "id", crowds), *keys)


def knn_columns(pts: DataFrame, k: int, config: KnnConfig = KnnConfig()) -> DataFrame:
    """`knn` in its column form; for as few dimensions as boxes exclude cells in."""
    if (dims := dimension(pts) or 1) > PRUNED_DIMS:
        raise ValueError(f"the column form is for {PRUNED_DIMS} dimensions at most, not {dims}")
    return knn(pts, k, config, columns=True)


def radius_join(queries: DataFrame, base: DataFrame, sq_radius: float, config: KnnConfig = KnnConfig()) -> DataFrame:
    """(query_id, neighbor_id, d2): all points of `base` within the radius of each of `queries`, at it included.

    Where several points lie at one place, places meet, with lists of their ids, and the pairs of ids are formed in the scan of
    what met; they are the result, whose rows may grow with the square of the points, and are held nowhere.
    """
    if (dims := dimension(base)) is None:
        return _none(base).drop("rank")
    with scope(base.sparkSession) as own:
        if (crowds := _crowds(base)) is None:
            points, wanted = base.select("id", F.col("id").alias("loc"), "coords", F.lit(1).alias("m")), queries.select(F.col("id").alias("q"), "coords")
        else:
            others = crowds if queries is base else _crowds(queries, always=True)
            points, wanted = crowds.select(F.col("n").alias("id"), F.col("n").alias("loc"), "coords", "ids"), others.select(F.col("n").alias("q"), "coords")
        rows, kept = points.count(), "m" if crowds is None else "ids"
        tree = partition(points, rows, dims, config)
        size = _block_rows(base.sparkSession, rows, tree.cells, dims, config)
        celled = staged(with_cell(points.select("loc", "coords", kept), tree), "celled")
        blocks = own.keep(staged(_blocks(celled, "cell", size, ["loc", kept]), "base-blocks"))
        placed = with_cell(wanted, tree).withColumn("bound", F.lit(float(sq_radius)))
        met = placed.select("q", "coords", "bound", "cell")
        if tree.cells > 1:
            met = met.unionByName(routes(placed, cell_table(celled, dims), tree).select(met.columns))
        columns = ["q", "bound"]
        if crowds is not None:
            met, columns = met.join(others.select(F.col("n").alias("of"), "ids"), F.col("q") == F.col("of")).drop("of"), ["q", "bound", "ids"]
        asked = own.keep(staged(_blocks(met, "cell", size, columns), "query-blocks"))
    if crowds is not None:
        return _meet_crowds(asked, blocks, dims)
    near = _meet(asked, blocks, None, dims, False)
    return near.select(F.col("q").alias("query_id"), F.explode("near").alias("n")).select("query_id", F.col("n.loc").alias("neighbor_id"), F.col("n.d2").alias("d2"))


def _crowds(pts: DataFrame, always: bool = False) -> DataFrame | None:
    """(n, coords, ids): the places of `pts` with their ids, numbered; a place of more than about CROWD points is there with several
    lists of them. None where no place has two points, unless `always`. Staged."""
    counts = staged(pts.groupBy("coords").agg(F.count(F.lit(1)).alias("points")), "places")
    most = counts.agg(F.max("points")).first()[0] or 0
    if most <= 1 and not always:
        return None
    if most <= CROWD:
        lists = pts.groupBy("coords").agg(F.collect_list("id").alias("ids"))
    else:
        dealt = spread_join(pts.select("id", "coords"), counts.withColumnRenamed("coords", "at"), ["coords"], ["at"], "id", hot_keys(counts))
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("points") / CROWD)).alias("part")
        lists = dealt.groupBy("coords", part).agg(F.collect_list("id").alias("ids"))
    return staged(lists.select(F.monotonically_increasing_id().alias("n"), "coords", "ids"), "crowds")


def _meet_crowds(queries: DataFrame, base: DataFrame, dims: int) -> DataFrame:
    """(query_id, neighbor_id, d2) of blocks of places (cell, q, bound, ids, flat) and (cell, loc, ids, flat): tasks find the places
    that are near, some pairs at a time, and every id of one meets every id of the other in generated code."""
    left = _facing(queries, base).select(F.col("cell").alias("q_cell"), F.col("strip").alias("q_strip"), F.col("facing").alias("q_facing"), F.col("ids").alias("q_ids"), "bound", F.col("flat").alias("q_flat"))
    right = _facing(base, queries).select("cell", "strip", "facing", "ids", F.col("flat").alias("p_flat"))
    search = indexed_within if dims <= PRUNED_DIMS else filtered_within

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, bound, q_flat, ids, p_flat = (batch.column(i)[row].values for i in range(5))
                a, b = (x.to_numpy(zero_copy_only=False).reshape(-1, dims) for x in (q_flat, p_flat))
                bound, held = bound.to_numpy(zero_copy_only=False), [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (q_ids, ids)]
                step = max(1, COMPARED // len(b))
                for at in range(0, len(a), step):
                    rows, own, d2 = search(a[at : at + step], b, np.arange(len(b)), None, bound[at : at + step])
                    part = np.cumsum(held[0][at + rows] + held[1][own]) // LISTED
                    for cut in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
                        if len(cut):
                            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at + rows[cut])), ids.take(pa.array(own[cut])), pa.array(d2[cut])], names=["q_ids", "ids", "d2"])

    on = (F.col("q_cell") == F.col("cell")) & (F.col("q_strip") == F.col("facing")) & (F.col("q_facing") == F.col("strip"))
    met = left.join(right, on).select("q_ids", "bound", "q_flat", "ids", "p_flat")
    near = met.mapInArrow(compare, "q_ids array<long>, ids array<long>, d2 double")
    return near.select(F.explode("q_ids").alias("query_id"), "ids", "d2").select("query_id", F.explode("ids").alias("neighbor_id"), "d2")
