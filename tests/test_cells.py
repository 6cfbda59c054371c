import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinia.operators import cells
from vicinia.operators.cells import cell_offsets, cell_table, global_numbers, level_tree, owner_of, sample_tree, with_cell
from vicinia.sources import node_lines, write_cells, write_nodes

from .brute import frame, rng, rows


@pytest.mark.parametrize("build", [sample_tree, level_tree])
@pytest.mark.parametrize("policy", ["widest", "round_robin"])
def test_cells_are_even_and_boxes_hold_their_points(spark, build, policy):
    pts = rows(rng(1), 400, 3)
    tree = build(frame(spark, pts), 7, 3, policy)
    assert tree.cells == 7
    coords = np.array([c for _, c in pts])
    cell = tree.assign(coords)
    counts = np.bincount(cell, minlength=7)
    assert counts.min() > 30 and counts.max() < 90
    leaves = {n.cell: n for n in tree.nodes if n.cell is not None}
    for c, x in zip(cell, coords):
        assert (leaves[c].low <= x).all() and (x <= leaves[c].high).all()
    assert {r["id"]: r["cell"] for r in with_cell(frame(spark, pts), tree).collect()} == dict(zip([i for i, _ in pts], cell))


def test_a_sample_is_a_share_of_the_points(spark, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE_COORDINATES", 400)
    pts = rows(rng(12), 900, 2)
    tree = sample_tree(frame(spark, pts), 5, 2)
    counts = np.bincount(tree.assign(np.array([c for _, c in pts])), minlength=5)
    assert tree.cells == 5 and counts.min() > 90 and counts.max() < 300


@pytest.mark.parametrize("policy", ["widest", "round_robin"])
@pytest.mark.parametrize("grid", [None, 4, 300])
def test_exact_medians_though_the_sample_is_a_part(spark, monkeypatch, policy, grid):
    """The nodes are those of a tree made from all points at once, also where most points share their largest coordinate."""
    pts = rows(rng(13), 900, 2, grid) + [(-1 - i, [5.0, float(i % 2)]) for i in range(500 if grid == 4 else 0)]
    want = cells.split_sample([c for _, c in pts], 5, 2, policy)
    monkeypatch.setattr(cells, "SAMPLE_COORDINATES", 200)
    tree = sample_tree(frame(spark, pts), 5, 2, policy, exact=True)
    assert [(n.cell, n.dim, n.value, n.left, n.right) for n in tree.nodes] == [(n.cell, n.dim, n.value, n.left, n.right) for n in want.nodes]
    assert all((a.low == b.low).all() and (a.high == b.high).all() for a, b in zip(tree.nodes, want.nodes))


def test_a_sample_comes_packed(spark):
    """The driver gets the coordinates as bytes, not as rows of lists."""
    df = frame(spark, rows(rng(14), 70, 3))
    got = cells._gathered(df, 3)
    assert got.shape == (70, 3) and sorted(map(tuple, got)) == sorted(tuple(r["coords"]) for r in df.collect())
    assert cells._gathered(df.where("false"), 3).shape == (0, 3)


def test_many_cells_go_through_numpy(spark):
    pts = rows(rng(2), 500, 2)
    tree = sample_tree(frame(spark, pts), 100, 2)
    assert tree.cells == 100
    assert {r["id"]: r["cell"] for r in with_cell(frame(spark, pts), tree).collect()} == dict(zip([i for i, _ in pts], tree.assign(np.array([c for _, c in pts]))))


def test_points_at_a_split_go_left(spark):
    pts = [(i, [float(i % 2)]) for i in range(10)]
    for build in (sample_tree, level_tree):
        tree = build(frame(spark, pts), 2, 1)
        assert tree.nodes[0].value == 0.0 and tree.assign(np.array([[0.0], [0.5], [1.0]])).tolist() == [0, 1, 1]


def test_equal_points_cannot_be_split(spark):
    pts = [(i, [3.0, 3.0]) for i in range(20)]
    for build in (sample_tree, level_tree):
        assert build(frame(spark, pts), 4, 2).cells == 1
    assert sample_tree(frame(spark, []), 4, 2).cells == 1


def test_numbers_and_owners(spark):
    pts = rows(rng(4), 50, 2)
    celled = with_cell(frame(spark, pts), sample_tree(frame(spark, pts), 4, 2))
    numbered = {r["id"]: (r["cell"], r["number"]) for r in global_numbers(celled).collect()}
    want = {i: (c, n) for n, (c, i) in enumerate(sorted((r["cell"], r["id"]) for r in celled.collect()))}
    assert numbered == want
    owners = owner_of(spark.range(50).select(F.col("id").alias("number")), cell_offsets(celled))
    assert {r["number"]: r["cell"] for r in owners.collect()} == {n: c for c, n in want.values()}


def test_table_and_files(spark, tmp_path):
    pts = rows(rng(6), 60, 2)
    tree = sample_tree(frame(spark, pts), 4, 2)
    celled = with_cell(frame(spark, pts), tree)
    for r in cell_table(celled, 2).collect():
        own = np.array([c for (_, c), cell in zip(pts, tree.assign(np.array([c for _, c in pts]))) if cell == r["cell"]])
        assert r["n"] == len(own) and r["lo"] == own.min(0).tolist() and r["hi"] == own.max(0).tolist()
    lines = [r["line"] for r in node_lines(tree, spark).orderBy("place").collect()]
    assert len(lines) == 7 and lines[0].startswith("0,-1,0,") and all(len(x.split(",")) == 8 for x in lines)
    write_nodes(tree, spark, f"{tmp_path}/nodes")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/nodes").collect()] == lines
    write_cells(celled, f"{tmp_path}/cells")
    assert {(r["id"], r["cell"]) for r in spark.read.parquet(f"{tmp_path}/cells").collect()} == {(r["id"], r["cell"]) for r in celled.collect()}


def test_a_hot_cell_is_dealt_over_tasks(spark, tmp_path):
    """A cell with two thirds of all points, half of them at one place: numbers are as by one sort, files hold parts of it."""
    from vicinia.operators.cells import CellTree, Node, global_numbers
    from vicinia.sources import write_cells

    end = np.full(1, np.inf)
    tree = CellTree(1, [Node(0, -end, end, None, 0, 5.0, 1, 2), Node(1, -end, np.array([5.0]), 0), Node(1, np.array([5.0]), end, 1)])
    pts = spark.range(0, 3000, 1, 5).selectExpr("id", "array(if(id % 3 = 0, 9.0D, if(id % 3 = 1, 1.0D, id / 3000))) coords")
    celled = with_cell(pts, tree)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sorted((r["cell"], r["id"], r["number"]) for r in global_numbers(celled).collect())
        assert [n for _, _, n in rows] == list(range(3000))
        assert sorted({r["cell"] for r in celled.collect()}) == [0, 1]
        write_cells(celled, f"{tmp_path}/cells")
        back = spark.read.parquet(f"{tmp_path}/cells")
        sizes = [r["count"] for r in back.groupBy("_metadata.file_name", "cell").count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 900
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert global_numbers(celled.where("false")).count() == 0


@pytest.mark.parametrize("policy", ["widest", "round_robin"])
def test_a_tree_from_sketches(spark, policy):
    """Cells of all points hold like numbers, boxes hold their points, and the number of cells is no matter of expressions."""
    pts = frame(spark, rows(rng(61), 600, 2))
    tree = cells.sketch_tree(pts, 100, 2, policy)
    table = cell_table(with_cell(pts, tree), 2).collect()
    assert tree.cells == len(table) == 100 and sum(r["n"] for r in table) == 600
    assert max(r["n"] for r in table) <= 2 * min(r["n"] for r in table)
    rough = cells.sketch_tree(pts, 16, 2, policy, k=32)
    assert rough.cells == 16 and sum(r["n"] for r in cell_table(with_cell(pts, rough), 2).collect()) == 600
    assert cells.sketch_tree(frame(spark, [(i, [1.0, 2.0]) for i in range(9)]), 8, 2, policy).cells == 1
    assert cells.sketch_tree(pts.where("false"), 8, 2, policy).cells == 1


@pytest.mark.parametrize("reach", [5.0, 0.0])
def test_exact_medians_though_the_sketch_is_rough(spark, monkeypatch, reach):
    """With eight items for 700 points the splits are those at the middle of all, wherever the sketch says to look."""
    monkeypatch.setattr(cells, "REACH", reach)
    x = sorted(c[0] for _, c in rows(rng(62), 700, 1))
    left = [v for v in x if v <= x[349]]
    tree = cells.sketch_tree(frame(spark, [(i, [v]) for i, v in enumerate(x)]), 4, 1, k=8, exact=True)
    assert [n.value for n in tree.nodes[:3]] == [x[349], left[174], x[350:][174]]
