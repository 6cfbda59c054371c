import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vicinia.config import KnnConfig
from vicinia.operators import knn as search
from vicinia.operators.knn import knn, knn_columns, knn_join, prepare, radius_join
from vicinia import skew, staging
from vicinia.operators import kernel, pivots
from vicinia.operators.cells import cell_table, sample_tree, with_cell
from vicinia.operators.knn import routes
from vicinia.operators.points import points, random_points
from vicinia.operators.topk import flat, merge_top_k, nested, sorted_neighbours, top_k

from .brute import as_dict, frame, knn as brute, rng, rows

SMALL = KnnConfig(cell_rows=8, block_rows=5)


@pytest.mark.parametrize("n, dims, k, grid", [(90, 2, 4, None), (90, 2, 7, 4), (60, 5, 3, None), (40, 1, 6, 9), (30, 20, 5, None)])
def test_as_brute_force(spark, n, dims, k, grid):
    pts = rows(rng(n + dims), n, dims, grid)
    assert as_dict(knn(frame(spark, pts), k, SMALL)) == brute(pts, pts, k)


def test_plans_agree_and_prefixes_nest(spark):
    df = frame(spark, rows(rng(3), 120, 2, 30))
    cells, one, many = as_dict(knn(df, 6, SMALL)), as_dict(knn(df, 6)), as_dict(knn(df.repartition(7), 6, KnnConfig(cell_rows=3, policy="round_robin")))
    assert cells == one == many == as_dict(knn_columns(df, 6)) == as_dict(knn_columns(df, 6, SMALL))
    assert as_dict(knn(df, 5, SMALL)) == {key: v for key, v in cells.items() if key[1] <= 5}


def test_no_points(spark):
    assert knn(frame(spark, []), 3).count() == 0
    assert radius_join(frame(spark, []), frame(spark, []), 1.0).count() == 0


def test_one_point_and_few(spark):
    assert as_dict(knn(frame(spark, [(5, [1.0, 2.0])]), 3)) == {(5, 1): (5, 0.0)}
    few = [(1, [0.0]), (2, [1.0]), (3, [5.0])]
    assert as_dict(knn(frame(spark, few), 9, KnnConfig(cell_rows=1))) == brute(few, few, 9)


def test_equal_points_are_told_by_id(spark):
    pts = [(i, [1.0, 1.0]) for i in range(40)]
    assert as_dict(knn(frame(spark, pts), 3, KnnConfig(cell_rows=4))) == {(i, r): (r - 1, 0.0) for i in range(40) for r in (1, 2, 3)}


def test_a_crowd_beside_others(spark):
    pts = [(i, [0.0, 0.0]) for i in range(30)] + rows(rng(5), 30, 2, 3)
    pts = [(i, c) for i, (_, c) in enumerate(pts)]
    assert as_dict(knn(frame(spark, pts), 5, SMALL)) == brute(pts, pts, 5)


def test_a_constant_column(spark):
    pts = [(i, [2.0, float(i % 11)]) for i in range(50)]
    assert as_dict(knn(frame(spark, pts), 4, SMALL)) == brute(pts, pts, 4)


def test_queries_against_a_base(spark):
    q, p = rows(rng(7), 25, 3), rows(rng(8), 70, 3)
    assert as_dict(knn_join(frame(spark, q), frame(spark, p), 4, SMALL)) == brute(q, p, 4)
    twice = [(1, q[0][1]), (2, q[0][1])]  # queries may coincide, and lie far away from all
    far = [*twice, (3, [99.0, -99.0, 0.0])]
    assert as_dict(knn_join(frame(spark, far), frame(spark, p), 2, SMALL)) == brute(far, p, 2)


def lists_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "neighbor_id", "d2").collect()))


def each_row(queries, base, k):
    """Neighbours of each row of `queries` by itself."""
    return sorted((q, rank, p, d2) for q, x in queries for (_, rank), (p, d2) in brute([(q, x)], base, k).items())


def test_ids_may_repeat(spark):
    q = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 1.0]), (2, [0.5, 2.0]), (3, [1.0, 1.0])]
    p = [(1, [0.0, 0.0]), (1, [3.0, 3.0]), (1, [3.0, 3.0]), (2, [0.0, 1.0]), (2, [2.0, 2.0]), (4, [2.0, 2.0]), (5, [9.0, 9.0])] + rows(rng(4), 20, 2, 5)
    unlike = [(i, c) for i, (_, c) in enumerate(p)]
    for config in (SMALL, KnnConfig()):
        assert lists_of(knn_join(frame(spark, q), frame(spark, unlike), 4, config)) == each_row(q, unlike, 4)
        assert lists_of(knn_join(frame(spark, q), frame(spark, p), 4, config)) == each_row(q, p, 4)
        assert lists_of(knn(frame(spark, p), 3, config)) == each_row(p, p, 3)


def test_a_base_is_prepared_once(spark):
    p, q = rows(rng(14), 60, 2, 9), rows(rng(15), 9, 2, 9)
    ready = prepare(frame(spark, p), 5, SMALL)
    for k in (2, 5):
        assert as_dict(knn_join(frame(spark, q), ready, k)) == brute(q, p, k)
    with pytest.raises(ValueError):
        knn_join(frame(spark, q), ready, 6)


def test_many_lists_are_merged_by_strips(spark, monkeypatch):
    monkeypatch.setattr(search, "MANY_LISTS", 1)
    pts = rows(rng(16), 150, 20)
    assert as_dict(knn(frame(spark, pts), 5, KnnConfig(block_rows=7))) == brute(pts, pts, 5)


def test_a_crowd_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 0)
    monkeypatch.setattr(skew, "LEAST", 4)
    monkeypatch.setattr(skew, "PARTS", 10)
    pts = [(i, [1.0, 2.0] if i % 3 else [float(i), 0.0]) for i in range(60)]
    assert as_dict(knn(frame(spark, pts), 4, SMALL)) == brute(pts, pts, 4)


def test_routes_leave_no_cell_out(spark):
    r = rng(17)
    pts = rows(r, 300, 3)
    tree = sample_tree(frame(spark, pts), 40, 3)
    celled = with_cell(frame(spark, pts), tree)
    boxes = {b["cell"]: b for b in cell_table(celled, 3).collect()}
    queries = [(i, r.normal(0.5, 0.7, 3).tolist(), int(r.integers(0, 40)), float(r.choice([0.0, 0.01, 0.2, float("inf")]))) for i in range(80)]
    df = spark.createDataFrame(queries, "q long, coords array<double>, cell int, bound double")
    want = {(q, c) for q, x, own, bound in queries for c, b in boxes.items() if c != own and sum(max(lo - v, v - hi, 0) ** 2 for v, lo, hi in zip(x, b["lo"], b["hi"])) <= bound}
    frontier, kernel.FRONTIER = kernel.FRONTIER, 16
    try:
        nodes = tree.boxed(*(np.array([boxes[c][s] for c in range(40)]) for s in ("lo", "hi")))
        q, c = (np.concatenate(x) for x in zip(*kernel.boxes_within(np.array([x for _, x, _, _ in queries]), np.array([b for *_, b in queries]), nodes)))
    finally:
        kernel.FRONTIER = frontier
    assert {(i, j) for i, j in zip(q.tolist(), c.tolist()) if j != queries[i][2]} == want
    assert {(x["q"], x["cell"]) for x in routes(df, cell_table(celled, 3), tree).collect()} == want


def test_a_radius_from_counts_routes_a_part(spark):
    """With k far above a cell's points few of all pairs of query and cell are routed, and bounds hold k points."""
    pts = rows(rng(21), 600, 2)
    ready = prepare(frame(spark, pts), 60, KnnConfig(cell_rows=10, block_rows=10))
    endless = ready.locs.selectExpr("loc q", "coords", "cell", "double('inf') bound")
    found = routes(endless, ready.cells, ready.tree, 60).collect()
    assert ready.tree.cells == 60 and len(found) < 0.4 * 600 * 59
    far = {q: sorted(sum((a - b) ** 2 for a, b in zip(x, y)) for _, y in pts)[59] for q, x in pts}
    assert all(far[r["q"]] <= r["bound"] < float("inf") and r["near"] <= r["bound"] for r in found)
    places = {}
    for r in found:
        places.setdefault(r["q"], []).append((r["place"], r["near"]))
    for own in places.values():
        assert [n for _, n in sorted(own)] == sorted(n for _, n in own) and [p for p, _ in sorted(own)] == list(range(len(own)))
    assert as_dict(knn(frame(spark, pts), 60, KnnConfig(cell_rows=10, block_rows=10))) == brute(pts, pts, 60)


def test_counted_bounds_hold_k():
    r = rng(22)
    for dims, cells, k in ((2, 8, 5), (3, 33, 40), (1, 5, 1000)):
        x = r.random((300, dims)) ** 2
        tree = tree_of(x, cells)
        own = tree.assign(x)
        low, high = (np.array([f(x[own == c], axis=0) for c in range(tree.cells)]) for f in (np.min, np.max))
        q = r.normal(0.5, 1.0, (80, dims))
        bounds = kernel.counted_bounds(q, k, tree.boxed(low, high), tree.held(np.bincount(own, minlength=tree.cells)))
        held = (kernel.square_distances(q, x) <= bounds[:, None]).sum(1)
        assert (held >= k).all() if k <= 300 else np.isinf(bounds).all()


def tree_of(x, cells):
    """A tree of median splits, made here."""
    from vicinia.operators.cells import CellTree, Node

    dims = x.shape[1]
    tree = CellTree(dims, [Node(0, np.full(dims, -np.inf), np.full(dims, np.inf))])
    work, made = [(0, np.arange(len(x)), cells)], 0
    while work:
        place, own, wanted = work.pop()
        node = tree.nodes[place]
        if wanted == 1:
            node.cell, made = made, made + 1
            continue
        node.dim = int(np.argmax(np.ptp(x[own], axis=0)))
        node.value = float(np.sort(x[own, node.dim])[len(own) // 2 - 1])
        right = x[own, node.dim] > node.value
        for side, mine, n in (("left", own[~right], wanted // 2), ("right", own[right], wanted - wanted // 2)):
            setattr(node, side, len(tree.nodes))
            tree.nodes.append(Node(node.level + 1, node.low, node.high))
            work.append((len(tree.nodes) - 1, mine, n))
    return tree


@pytest.mark.parametrize("dims, grid, k", [(2, None, 6), (3, 4, 5), (1, 40, 9)])
def test_a_tree_of_two_levels(spark, dims, grid, k):
    """With four cells shipped and fifty wanted: neighbours of all points, and of queries that lie elsewhere, as by brute force."""
    pts = rows(rng(51), 200, dims, grid)
    config = KnnConfig(cell_rows=4, block_rows=4, routed_cells=4)
    ready = prepare(frame(spark, pts), k, config)
    cells = ready.locs.select("cell").distinct().count()
    assert ready.tree.cells == 4 and ready.lower is not None and cells > 8
    assert ready.locs.count() == ready.rows == len({tuple(c) for _, c in pts})
    assert as_dict(knn(frame(spark, pts), k, config)) == brute(pts, pts, k)
    q = [(i, (3 * np.array(c) - 1).tolist()) for i, (_, c) in enumerate(rows(rng(52), 40, dims))] + [(99, pts[0][1])]
    assert as_dict(knn_join(frame(spark, q), ready, k, config)) == brute(q, pts, k)
    assert as_dict(knn(frame(spark, pts), 30, config, float32=True)).keys() == brute(pts, pts, 30).keys()


def test_rounds_drop_what_a_nearer_cell_has_ruled_out(spark, monkeypatch):
    """On clustered points, visiting the nearest cells first leaves fewer meetings, at the same answer."""
    r = rng(23)
    centres = r.random((3, 2)) * 100
    pts = [(i, (centres[i % 3] + r.normal(0, 0.5, 2)).tolist()) for i in range(480)]
    met, meet = [], search._meet

    def counting(queries, base, *rest):
        met.append(queries.select(search.F.explode("q")).count())
        return meet(queries, base, *rest)

    monkeypatch.setattr(search, "_meet", counting)
    found, counts = [], []
    for first in (1, 1 << 20):
        met.clear()
        found.append(as_dict(knn(frame(spark, pts), 12, KnnConfig(cell_rows=8, block_rows=8, first_routes=first))))
        counts.append(sum(met))
    assert found[0] == found[1] == brute(pts, pts, 12) and counts[0] < 0.8 * counts[1], counts


def test_the_index_forms_fewer_distances(monkeypatch):
    formed, plain = [], kernel.square_distances
    monkeypatch.setattr(kernel, "square_distances", lambda q, p: formed.append(len(q) * len(p)) or plain(q, p))
    r = rng(24)
    for dims, n, k, share in ((2, 2000, 10, 0.15), (3, 2000, 10, 0.35), (2, 2000, 300, 0.65)):
        p, ids = r.random((n, dims)), np.arange(n)
        formed.clear()
        got = kernel.indexed_within(p, p, ids, k, None)
        assert sum(formed) < share * n * n
        assert all((a == b).all() for a, b in zip(got, kernel.within(p, p, ids, k, None)))


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(0, 200), st.integers(0, 300), st.one_of(st.none(), st.integers(1, 320)), st.booleans(), st.booleans())
def test_the_index_changes_nothing(seed, dims, nq, n, k, grid, single):
    r = rng(seed)
    q, p = ((r.integers(0, 6, (m, dims)).astype(float) if grid else r.normal(0, 1, (m, dims))).astype(np.float32 if single else float) for m in (nq, n))
    bound = None if k is not None and seed % 3 else r.choice([0.0, 0.5, 2.0, np.inf], nq)
    if n == 0:
        return
    got, want = kernel.indexed_within(q, p, np.arange(n), k, bound, leaf=4), kernel.within(q, p, np.arange(n), k, bound)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, want))


@pytest.mark.parametrize("kind", ["normal", "grid", "scales", "far away", "tiny"])
@pytest.mark.parametrize("single", [False, True])
def test_products_of_matrices_change_nothing(kind, single):
    r = rng(25)
    made = {
        "normal": lambda m: r.normal(0, 1, (m, 20)),
        "grid": lambda m: r.integers(0, 2, (m, 20)).astype(float),
        "scales": lambda m: r.normal(0, 1, (m, 20)) * r.choice([1e-3, 1.0, 1e3], (m, 1)),
        "far away": lambda m: 1e6 + 1e-3 * r.normal(0, 1, (m, 20)),
        "tiny": lambda m: 1e-200 * r.normal(0, 1, (m, 20)),
    }[kind]
    for nq, n, k, bounded in ((600, 2500, 5, False), (70, 1500, 300, False), (90, 1200, 10, True), (40, 700, None, True), (30, 400, 500, False), (20, 100, 3, False), (0, 300, 3, False)):
        q, p = (made(m).astype(np.float32 if single else float) for m in (nq, n))
        q[: nq // 2] = p[: nq // 2]
        bound = r.choice([0.0, float(np.median(kernel.square_distances(q, p))), np.inf], nq) if bounded else None
        got, want = kernel.filtered_within(q, p, np.arange(n), k, bound), kernel.within(q, p, np.arange(n), k, bound)
        assert all(len(a) == len(b) and (a == b).all() for a, b in zip(got, want))


def test_few_distances_are_formed_in_many_dimensions(spark, monkeypatch):
    """Of evenly dealt points products tell which distances are formed; and all meet in strips, however small blocks are."""
    formed, plain = [], kernel.exact_pairs
    monkeypatch.setattr(kernel, "exact_pairs", lambda q, p: formed.append(len(q)) or plain(q, p))
    p = rng(26).normal(0, 1, (6000, 64))
    kernel.filtered_within(p[:600], p, np.arange(6000), 10, None)
    assert 6000 < sum(formed) < 0.02 * 600 * 6000
    pts = rows(rng(27), 500, 20)
    strips, made = [], search._strips
    monkeypatch.setattr(search, "_strips", lambda *a: strips.append(a[1]) or made(*a))
    assert as_dict(knn(frame(spark, pts), 3, KnnConfig(cell_rows=20, block_rows=5))) == brute(pts, pts, 3)
    assert len(strips) == 2 and max(strips) <= 8  # and not the hundred blocks


def clustered(seed, n, dims, centres, spread=0.05):
    r = rng(seed)
    at = r.normal(0, 1, (centres, dims))
    return [(i, (at[i % centres] + r.normal(0, spread, dims)).tolist()) for i in range(n)]


def test_pivots_leave_out_cells_of_clustered_points(spark, monkeypatch):
    """In 24 dimensions a part of the pairs meets, and neighbours are those of brute force; where points lie evenly all meet."""
    fell = []
    whole = search._compared_with_all
    monkeypatch.setattr(search, "_compared_with_all", lambda *a: fell.append(1) or whole(*a))
    pts = clustered(31, 320, 24, 16)
    config = KnnConfig(cell_rows=20, block_rows=20)
    ready = prepare(frame(spark, pts), 5, config)
    assert ready.pivots is not None and 8 <= ready.pivots.cells <= 16
    endless = ready.locs.selectExpr("loc q", "coords", "cell", "double('inf') bound")
    n = search.pivot_routes(endless, ready.table, ready.pivots, 5, counted=True).agg(search.F.sum("n")).first()[0]
    assert n < 0.2 * 320 * (ready.pivots.cells - 1)
    assert as_dict(knn(frame(spark, pts), 5, config)) == brute(pts, pts, 5) and not fell
    q = clustered(31, 40, 24, 16, 0.2) + [(1000, [9.0] * 24)]
    assert as_dict(knn_join(frame(spark, q), frame(spark, pts), 30, config)) == brute(q, pts, 30)
    even = rows(rng(32), 120, 20)
    assert as_dict(knn(frame(spark, even), 5, config)) == brute(even, even, 5) and fell


def test_pivot_bounds_hold():
    r = rng(33)
    x, q = r.normal(0, 1, (400, 30)) * r.choice([1e-3, 1.0, 1e3], (400, 1)), r.normal(0, 1, (50, 30)) * 10
    at = pivots.choose(x, 12)
    own = pivots.nearest(x, at)
    d = pivots.distances(x, at)
    low, high = (np.array([f(d[own == c], axis=0) if (own == c).any() else np.full(len(at), np.inf * s) for c in range(len(at))]) for f, s in ((np.min, 1), (np.max, -1)))
    n = np.bincount(own, minlength=len(at))
    true, dq = kernel.square_distances(q, x), pivots.distances(q, at)
    gap = pivots.gaps(dq, low, high, pivots.SLACK)
    for c in np.flatnonzero(n):
        assert (gap[:, c] <= true[:, own == c].min(1)).all()
    for k in (1, 37, 400, 401):
        radius = pivots.counted_radius(dq, k, n, high, pivots.SLACK)
        assert ((true <= radius[:, None]).sum(1) >= min(k, 400)).all() and np.isinf(radius).all() == (k > 400)


def test_what_is_left_after_a_search(spark, tmp_path):
    """A search leaves its result's tables and no others, a stream's batch none."""
    from vicinia.streaming.neighbours import stream_knn

    before = set(staging.left(spark))
    pts = frame(spark, rows(rng(41), 200, 2)).cache()
    one, two = (knn(pts, 12, SMALL) for _ in range(2))
    assert one.count() == two.count() == 2400 and len(set(staging.left(spark)) - before) <= 2
    knn_join(pts, frame(spark, [(i % 5, [float(i % 3), 0.0]) for i in range(40)]), 3, SMALL).count()
    assert len(set(staging.left(spark)) - before) <= 3
    made = set(staging.left(spark))
    pts.limit(30).write.parquet(f"{tmp_path}/in/a")
    pts.limit(20).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema("id long, coords array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream_knn(stream, pts, 3, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 150
    assert len(set(staging.left(spark)) - made) <= 2  # the base's
    with pytest.raises(ValueError):
        knn_join(pts, prepare(pts, 2, SMALL), 3)
    with pytest.raises(Exception, match="null or NaN"):
        knn(points(spark.createDataFrame([(1, None)], "i long, a double"), "i", ["a"]), 3)
    assert len(set(staging.left(spark)) - made) <= 4


def test_queries_of_one_id_are_told_apart(spark):
    q = [(1, [0.0, 0.0]), (1, [5.0, 5.0]), (2, [1.0, 1.0])]
    p = rows(rng(42), 30, 2, 6)
    for found in (knn_join(frame(spark, q), frame(spark, p), 4, SMALL, keyed=True), knn_join(frame(spark, q), frame(spark, p), 4, keyed=True)):
        lists = nested(found).collect()
        assert sorted((r["query_id"], [(n["value"], n["array_idx"]) for n in r["neighbors"]]) for r in lists) == sorted((i, [(d, j) for j, d in brute([(i, x)], p, 4).values()]) for i, x in q)
        assert flat(nested(found)).count() == 12 and top_k(found, 2).count() == 6
        assert sorted_neighbours(found).columns == found.columns
    same = [(7, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [4.0, 4.0])]
    own = knn(frame(spark, same), 3, SMALL, keyed=True)
    assert sorted((r["query_id"], [n["array_idx"] for n in r["neighbors"]]) for r in nested(own).collect()) == sorted((i, [j for j, _ in sorted_by(x, same)[:3]]) for i, x in same)
    assert knn(frame(spark, []), 3, keyed=True).columns == own.columns


def sorted_by(x, base):
    return sorted(((j, sum((a - b) ** 2 for a, b in zip(x, y))) for j, y in base), key=lambda e: (e[1], e[0]))


def test_merged_tables_count_rows(spark):
    pair = lambda *r: spark.createDataFrame(list(r), "query_id long, neighbor_id long, d2 double")
    a, b = pair((1, 5, 1.0), (1, 5, 1.0), (1, 6, 2.0)), pair((1, 5, 1.0), (1, 7, 3.0))
    got = lambda df: [(r["neighbor_id"], r["rank"]) for r in df.orderBy("rank").collect()]
    assert got(merge_top_k([a, b], 9)) == [(5, 1), (5, 2), (6, 3), (7, 4)]  # one base: the second table names a known one
    assert got(merge_top_k([a, b], 9, disjoint=True)) == [(5, 1), (5, 2), (5, 3), (6, 4), (7, 5)]


def test_radius(spark):
    pts = rows(rng(9), 80, 2, 12)
    found = {(r["query_id"], r["neighbor_id"]): r["d2"] for r in radius_join(frame(spark, pts), frame(spark, pts), 4.0, SMALL).collect()}
    assert found == {(q, p): d for (q, _), (p, d) in brute(pts, pts, len(pts)).items() if d <= 4.0}


@pytest.mark.parametrize("crowd, listed", [(512, 1 << 19), (4, 6)])
def test_places_meet_within_a_radius(spark, monkeypatch, crowd, listed):
    """Crowds, one of them large, are compared once a place: all pairs of ids are there, and few distances were asked for."""
    monkeypatch.setattr(search, "CROWD", crowd)
    monkeypatch.setattr(search, "LISTED", listed)
    met, meet = [], search._meet_crowds
    monkeypatch.setattr(search, "_meet_crowds", lambda q, p, d: met.append(p.select(search.F.explode("loc")).count()) or meet(q, p, d))
    base = [(i, [float(i % 5), float(i % 3)]) for i in range(150)] + [(200 + i, [9.0, 9.0]) for i in range(60)] + [(3, [9.5, 9.0]), (3, [9.5, 9.0])]
    wanted = [(7, [9.0, 9.0]), (7, [9.0, 9.0]), (8, [0.0, 1.0]), (9, [50.0, 0.0])]
    want = lambda q: sorted((i, j, sum((a - b) ** 2 for a, b in zip(x, y))) for i, x in q for j, y in base if sum((a - b) ** 2 for a, b in zip(x, y)) <= 1.0)
    df = frame(spark, base)
    assert sorted(map(tuple, radius_join(df, df, 1.0, SMALL).collect())) == want(base)
    assert sorted(map(tuple, radius_join(frame(spark, wanted), df, 1.0, SMALL).collect())) == want(wanted)
    assert max(met) == 17 if crowd > 60 else 17 < max(met) < 150


def test_float32(spark):
    pts = [(i, [1.0 + i * 1e-9]) for i in range(6)]  # all one in 32 bits
    assert {v[1] for v in as_dict(knn(frame(spark, pts), 3, float32=True)).values()} == {0.0}
    assert {v[1] for v in as_dict(knn(frame(spark, pts), 3)).values()} != {0.0}


def test_invalid_points(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, float("nan"), 1.0), (None, 1.0, 1.0), (4, float("-inf"), 1.0)], "i long, a double, b double")
    assert [r["id"] for r in points(df, "i", ["a", "b"], "drop").collect()] == [1]
    with pytest.raises(Exception, match="null or NaN"):
        points(df, "i", ["a", "b"]).collect()
    arrays = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, None)], "i long, v array<double>")
    assert [r["id"] for r in points(arrays, "i", "v", "drop", dims=2).collect()] == [2]
    with pytest.raises(ValueError):
        points(df, "i", ["a"], "keep")


def test_lists_and_rows(spark):
    pairs = spark.createDataFrame([(1, 4, 2.0), (1, 3, 2.0), (1, 5, 1.0), (2, 9, 0.5)], "query_id long, neighbor_id long, d2 double")
    top = top_k(pairs, 2)
    assert {(r["query_id"], r["neighbor_id"], r["rank"]) for r in top.collect()} == {(1, 5, 1), (1, 3, 2), (2, 9, 1)}
    lists = {r["query_id"]: [(n["value"], n["array_idx"]) for n in r["neighbors"]] for r in nested(top).collect()}
    assert lists == {1: [(1.0, 5), (2.0, 3)], 2: [(0.5, 9)]}
    assert {tuple(r) for r in flat(nested(top)).collect()} == {tuple(r) for r in top.collect()}
    merged = merge_top_k([top, pairs], 3)
    assert {(r["query_id"], r["neighbor_id"], r["rank"]) for r in merged.collect()} == {(1, 5, 1), (1, 3, 2), (1, 4, 3), (2, 9, 1)}
    assert [r["neighbor_id"] for r in sorted_neighbours(merged.where("query_id = 1")).collect()] == [5, 3, 4]


def test_top_k_keeps_k_before_the_shuffle(spark):
    plan = top_k(spark.range(100).selectExpr("id % 3 query_id", "id neighbor_id", "rand() d2"), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=25), st.integers(1, 6), st.integers(1, 6))
def test_any_points(spark, coords, k, cell_rows):
    pts = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(coords)]
    assert as_dict(knn(frame(spark, pts, 2), k, KnnConfig(cell_rows=cell_rows, block_rows=3))) == brute(pts, pts, k)


def test_random_points(spark):
    rows_ = random_points(spark, 50, 3).collect()
    assert len(rows_) == 50 and all(0 <= x < 1 for r in rows_ for x in r["coords"]) and len({tuple(r["coords"]) for r in rows_}) == 50


def test_config_is_checked():
    for bad in ({"k": 0}, {"dims": 0}, {"dtype": "f16"}, {"policy": "x"}, {"invalid": "x"}, {"cell_rows": 0}, {"tolerance": 0.0}, {"compute": "f8"}):
        with pytest.raises(ValueError):
            KnnConfig(**bad)
    assert KnnConfig().k == 300
