"""The engine's registered queries over the given tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT_K, KnnConfig
from .functions import box_distance, hyperplane_offset, right_of, sq_distance, sq_distance_float32
from .operators import stats
from .operators.cells import CellTree, Node, cell_offsets, cell_table, global_numbers, level_tree, owner_of, sample_tree, sketch_tree, with_cell
from .operators.clusters import assignment, borders, merged_peaks
from .operators.density import density_peaks as peaks_of
from .operators.density import kstar_density as kstar_of
from .operators.density import two_nn_dimension
from .operators.knn import knn, knn_columns, knn_join, radius_join, routes
from .operators.points import points
from .operators.topk import flat, merge_top_k, nested, sorted_neighbours
from .plans.pipeline import run
from .sources import node_lines, read_neighbours, read_points, write_cells, write_neighbours, write_points
from .staging import scratch_path, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART = ["p_size", "p_retailprice"]
#: Configurations that make many cells of the test tables, so that both phases have work.
SMALL_CELLS = KnnConfig(cell_rows=256, block_rows=128)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- views of the tables as points ------------------------------------------------


def emb64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def emb5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five dimensions of each embedding: a view of points in five dimensions, not a shortened table."""
    return points(table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 5).alias("e")), "vec_id", "e")


def part2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(table(spark, sf_dir, "part"), "p_partkey", PART)


def ties2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 13).alias("x"), (F.col("p_size") % 7).alias("y")), "p_partkey", ["x", "y"])


def fixed_tree() -> CellTree:
    """Part points in four cells: split by price at 950, and each side by size at 25."""
    low, high = np.array([-np.inf, -np.inf]), np.array([np.inf, np.inf])
    left, right = np.array([np.inf, 950.0]), np.array([-np.inf, 950.0])
    return CellTree(2, [
        Node(0, low, high, None, 1, 950.0, 1, 2),
        Node(1, low, left, None, 0, 25.0, 3, 4),
        Node(1, right, high, None, 0, 25.0, 5, 6),
        Node(2, low, np.array([25.0, 950.0]), 0),
        Node(2, np.array([25.0, -np.inf]), left, 1),
        Node(2, right, np.array([25.0, np.inf]), 2),
        Node(2, np.array([25.0, 950.0]), high, 3),
    ])


CELL = "CASE WHEN p_retailprice > 950 THEN CASE WHEN p_size > 25 THEN 3 ELSE 2 END ELSE CASE WHEN p_size > 25 THEN 1 ELSE 0 END END"


def _knn_sql(view: str, k: int, other: str | None = None) -> str:
    """Neighbours by brute force over a view (id, v); `other` is the view of the queries, if another."""
    return f"""
        WITH base AS ({view}), queries AS ({other or view}),
        pairs AS (SELECT q.id AS query_id, p.id AS neighbor_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM queries q, base p),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) AS rank FROM pairs)
        SELECT query_id, neighbor_id, d2, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k}
    """


EMB64 = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
EMB5 = "SELECT vec_id AS id, CAST(embedding[1:5] AS DOUBLE[]) AS v FROM embeddings"
PART2 = "SELECT p_partkey AS id, [CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE)] AS v FROM part"
TIES2 = "SELECT p_partkey AS id, [CAST(p_partkey % 13 AS DOUBLE), CAST(p_size % 7 AS DOUBLE)] AS v FROM part"
SUPPLIER2 = "SELECT s_suppkey AS id, [CAST(s_nationkey AS DOUBLE), CAST(s_acctbal AS DOUBLE)] AS v FROM supplier"
CUSTOMER2 = "SELECT c_custkey AS id, [CAST(c_nationkey AS DOUBLE), CAST(c_acctbal AS DOUBLE)] AS v FROM customer"


# --- statistics -------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT {i} AS dim, '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count({c}) AS n FROM lineitem" for i, c in enumerate(LINE)))
def stats_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_std(table(spark, sf_dir, "lineitem"), LINE).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT CAST(min(p_size) AS DOUBLE) AS lo_p_size, CAST(max(p_size) AS DOUBLE) AS hi_p_size, min(p_retailprice) AS lo_p_retailprice, max(p_retailprice) AS hi_p_retailprice FROM part")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bounding_box(table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), PART)


@query("""
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi FROM lineitem, b)
    SELECT bin, round(lo + bin * ((hi - lo) / 20), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS high, count(*) AS n FROM c GROUP BY bin, lo, hi
""")
def histogram20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("SELECT 100000.0::DOUBLE AS x, count(*) FILTER (o_totalprice <= 100000) AS n_below, count(*) AS n, count(*) FILTER (o_totalprice <= 100000) / count(*) AS share FROM orders")
def cdf_at_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cdf_at(table(spark, sf_dir, "orders"), "o_totalprice", 100000)


@query("SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS share, unnest(quantile_cont(p_retailprice, [0.25, 0.5, 0.75])) AS x FROM part")
def quantile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.exact_quantiles(table(spark, sf_dir, "part"), "p_retailprice", [0.25, 0.5, 0.75])


@query("""
    WITH c AS (SELECT DISTINCT o_totalprice AS x, count(*) OVER (ORDER BY o_totalprice) / count(*) OVER () AS cdf FROM orders)
    SELECT share, min(x) AS x, min(cdf) AS reached FROM (SELECT unnest([0.25, 0.5, 0.77])::DOUBLE AS share), c WHERE cdf >= share - 1e-12 GROUP BY share
""")
def quantile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split points by histograms that close in until no tolerance is left: the least value at which a share is reached."""
    orders = table(spark, sf_dir, "orders")
    found = [(s, *stats.quantile_search(orders, "o_totalprice", s, tolerance=1e-12)) for s in (0.25, 0.5, 0.77)]
    return spark.createDataFrame(found, "share double, x double, reached double")


@query("""
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS total FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, (hi - lo) / 20 AS width, total, count(*) AS n FROM lineitem, b GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (ORDER BY bin) / total AS y1, (sum(n) OVER (ORDER BY bin) - n) / total AS y0 FROM c),
    f AS (SELECT share, min(bin) AS bin FROM s, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS share) WHERE y1 >= share GROUP BY share)
    SELECT share, bin, round(lo + width * bin + (share - y0) / (y1 - y0) * width, 4) AS x FROM f JOIN s USING (bin)
""")
def quantile_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    found = [stats.histogram_quantile(line, "l_extendedprice", s).select(F.lit(s).alias("share"), "bin", F.round("x", 4).alias("x")) for s in (0.1, 0.5, 0.9)]
    return found[0].union(found[1]).union(found[2])


@query("""
    WITH r AS (SELECT p_size, p_retailprice, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice) AS i, count(*) OVER (PARTITION BY p_size) AS n FROM part)
    SELECT p_size, p_retailprice AS median, n FROM r WHERE i = n // 2 + 1
""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.upper_median(table(spark, sf_dir, "part"), "p_retailprice", ["p_size"])


ENDLESS = "CASE p_partkey % 40 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN '-Infinity'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE ELSE p_retailprice END"


@query(f"""
    WITH p AS (SELECT {ENDLESS} AS x FROM part), r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS place, count(*) OVER () AS n FROM p),
    s AS (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.9, 0.96, 1.0])::DOUBLE AS share),
    a AS (SELECT DISTINCT share, share * (n - 1) AS position FROM s, (SELECT n FROM r LIMIT 1)),
    e AS (SELECT share, position, l.x AS lower, u.x AS upper FROM a JOIN r l ON l.place = floor(position) JOIN r u ON u.place = ceil(position)),
    f AS (SELECT share, CASE WHEN lower = upper THEN lower ELSE (1 - (position - floor(position))) * lower + (position - floor(position)) * upper END AS x FROM e)
    SELECT 'quantile' AS what, share, CASE WHEN isnan(x) THEN 'NaN' WHEN isinf(x) THEN CASE WHEN x > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE 'number' END AS kind, CASE WHEN isfinite(x) THEN x END AS x FROM f
    UNION ALL SELECT 'median', g, CASE WHEN isnan(x) THEN 'NaN' WHEN isinf(x) THEN CASE WHEN x > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE 'number' END, CASE WHEN isfinite(x) THEN x END
    FROM (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM (SELECT CAST(p_partkey % 10 AS DOUBLE) AS g, {ENDLESS} AS x FROM part)) WHERE place = n // 2
""")
def quantile_not_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles and medians of a column with NaN and both infinities: in the order that has NaN last."""
    x = F.expr("CASE p_partkey % 40 WHEN 0 THEN double('NaN') WHEN 1 THEN double('-Infinity') WHEN 2 THEN double('Infinity') ELSE p_retailprice END")
    df = table(spark, sf_dir, "part").select(x.alias("x"), (F.col("p_partkey") % 10).cast("double").alias("g"))
    found = stats.exact_quantiles(df, "x", [0.0, 0.01, 0.25, 0.5, 0.9, 0.96, 1.0]).select(F.lit("quantile").alias("what"), "share", "x")
    medians = stats.upper_median(df, "x", ["g"]).select(F.lit("median").alias("what"), F.col("g").alias("share"), F.col("median").alias("x"))
    number = stats.finite(F.col("x"))
    return found.unionByName(medians).select("what", "share", F.when(number, "number").otherwise(F.col("x").cast("string")).alias("kind"), F.when(number, F.col("x")).alias("x"))


# --- distances --------------------------------------------------------------------


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, (a.p_size - b.p_size)::DOUBLE * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) AS d2 FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey")
def sq_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    a, b = (part.select(*[F.col(c).alias(f"{side}_{c}") for c in part.columns]) for side in "ab")
    return a.join(b, F.col("a_p_partkey") + 1 == F.col("b_p_partkey")).select(F.col("a_p_partkey").alias("a"), F.col("b_p_partkey").alias("b"), sq_distance([f"a_{c}" for c in PART], [f"b_{c}" for c in PART]).alias("d2"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CAST((a.p_size::FLOAT - b.p_size::FLOAT) * (a.p_size::FLOAT - b.p_size::FLOAT) + (a.p_retailprice::FLOAT - b.p_retailprice::FLOAT) * (a.p_retailprice::FLOAT - b.p_retailprice::FLOAT) AS DOUBLE) AS d2 FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey")
def float32_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", *PART)
    a, b = (part.select(*[F.col(c).alias(f"{side}_{c}") for c in part.columns]) for side in "ab")
    d2 = sq_distance_float32([f"a_{c}" for c in PART], [f"b_{c}" for c in PART])
    return a.join(b, F.col("a_p_partkey") + 1 == F.col("b_p_partkey")).select(F.col("a_p_partkey").alias("a"), F.col("b_p_partkey").alias("b"), d2.cast("double").alias("d2"))


@query("SELECT p_partkey, pow(greatest(10.0::DOUBLE - p_size, 0, p_size - 20.0::DOUBLE), 2) + pow(greatest(920.0::DOUBLE - p_retailprice, 0, p_retailprice - 950.0::DOUBLE), 2) AS d2 FROM part")
def box_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", box_distance([F.col("p_size").cast("double"), "p_retailprice"], [F.lit(10.0), F.lit(920.0)], [F.lit(20.0), F.lit(950.0)]).alias("d2"))


@query("SELECT p_partkey, p_retailprice - 950.0::DOUBLE AS offset_, p_retailprice > 950.0::DOUBLE AS is_right FROM part")
def hyperplane_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", hyperplane_offset("p_retailprice", 950.0).alias("offset_"), right_of("p_retailprice", 950.0).alias("is_right"))


# --- cells ------------------------------------------------------------------------


@query(f"SELECT p_partkey AS id, CAST({CELL} AS INTEGER) AS cell FROM part")
def cell_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cell(part2(spark, sf_dir), fixed_tree()).select("id", "cell")


@query(f"SELECT CAST({CELL} AS INTEGER) AS cell, count(*) AS n, CAST(min(p_size) AS DOUBLE) AS lo0, CAST(max(p_size) AS DOUBLE) AS hi0, min(p_retailprice) AS lo1, max(p_retailprice) AS hi1 FROM part GROUP BY 1")
def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cell_table(with_cell(part2(spark, sf_dir), fixed_tree()), 2)
    return cells.select("cell", "n", *[F.col(c)[i].alias(f"{c}{i}") for i in range(2) for c in ("lo", "hi")])


@query(f"WITH c AS (SELECT CAST({CELL} AS INTEGER) AS cell, count(*) AS n FROM part GROUP BY 1) SELECT cell, n, CAST(sum(n) OVER (ORDER BY cell) - n AS BIGINT) AS start FROM c")
def cell_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_offsets(with_cell(part2(spark, sf_dir), fixed_tree()))


@query(f"SELECT p_partkey AS id, CAST({CELL} AS INTEGER) AS cell, row_number() OVER (ORDER BY {CELL}, p_partkey) - 1 AS number FROM part")
def point_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_numbers(with_cell(part2(spark, sf_dir), fixed_tree())).select("id", "cell", F.col("number").cast("long").alias("number"))


@query(f"SELECT row_number() OVER (ORDER BY {CELL}, p_partkey) - 1 AS number, CAST({CELL} AS INTEGER) AS cell FROM part")
def number_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    celled = with_cell(part2(spark, sf_dir), fixed_tree())
    return owner_of(global_numbers(celled).select(F.col("number").cast("long").alias("number")), cell_offsets(celled))


def _node_line(level: str, owner: str, dim: str, value: str, bounds: list[str]) -> str:
    return " || ',' || ".join([level, owner, dim, value, *bounds])


_LOW, _HIGH = "'-Infinity'", "'Infinity'"


@query(f"""
    WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
    r AS (SELECT x, y, row_number() OVER (ORDER BY y) AS i, count(*) OVER () AS n FROM p),
    top AS (SELECT y AS a FROM r WHERE i = n // 2),
    h AS (SELECT x, y, y > a AS side FROM p, top),
    q AS (SELECT y, side, row_number() OVER (PARTITION BY side ORDER BY y) AS i, count(*) OVER (PARTITION BY side) AS n FROM h),
    cuts AS (SELECT max(y) FILTER (NOT side) AS b, max(y) FILTER (side) AS c FROM q WHERE i = n // 2),
    s AS (SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(c AS VARCHAR) AS c, (SELECT bool_and(wide) FROM (SELECT max(y) - min(y) > max(x) - min(x) AS wide FROM h GROUP BY side)) AS wide FROM top, cuts)
    SELECT 0 AS place, {_node_line("'0'", "'-1'", "'1'", "a", [_LOW, _LOW, _HIGH, _HIGH])} AS line FROM s WHERE wide
    UNION ALL SELECT 1, {_node_line("'1'", "'-1'", "'1'", "b", [_LOW, _LOW, _HIGH, "a"])} FROM s
    UNION ALL SELECT 2, {_node_line("'2'", "'0'", "'-1'", "'0.0'", [_LOW, _LOW, _HIGH, "b"])} FROM s
    UNION ALL SELECT 3, {_node_line("'2'", "'1'", "'-1'", "'0.0'", [_LOW, "b", _HIGH, "a"])} FROM s
    UNION ALL SELECT 4, {_node_line("'1'", "'-1'", "'1'", "c", [_LOW, "a", _HIGH, _HIGH])} FROM s
    UNION ALL SELECT 5, {_node_line("'2'", "'2'", "'-1'", "'0.0'", [_LOW, "a", _HIGH, "c"])} FROM s
    UNION ALL SELECT 6, {_node_line("'2'", "'3'", "'-1'", "'0.0'", [_LOW, "c", _HIGH, _HIGH])} FROM s
""")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a tree of four cells made from all parts, as lines of text; the price is the widest dimension throughout."""
    return node_lines(sample_tree(part2(spark, sf_dir), 4, 2, exact=True), spark)


def _price_tree(cells: int) -> CellTree:
    """Cells by price, each ten wide but the first and the last, found by halves."""
    tree, endless = CellTree(1), np.array([np.inf])

    def add(level: int, first: int, last: int, low: np.ndarray, high: np.ndarray) -> int:
        place = len(tree.nodes)
        tree.nodes.append(Node(level, low, high, first if first == last else None))
        if first < last:
            middle = (first + last) // 2
            cut = np.array([900.0 + 10 * middle])
            node = tree.nodes[place]
            node.dim, node.value = 0, float(cut[0])
            node.left, node.right = add(level + 1, first, middle, low, cut), add(level + 1, middle + 1, last, cut, high)
        return place

    add(0, 0, cells - 1, -endless, endless)
    return tree


@query("SELECT p_partkey AS id, CAST(count(t.i) AS INTEGER) AS cell FROM part LEFT JOIN (SELECT unnest(range(127)) AS i) t ON p_retailprice > 900 + 10 * t.i GROUP BY p_partkey")
def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128 cells, more than a CASE expression is made for: points are looked up in the nodes' arrays."""
    pts = points(table(spark, sf_dir, "part"), "p_partkey", ["p_retailprice"])
    return with_cell(pts, _price_tree(128)).select("id", "cell")


@query(f"""
    WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, CAST({CELL} AS INTEGER) AS cell FROM part),
    c AS (SELECT cell, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p GROUP BY cell)
    SELECT p_partkey AS q, c.cell FROM p JOIN c ON p.cell != c.cell AND pow(greatest(lx - x, 0, x - hx), 2) + pow(greatest(ly - y, 0, y - hy), 2) <= 4
""")
def route_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    celled = with_cell(part2(spark, sf_dir), fixed_tree())
    return routes(celled.select(F.col("id").alias("q"), "coords", "cell", F.lit(4.0).alias("bound")), cell_table(celled, 2), fixed_tree()).select("q", "cell")


@query("""
    WITH d AS (SELECT o_orderkey AS id, o_totalprice AS x FROM orders), n AS (SELECT count(*) AS n FROM d),
    p AS (SELECT *, row_number() OVER (ORDER BY x) AS r FROM d),
    cut AS (SELECT (SELECT x FROM p WHERE r = n // 2) AS mid FROM n),
    half AS (SELECT id, x, CASE WHEN x > mid THEN 1 ELSE 0 END AS side FROM d, cut),
    q AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY x) AS r, count(*) OVER (PARTITION BY side) AS m FROM half),
    cuts AS (SELECT side, max(x) FILTER (r = m // 2) AS mid FROM q GROUP BY side)
    SELECT id, CAST(2 * side + CASE WHEN x > mid THEN 1 ELSE 0 END AS INTEGER) AS cell FROM half JOIN cuts USING (side)
""")
def tree_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cells of as many points each, by medians of all rows, be the sample all of them or a part."""
    pts = points(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"])
    return with_cell(pts, sample_tree(pts, 4, 1, exact=True)).select("id", "cell")


@query("""
    WITH d AS (SELECT o_orderkey AS id, o_totalprice AS x FROM orders), n AS (SELECT count(*) AS n FROM d),
    p AS (SELECT *, row_number() OVER (ORDER BY x) AS r FROM d),
    cut AS (SELECT (SELECT x FROM p WHERE r = (n + 1) // 2) AS mid FROM n),
    half AS (SELECT id, x, CASE WHEN x > mid THEN 1 ELSE 0 END AS side FROM d, cut),
    q AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY x) AS r, count(*) OVER (PARTITION BY side) AS m FROM half),
    cuts AS (SELECT side, max(x) FILTER (r = (m + 1) // 2) AS mid FROM q GROUP BY side)
    SELECT id, CAST(2 * side + CASE WHEN x > mid THEN 1 ELSE 0 END AS INTEGER) AS cell FROM half JOIN cuts USING (side)
""")
def tree_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cells by medians that are read from sketches of all rows, or, where these do not hold them, counted around what they say."""
    pts = points(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"])
    return with_cell(pts, sketch_tree(pts, 4, 1, k=65535, exact=True)).select("id", "cell")


def _tree_checks(policy: str) -> str:
    return f"""
        WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), n AS (SELECT count(*) AS n FROM p),
        root AS (SELECT {"'y'" if policy == "widest" else "'x'"} AS dim FROM p WHERE (SELECT max(y) - min(y) > max(x) - min(x) FROM p) LIMIT 1)
        SELECT 8 AS cells, n AS points, true AS even, true AS inside, dim FROM n, root
    """


def _level_checks(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    """What must hold of a tree of eight cells made from all points, whatever the splits: every point in one cell, cells of a like
    number of points, boxes that hold their points, and the dimension that the root splits."""
    pts = part2(spark, sf_dir)
    tree = level_tree(pts, 8, 2, policy, accuracy=10_000)
    cells = cell_table(with_cell(pts, tree), 2)
    bounds = spark.createDataFrame([(n.cell, n.low.tolist(), n.high.tolist()) for n in tree.nodes if n.cell is not None], "of int, low array<double>, high array<double>")
    held = cells.join(bounds, F.col("cell") == F.col("of"))
    inside = [(F.col("lo")[i] >= F.col("low")[i]) & (F.col("hi")[i] <= F.col("high")[i]) for i in range(2)]
    even = F.max("n") <= 1.25 * F.min("n")
    return held.agg(F.count(F.lit(1)).cast("int").alias("cells"), F.sum("n").alias("points"), even.alias("even"), F.every(inside[0] & inside[1]).alias("inside"), F.lit("xy"[tree.nodes[0].dim]).alias("dim"))


@query(_tree_checks("widest"))
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level_checks(spark, sf_dir, "widest")


@query(_tree_checks("round_robin"))
def tree_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level_checks(spark, sf_dir, "round_robin")


@query(f"SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST({CELL} AS INTEGER) AS cell FROM part")
def cell_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written by cell and read back, the cell from the folder's name."""
    path = scratch_path(spark, "cells")
    write_cells(with_cell(part2(spark, sf_dir), fixed_tree()), path)
    return spark.read.parquet(path).select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"), F.col("cell").cast("int").alias("cell"))


# --- neighbours -------------------------------------------------------------------


@query(_knn_sql(EMB64, 10))
def knn_self_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(emb64(spark, sf_dir), 10)


@query(_knn_sql(SUPPLIER2, 10))
def knn_self_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_columns(points(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_nationkey", "s_acctbal"]), 10, KnnConfig(cell_rows=16))


@query(_knn_sql(PART2, 10))
def knn_two_phase_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(part2(spark, sf_dir), 10, SMALL_CELLS)


@query(_knn_sql(EMB5, 10))
def knn_two_phase_5d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(emb5(spark, sf_dir), 10, KnnConfig(cell_rows=64, block_rows=64))


@query(_knn_sql(TIES2, 30))
def knn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(ties2(spark, sf_dir), 30, KnnConfig(cell_rows=16, block_rows=8))


@query(_knn_sql("SELECT n_nationkey::BIGINT AS id, [CAST(n_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE)] AS v FROM nation", 300))
def knn_k_gt_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(points(table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"]), 300, KnnConfig(cell_rows=4))


@query(_knn_sql(PART2, 1))
def knn_k1_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(part2(spark, sf_dir), 1, SMALL_CELLS)


@query(_knn_sql(SUPPLIER2, 5, CUSTOMER2))
def knn_query_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = points(table(spark, sf_dir, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"])
    return knn_join(queries, points(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_nationkey", "s_acctbal"]), 5, KnnConfig(cell_rows=32))


def _rows_sql(queries: str, base: str, k: int) -> str:
    """Neighbours by brute force where ids repeat: a list for each row of `queries` (n, id, v) over all rows of `base` (id, v)."""
    return f"""
        WITH base AS ({base}), queries AS ({queries}),
        pairs AS (SELECT q.n, q.id AS query_id, p.id AS neighbor_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM queries q, base p),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY d2, neighbor_id) AS rank FROM pairs)
        SELECT query_id, neighbor_id, d2, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k}
    """


@query(_rows_sql("SELECT s_suppkey AS n, s_suppkey % 7 AS id, [CAST(s_nationkey AS DOUBLE), CAST(s_acctbal AS DOUBLE)] AS v FROM supplier", "SELECT c_custkey % 50 AS id, [CAST(c_nationkey AS DOUBLE), floor(c_acctbal / 1000)] AS v FROM customer", 6))
def knn_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and points whose ids repeat, at one place and at several: each row stands for itself."""
    queries = points(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("id"), "s_nationkey", "s_acctbal"), "id", ["s_nationkey", "s_acctbal"])
    base = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("id"), "c_nationkey", F.expr("floor(c_acctbal / 1000)").alias("x"))
    return knn_join(queries, points(base, "id", ["c_nationkey", "x"]), 6, KnnConfig(cell_rows=32))


@query(f"SELECT query_id, count(*) AS n, CAST(sum(neighbor_id) AS BIGINT) AS ids, max(d2) AS radius, CAST(sum(rank) AS BIGINT) AS ranks FROM ({_knn_sql(PART2, 300)}) GROUP BY query_id")
def knn_k300(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual number of neighbours, in cells that hold fewer points than that."""
    near = knn(part2(spark, sf_dir), DEFAULT_K, SMALL_CELLS)
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("neighbor_id").alias("ids"), F.max("d2").alias("radius"), F.sum("rank").alias("ranks"))


@query(f"SELECT query_id, count(*) AS n, CAST(sum(neighbor_id) AS BIGINT) AS ids, max(d2) AS radius, CAST(sum(rank) AS BIGINT) AS ranks FROM ({_knn_sql(PART2, 120)}) GROUP BY query_id")
def knn_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More neighbours than a cell has points, visiting the nearest cells first, one in the first round."""
    near = knn(part2(spark, sf_dir), 120, KnnConfig(cell_rows=48, block_rows=48, first_routes=1))
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("neighbor_id").alias("ids"), F.max("d2").alias("radius"), F.sum("rank").alias("ranks"))


@query(_knn_sql(PART2, 7))
def knn_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More cells than may be shipped: eight are, and those below them are a table."""
    return knn(part2(spark, sf_dir), 7, KnnConfig(cell_rows=32, block_rows=64, routed_cells=8))


@query(_knn_sql(CUSTOMER2, 10))
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are one block each, whose index a task searches."""
    return knn(points(table(spark, sf_dir, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"]), 10, KnnConfig(cell_rows=2048, block_rows=4096))


@query(_knn_sql(EMB64, 10))
def knn_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 dimensions in cells of pivots; where these exclude too little, all blocks meet."""
    return knn(emb64(spark, sf_dir), 10, KnnConfig(cell_rows=32, block_rows=64))


@query(f"SELECT p.place, neighbor_id, d2, rank FROM ({_knn_sql(PART2, 3)}) k JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part) p ON k.query_id = p.p_partkey")
def neighbour_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours written as packed pairs and read back; a query is its place in order."""
    path = scratch_path(spark, "neighbours")
    write_neighbours(nested(knn(part2(spark, sf_dir), 3)), path)
    return read_neighbours(spark, path, 3)


NATION2 = "SELECT n_nationkey::BIGINT AS id, [CAST(n_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE)] AS v FROM nation"


@query(f"SELECT p.place, neighbor_id, d2, rank FROM ({_knn_sql(NATION2, 40, CUSTOMER2)}) k JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) p ON k.query_id = p.c_custkey")
def neighbour_files_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that are shorter than k, as there are fewer points, written as packed pairs and read back."""
    path = scratch_path(spark, "neighbours")
    queries = points(table(spark, sf_dir, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"])
    write_neighbours(nested(knn_join(queries, points(table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"]), 40)), path, 40)
    return read_neighbours(spark, path)


@query(f"""
    WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, [CAST(p_size::FLOAT AS DOUBLE), CAST(p_retailprice::FLOAT AS DOUBLE)] AS v FROM part)
    SELECT query_id, count(*) AS n, string_agg(neighbor_id, ',' ORDER BY rank) AS ids, max(d2) AS radius, true AS in_cell FROM ({_knn_sql("SELECT id, v FROM r", 4)}) GROUP BY query_id
""")
def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over a raw file of 32-bit floats: points, statistics, cells, nodes and neighbours written; the neighbours
    read back, and whether the point lies in the cell of the written nodes whose folder it is in."""
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "run")
    write_points(part2(spark, sf_dir), raw, "f32")
    run(spark, raw, KnnConfig(k=4, dims=2, dtype="f32", cell_rows=500), out)
    node = F.split("value", ",").cast("array<double>")
    leaves = spark.read.text(f"{out}/nodes").select(node.alias("n")).where("n[1] >= 0").select(F.col("n")[1].cast("int").alias("owner"), F.slice("n", 5, 2).alias("low"), F.slice("n", 7, 2).alias("high"))
    inside = F.forall(F.arrays_zip("coords", "low", "high"), lambda z: (z["coords"] > z["low"]) & (z["coords"] <= z["high"]))
    placed = spark.read.parquet(f"{out}/points").join(leaves, F.col("cell") == F.col("owner")).select("id", inside.alias("in_cell"))
    near = spark.read.parquet(f"{out}/neighbours").join(placed, F.col("query_id") == F.col("id"))
    return near.select("query_id", F.size("neighbors").cast("long").alias("n"), F.array_join(F.col("neighbors.array_idx").cast("array<string>"), ",").alias("ids"), F.array_max("neighbors.value").alias("radius"), "in_cell")


@query("""
    SELECT unnest(['points', 'stats', 'cells', 'neighbours', 'offsets']) AS phase, unnest([n, 2, n, 4 * n, 4]) AS rows, true AS timed FROM (SELECT count(*) AS n FROM part)
""")
def run_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each phase of a run, as its own passes count them."""
    raw = scratch_path(spark, "raw")
    write_points(part2(spark, sf_dir), raw, "f64")
    n = table(spark, sf_dir, "part").count()
    return run(spark, raw, KnnConfig(k=4, dims=2, cell_rows=-(-n // 4))).phases.select("phase", "rows", (F.col("seconds") > 0).alias("timed"))


@query(f"SELECT query_id, string_agg(neighbor_id, ',' ORDER BY rank) AS ids, max(d2) AS radius FROM ({_knn_sql(EMB64, 5)}) GROUP BY query_id")
def knn_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = nested(knn(emb64(spark, sf_dir), 5))
    return lists.select("query_id", F.array_join(F.col("neighbors.array_idx").cast("array<string>"), ",").alias("ids"), F.array_max("neighbors.value").alias("radius"))


@query(_knn_sql(PART2, 3))
def knn_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(nested(knn(part2(spark, sf_dir), 3))).withColumn("rank", F.col("rank").cast("int"))


@query("SELECT a.p_partkey AS query_id, b.p_partkey AS neighbor_id, CAST(a.p_size - b.p_size AS DOUBLE) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) AS d2 FROM part a JOIN part b ON abs(a.p_size - b.p_size) <= 1 AND abs(a.p_retailprice - b.p_retailprice) <= 1 WHERE CAST(a.p_size - b.p_size AS DOUBLE) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) <= 1")
def knn_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = part2(spark, sf_dir)
    return radius_join(pts, pts, 1.0, SMALL_CELLS)


@query(f"""
    SELECT a.label, count(*) AS n, count(*) FILTER (a.label = b.label) AS same FROM ({_knn_sql(EMB64, 10)}) k
    JOIN embeddings a ON k.query_id = a.vec_id JOIN embeddings b ON k.neighbor_id = b.vec_id WHERE query_id != neighbor_id GROUP BY a.label
""")
def knn_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = knn(emb64(spark, sf_dir), 10).where("query_id != neighbor_id")
    named = near.join(labels.withColumnRenamed("vec_id", "query_id"), "query_id").join(labels.select(F.col("vec_id").alias("neighbor_id"), F.col("label").alias("other")), "neighbor_id")
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("other")).alias("same"))


@query(f"""
    WITH near AS (SELECT query_id, min(d2) AS a, max(d2) AS b FROM ({_knn_sql(EMB5, 3)}) WHERE rank > 1 GROUP BY query_id HAVING count(*) = 2 AND min(d2) > 0)
    SELECT count(*) AS n, round(count(*) / sum(ln(b / a) / 2), 6) AS dimension FROM near
""")
def two_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_nn_dimension(knn(emb5(spark, sf_dir), 3)).withColumn("dimension", F.round("dimension", 6))

#: Densities by the rule of `operators.density.kstar_density`, in two dimensions and lists of 40.
_KSTAR = f"""
    near AS ({_knn_sql(PART2, 40)}),
    pair AS (SELECT a.query_id, a.rank - 1 AS k, a.d2 AS own, c.d2 AS other FROM near a JOIN near b ON a.query_id = b.query_id AND b.rank = a.rank + 1 JOIN near c ON c.query_id = b.neighbor_id AND c.rank = a.rank WHERE a.rank > 3),
    stop AS (SELECT query_id, min(k) AS first FROM pair WHERE CASE WHEN own > 0 AND other > 0 THEN 2 * k * ln((own + other) * (own + other) / (4 * own * other)) WHEN own = other THEN 0 ELSE 'Infinity'::DOUBLE END >= 23.92812698 GROUP BY query_id),
    most AS (SELECT query_id, max(rank) - 2 AS most FROM near GROUP BY query_id HAVING max(rank) - 2 >= 3),
    star AS (SELECT query_id, CAST(coalesce(first - 1, most) AS INTEGER) AS kstar FROM most LEFT JOIN stop USING (query_id)),
    dense AS (SELECT s.query_id, kstar, d2, CASE WHEN d2 > 0 THEN kstar / (pi() * (SELECT count(*) FROM part) * d2) ELSE 'Infinity'::DOUBLE END AS density FROM star s JOIN near n ON s.query_id = n.query_id AND n.rank = s.kstar + 1)
"""


def _kstar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pts = part2(spark, sf_dir)
    near = knn(pts, 40)
    return near, kstar_of(near, 2, pts.count())


@query(f"WITH {_KSTAR} SELECT query_id, kstar, d2, round(density, 9) AS density FROM dense")
def kstar_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kstar(spark, sf_dir)[1].withColumn("density", F.round("density", 9))


#: The peak that each point climbs to.
_PEAKS = """
    step AS (SELECT d.query_id, coalesce(arg_min(n.neighbor_id, n.rank), d.query_id) AS up FROM dense d LEFT JOIN (SELECT n.*, o.density AS other FROM near n JOIN dense o ON n.neighbor_id = o.query_id WHERE n.query_id != n.neighbor_id) n
             ON d.query_id = n.query_id AND n.rank <= d.kstar + 1 AND (n.other > d.density OR n.other = d.density AND n.neighbor_id < d.query_id) GROUP BY d.query_id),
    climb AS (SELECT query_id, up AS peak FROM step UNION SELECT climb.query_id, step.up FROM climb JOIN step ON climb.peak = step.query_id),
    peaks AS (SELECT climb.query_id, climb.peak FROM climb JOIN step ON climb.peak = step.query_id AND step.up = climb.peak)
"""


@query(f"WITH RECURSIVE {_KSTAR}, {_PEAKS} SELECT * FROM peaks")
def density_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak that each part climbs to, through denser and denser neighbours."""
    return peaks_of(*_kstar(spark, sf_dir))


#: How many errors a peak has to stand out by; few, as parts lie evenly and would else be one cluster.
Z = 0.3
#: The saddle of each two peaks, by the rule of `operators.clusters.borders`.
_SADDLES = """
    rated AS MATERIALIZED (SELECT d.query_id AS id, kstar, peak, ln(density) AS rho, CASE WHEN isinf(density) THEN 0 ELSE sqrt((4 * kstar + 2) / (kstar * (kstar - 1))) END AS err FROM dense d JOIN peaks p ON d.query_id = p.query_id),
    firsts AS MATERIALIZED (SELECT i.id, i.kstar, i.rho, i.err, i.peak AS own, j.peak AS other, arg_min(n.neighbor_id, n.rank) AS next, min(n.rank) AS rank FROM near n JOIN rated i ON i.id = n.query_id JOIN rated j ON j.id = n.neighbor_id WHERE i.peak != j.peak GROUP BY ALL),
    saddles AS MATERIALIZED (SELECT least(f.own, f.other) AS a, greatest(f.own, f.other) AS b, f.id AS saddle, f.rho AS log_rho, f.err FROM firsts f JOIN firsts g ON g.id = f.next AND g.next = f.id WHERE f.rank <= f.kstar + 1
                QUALIFY row_number() OVER (PARTITION BY least(f.own, f.other), greatest(f.own, f.other) ORDER BY f.err - f.rho, f.id) = 1)
"""
#: Saddles met one after another: the list `held` holds the number of each peak's cluster, numbers going by falling level.
_MERGES = f"""
    ranked AS MATERIALIZED (SELECT id AS peak, rho - {Z} * err AS level, row_number() OVER (ORDER BY rho - {Z} * err DESC, id) AS n FROM rated WHERE id = peak),
    levels AS MATERIALIZED (SELECT list(level ORDER BY n) AS heights FROM ranked),
    queue AS MATERIALIZED (SELECT row_number() OVER (ORDER BY log_rho + {Z} * err DESC, a, b) AS turn, log_rho + {Z} * err AS ceiling, x.n AS x, y.n AS y FROM saddles JOIN ranked x ON x.peak = a JOIN ranked y ON y.peak = b),
    fold AS (SELECT CAST(0 AS BIGINT) AS turn, list(n ORDER BY n) AS held FROM ranked UNION ALL
             SELECT q.turn, CASE WHEN held[x] != held[y] AND levels.heights[greatest(held[x], held[y])] < ceiling THEN list_transform(held, lambda c: CASE WHEN c = greatest(held[x], held[y]) THEN least(held[x], held[y]) ELSE c END) ELSE held END FROM fold JOIN queue q ON q.turn = fold.turn + 1, levels),
    merged AS MATERIALIZED (SELECT r.peak, c.peak AS cluster FROM ranked r, (SELECT arg_max(held, turn) AS held FROM fold) f, ranked c WHERE c.n = f.held[r.n])
"""


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    near, dense = (staged(df, "density") for df in _kstar(spark, sf_dir))
    peaks = peaks_of(near, dense)
    saddles = borders(near, dense, peaks)
    return dense, peaks, saddles, merged_peaks(dense, peaks, saddles, Z)


@query(f"WITH RECURSIVE {_KSTAR}, {_PEAKS}, {_SADDLES} SELECT a, b, saddle, round(log_rho, 9) AS log_rho, round(err, 9) AS err FROM saddles")
def peak_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The borders between the peaks of all parts, and their saddles."""
    near, dense = (staged(df, "density") for df in _kstar(spark, sf_dir))
    return borders(near, dense, peaks_of(near, dense)).withColumns({c: F.round(c, 9) for c in ("log_rho", "err")})


@query(f"WITH RECURSIVE {_KSTAR}, {_PEAKS}, {_SADDLES}, {_MERGES} SELECT * FROM merged")
def peak_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each peak, once peaks that do not stand out are merged."""
    return _merged(spark, sf_dir)[3]


@query(f"""
    WITH RECURSIVE {_KSTAR}, {_PEAKS}, {_SADDLES}, {_MERGES},
    apart AS (SELECT x.cluster AS x, y.cluster AS y, log_rho FROM saddles JOIN merged x ON x.peak = a JOIN merged y ON y.peak = b WHERE x.cluster != y.cluster),
    rims AS (SELECT c, max(log_rho) AS rim FROM (SELECT x AS c, log_rho FROM apart UNION ALL SELECT y, log_rho FROM apart) GROUP BY c),
    numbers AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS number FROM (SELECT DISTINCT cluster FROM merged))
    SELECT id AS query_id, m.cluster, CASE WHEN coalesce(rho < rim, false) THEN -number - 1 ELSE number END AS label, coalesce(rho < rim, false) AS halo
    FROM rated JOIN merged m USING (peak) JOIN numbers n ON n.cluster = m.cluster LEFT JOIN rims ON c = m.cluster
""")
def halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each part, and whether it is core or halo."""
    return assignment(*_merged(spark, sf_dir))


@query(_knn_sql(PART2, 5))
def topk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among the odd and among the even points, merged: those among all."""
    pts = part2(spark, sf_dir)
    return merge_top_k([knn_join(pts, pts.where(F.col("id") % 2 == r), 5, SMALL_CELLS) for r in (0, 1)], 5)


REPEATED2 = "SELECT p_partkey % 97 AS id, [CAST(p_size % 5 AS DOUBLE), floor(p_retailprice / 100)] AS v FROM part"


def repeated2(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("id"), (F.col("p_size") % 5).alias("x"), F.expr("floor(p_retailprice / 100)").alias("y"), (F.col("p_partkey") % 2).alias("odd"))
    return points(part.where("odd = 0"), "id", ["x", "y"]), points(part.where("odd = 1"), "id", ["x", "y"])


@query(_rows_sql("SELECT s_suppkey AS n, s_suppkey AS id, [CAST(s_nationkey % 5 AS DOUBLE), floor(s_acctbal / 1000)] AS v FROM supplier", REPEATED2, 9))
def topk_merge_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among two parts of a base whose ids and places repeat, merged: those among all, each row for itself."""
    queries = points(table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("x"), F.expr("floor(s_acctbal / 1000)").alias("y")), "s_suppkey", ["x", "y"])
    return merge_top_k([knn_join(queries, base, 9, SMALL_CELLS) for base in repeated2(spark, sf_dir)], 9, disjoint=True)


@query(f"""
    WITH k AS (SELECT n, query_id, neighbor_id, d2, rank FROM ({_rows_sql("SELECT s_suppkey AS n, s_suppkey % 7 AS id, [CAST(s_nationkey AS DOUBLE), CAST(s_acctbal AS DOUBLE)] AS v FROM supplier", CUSTOMER2, 4).replace("SELECT query_id, neighbor_id", "SELECT n, query_id, neighbor_id")}))
    SELECT query_id, ids, radius, count(*) AS queries FROM (SELECT n, any_value(query_id) AS query_id, string_agg(neighbor_id, ',' ORDER BY rank) AS ids, max(d2) AS radius FROM k GROUP BY n) GROUP BY ALL
""")
def knn_nested_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of queries whose ids repeat: one for each row."""
    queries = points(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("id"), "s_nationkey", "s_acctbal"), "id", ["s_nationkey", "s_acctbal"])
    lists = nested(knn_join(queries, points(table(spark, sf_dir, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"]), 4, keyed=True))
    told = lists.select("query_id", F.array_join(F.col("neighbors.array_idx").cast("array<string>"), ",").alias("ids"), F.array_max("neighbors.value").alias("radius"))
    return told.groupBy("query_id", "ids", "radius").agg(F.count(F.lit(1)).alias("queries"))


@query(_knn_sql(TIES2, 4))
def sort_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_neighbours(knn(ties2(spark, sf_dir), 4, SMALL_CELLS))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, CAST(p_size::FLOAT AS DOUBLE) AS x0, CAST(p_retailprice::FLOAT AS DOUBLE) AS x1 FROM part")
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as a raw file of 32-bit floats and read back; their ids are then their places."""
    path = scratch_path(spark, "raw")
    write_points(part2(spark, sf_dir), path, "f32")
    return read_points(spark, path, 2, "f32").select("id", F.col("coords")[0].alias("x0"), F.col("coords")[1].alias("x1"))
