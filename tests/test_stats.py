import numpy as np
import pytest

from vicinia.functions import box_distance, hyperplane_offset, right_of, sq_distance, sq_distance_arrays
from vicinia.operators import stats


@pytest.fixture(scope="module")
def numbers(spark):
    x = np.random.default_rng(0).normal(5, 3, 999)
    return x, spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(x)] + [(None, 0)], "x double, g int")


def test_mean_and_std(numbers):
    x, df = numbers
    row = stats.mean_std(df, ["x"]).first()
    assert row["n"] == 999 and row["mean"] == pytest.approx(x.mean()) and row["std"] == pytest.approx(x.std(ddof=1))


def test_box(numbers):
    x, df = numbers
    row = stats.bounding_box(df, ["x"]).first()
    assert (row["lo_x"], row["hi_x"]) == (x.min(), x.max())
    assert stats.bounding_box(df, ["x"], ["g"]).count() == 3


def test_histogram(spark, numbers):
    x, df = numbers
    found = {r["bin"]: r["n"] for r in stats.histogram(df, "x", 20).collect()}
    assert found == {i: n for i, n in enumerate(np.histogram(x, 20)[0]) if n}
    flat = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert [(r["bin"], r["n"]) for r in stats.histogram(flat, "x").collect()] == [(0, 5)]
    assert stats.histogram(flat.limit(0), "x").count() == 0


def test_cdf_and_quantiles(spark, numbers):
    x, df = numbers
    row = stats.cdf_at(df, "x", 4.0).first()
    assert (row["n_below"], row["n"]) == ((x <= 4).sum(), 999)
    for share in (0.1, 0.5, 0.99):
        value, reached = stats.quantile_search(df, "x", share)
        assert abs(reached - share) <= 0.002 and reached == (x <= value).mean()
    assert [r["x"] for r in stats.exact_quantiles(df, "x", [0.25, 0.5]).collect()] == pytest.approx(np.quantile(x, [0.25, 0.5]))
    assert {r["g"]: r["median"] for r in stats.upper_median(df, "x", ["g"]).collect()} == {g: np.sort(x[g::3])[len(x[g::3]) // 2] for g in range(3)}


@pytest.mark.parametrize("few, bins, shipped", [(1 << 14, 256, 10_000), (5, 3, 10_000), (5, 3, 0), (1, 2, 10_000)])
def test_places_by_closing_histograms(spark, monkeypatch, few, bins, shipped):
    monkeypatch.setattr(stats, "FEW", few)
    monkeypatch.setattr(stats, "SHIPPED", shipped)
    monkeypatch.setattr(stats.at_places, "__defaults__", ((), bins))
    r = np.random.default_rng(3)
    values = np.concatenate([r.normal(0, 1, 60), np.exp(r.normal(0, 9, 40)), np.full(50, 2.5), [-1e300, 1e300]])
    data = [(float(x), None if i % 4 == 0 else i % 4) for i, x in enumerate(r.permutation(values))]
    df = spark.createDataFrame(data + [(None, 1), (None, 9)], "x double, g int")
    assert [q["x"] for q in stats.exact_quantiles(df, "x", [0.0, 0.3, 0.5, 0.501, 1.0]).collect()] == pytest.approx(np.quantile(values, [0.0, 0.3, 0.5, 0.501, 1.0]).tolist())
    want = {g: sorted(x for x, own in data if own == g) for g in (None, 1, 2, 3)}
    got = {m["g"]: (m["median"], m["n"]) for m in stats.upper_median(df, "x", ["g"]).collect()}
    assert got == {**{g: (own[len(own) // 2], len(own)) for g, own in want.items()}, 9: (None, 0)}
    assert stats.upper_median(df, "x").first()["median"] == sorted(values)[len(values) // 2]


@pytest.mark.parametrize("few", [1 << 14, 3])
def test_what_is_not_finite_has_its_place(spark, monkeypatch, few):
    """NaN, both infinities, the extremes of the numbers, neighbours among them, and constants: every search ends."""
    monkeypatch.setattr(stats, "FEW", few)
    inf, nan, tiny = float("inf"), float("nan"), 5e-324
    r = np.random.default_rng(8)
    cases = [
        [nan] + r.normal(size=40).tolist(), [inf, -inf, nan, nan] + r.normal(size=40).tolist(), [nan] * 9, [inf] * 9, [-inf, inf], [3.5] * 30 + [nan],
        [1.7e308, -1.7e308] * 9 + [0.0, nan], [1.0, np.nextafter(1.0, 2)] * 9, [0.0, tiny, 2 * tiny] * 9, [1e300, 1.0, 2.0, -1e300] * 5,
    ]
    for values in cases:
        df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)] + [(None, 0)], "x double, g int")
        order = np.sort(values)  # NaN last
        for share in (0.0, 0.5, 1.0):
            got = stats.exact_quantiles(df, "x", [share]).first()["x"]
            at = share * (len(order) - 1)
            lower, upper = order[int(np.floor(at))], order[int(np.ceil(at))]
            want = lower if lower == upper or at == int(at) else (1 - at % 1) * lower + at % 1 * upper
            assert got == pytest.approx(want, nan_ok=True), (values, share)
        medians = {m["g"]: m["median"] for m in stats.upper_median(df, "x", ["g"]).collect()}
        for g in {i % 2 for i in range(len(values))}:
            own = np.sort(values[g::2])
            assert medians[g] == pytest.approx(own[len(own) // 2], nan_ok=True)
        found = stats.quantile_search(df, "x", 0.5)
        assert found is not None and (np.isnan(found[0]) or found[1] == pytest.approx((np.array(values) <= found[0]).mean()))
        assert sum(b["n"] for b in stats.histogram(df, "x").collect()) == np.isfinite(values).sum()


def test_rounds_that_would_not_shrink_end(spark, monkeypatch):
    """One NaN or one infinity among many rows once kept every round where it was; what a search stages is deleted, too."""
    from vicinia import staging

    monkeypatch.setattr(stats, "FEW", 10)
    before = set(staging.left(spark))
    for odd in ("double('nan')", "double('inf')", "double('-inf')"):
        df = spark.range(4000).selectExpr(f"if(id = 7, {odd}, sin(id)) x")
        assert abs(stats.upper_median(df, "x").first()["median"]) < 0.01
    assert len(set(staging.left(spark)) - before) == 3


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "x double, g int")
    assert [q["x"] for q in stats.exact_quantiles(empty, "x", [0.5]).collect()] == [None]
    assert stats.upper_median(empty, "x", ["g"]).count() == 0
    assert stats.histogram_quantile(empty, "x", 0.5).count() == 0


def test_interpolated_quantile(spark, numbers):
    x, df = numbers
    counts, edges = np.histogram(x, 20)
    seen = np.cumsum(counts) / len(x)
    for share in (0.01, 0.5, 1.0):
        b = int(np.argmax(seen >= share))
        before = seen[b] - counts[b] / len(x)
        row = stats.histogram_quantile(df, "x", share).first()
        assert row["bin"] == b and row["x"] == pytest.approx(edges[b] + (share - before) / (seen[b] - before) * (edges[b + 1] - edges[b]))


def test_quantile_of_crowds(spark):
    df = spark.createDataFrame([(1.0,)] * 90 + [(2.0,)] * 10, "x double")
    assert stats.quantile_search(df, "x", 0.5) == (1.0, 0.9)  # no split comes nearer
    assert stats.quantile_search(df.where("x = 1"), "x", 0.5) == (1.0, 1.0)
    assert stats.quantile_search(df.limit(0), "x", 0.5) is None


def test_distances(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0, 6.0)], "a double, b double, c double, d double")
    row = df.selectExpr("*", "array(a, b) p", "array(c, d) q").select(
        sq_distance(["a", "b"], ["c", "d"]).alias("s"), sq_distance_arrays("p", "q").alias("t"), box_distance(["a", "d"], ["c", "c"], ["d", "d"]).alias("o"), hyperplane_offset("a", 3.0).alias("h"), right_of("a", 1.0).alias("at"), right_of("b", 1.0).alias("r")
    ).first()
    assert tuple(row) == (25.0, 25.0, 9.0, -2.0, False, True)
    with pytest.raises(ValueError):
        sq_distance(["a"], ["b", "c"])


def density_lists(spark, points, k):
    from vicinia.operators.knn import knn

    from .brute import frame

    return knn(frame(spark, points), k)


def test_kstar_and_peaks(spark):
    """Two blobs: each climbs to a peak of its own; kstar, densities and climbs as plain loops have them."""
    from vicinia.operators.density import RATIO, density_peaks, kstar_density

    r = np.random.default_rng(4)
    at = np.concatenate([r.normal(0, 1, (60, 2)), r.normal(12, 1, (50, 2)), [[3.0, 3.0]] * 4])
    points = [(int(i), c.tolist()) for i, c in enumerate(at)]
    near = density_lists(spark, points, 25)
    lists = {}
    for row in near.collect():
        lists.setdefault(row["query_id"], {})[row["rank"] - 1] = (row["neighbor_id"], row["d2"])
    want = {}
    for i, own in lists.items():
        kstar = 23
        for k in range(3, 24):
            a, b = own[k][1], lists[own[k + 1][0]][k][1]
            ratio = 2 * k * np.log((a + b) ** 2 / (4 * a * b)) if a > 0 and b > 0 else (0 if a == b else np.inf)
            if ratio >= RATIO:
                kstar = k - 1
                break
        d2 = own[kstar][1]
        want[i] = (kstar, kstar / (np.pi * 114 * d2) if d2 else np.inf)
    dense = kstar_density(near, 2, 114)
    got = {x["query_id"]: (x["kstar"], x["density"]) for x in dense.collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want) and len({k for k, _ in want.values()}) > 2
    up = {}
    for i, (kstar, rho) in got.items():
        better = [j for k, (j, _) in sorted(lists[i].items()) if k <= kstar and j != i and (got[j][1] > rho or got[j][1] == rho and j < i)]
        up[i] = better[0] if better else i

    def peak(i):
        while up[i] != i:
            i = up[i]
        return i

    found = {x["query_id"]: x["peak"] for x in density_peaks(near, dense).collect()}
    assert found == {i: peak(i) for i in got}
    assert not {found[i] for i in range(60)} & {found[i] for i in range(60, 110)}
    assert kstar_density(near.where("false"), 2, 0).count() == 0 and density_peaks(near.where("false"), dense.where("false")).count() == 0
    assert kstar_density(near.where("rank <= 3"), 2, 114).count() == 0


def test_a_hub_of_pointers_is_dealt_over_tasks(spark, monkeypatch):
    from vicinia import skew
    from vicinia.operators.density import density_peaks, kstar_density

    near = density_lists(spark, [(i, [float(np.sqrt(i))]) for i in range(90)], 40).cache()

    def both():
        dense = kstar_density(near, 1, 90)
        return [sorted(map(tuple, df.collect())) for df in (dense, density_peaks(near, dense))]

    want = both()
    assert max(np.bincount([p for _, p in want[1]])) > 30
    monkeypatch.setattr(skew, "FEW", 0)
    monkeypatch.setattr(skew, "LEAST", 4)
    monkeypatch.setattr(skew, "PARTS", 10)
    assert both() == want


def test_two_neighbour_dimension(spark):
    from vicinia.operators.density import two_nn_dimension
    from vicinia.operators.knn import knn
    from vicinia.operators.points import random_points

    row = two_nn_dimension(knn(random_points(spark, 1500, 2, 3), 3)).first()
    assert row["n"] == 1500 and 1.7 < row["dimension"] < 2.3
    assert two_nn_dimension(knn(random_points(spark, 2, 2), 3)).first()["n"] == 0
