"""Borders, merges and halo of density peaks against plain loops."""

import math

import numpy as np
import pytest

from vicinia import skew
from vicinia.operators import clusters
from vicinia.operators.density import density_peaks, kstar_density
from vicinia.operators.knn import knn
from vicinia.staging import left, scope, staged

from .brute import frame


def error(k, rho):
    if rho == math.inf:
        return 0.0
    return math.sqrt((4 * k + 2) / (k * (k - 1))) if k > 1 else math.inf


def one_after_another(peaks, saddles, z):
    """{peak: cluster} of {peak: (kstar, density)} and {(a, b): (log_rho, err)}, one saddle after another."""
    level = {p: math.log(rho) - (z * error(k, rho) if z else 0) if rho < math.inf else rho for p, (k, rho) in peaks.items()}
    cluster = {p: p for p in peaks}
    for ceiling, a, b in sorted((-s - (z * e if z else 0), a, b) for (a, b), (s, e) in saddles.items()):
        high, low = sorted((cluster[a], cluster[b]), key=lambda p: (-level[p], p))
        if high != low and level[low] < -ceiling:
            cluster = {p: high if c == low else c for p, c in cluster.items()}
    return cluster


def merged(spark, peaks, saddles, z):
    dense = spark.createDataFrame([(p, k, rho) for p, (k, rho) in peaks.items()], "query_id long, kstar int, density double")
    own = spark.createDataFrame([(p, p) for p in peaks], "query_id long, peak long")
    between = spark.createDataFrame([(a, b, a, s, e) for (a, b), (s, e) in saddles.items()], "a long, b long, saddle long, log_rho double, err double")
    return clusters.merged_peaks(dense, own, between, z)


def graph(seed, n, m):
    """Peaks and saddles on few different values, so that many are equal; a path of falling peaks whose saddles rise; a star; and odd ones."""
    r = np.random.default_rng(seed)
    peaks = {int(i): (int(k), float(rho)) for i, k, rho in zip(r.permutation(n), r.choice([4, 9, 30], n), np.exp(r.choice(np.linspace(0, 5, 12), n)))}
    saddles = {}
    for a, b in r.integers(0, n, (m, 2)).tolist():
        if a != b:
            below = min(math.log(peaks[a][1]), math.log(peaks[b][1])) - float(r.choice([0.0, 0.5, 1.0, 2.0, 3.0]))
            saddles[min(a, b), max(a, b)] = (below, float(r.choice([0.1, 0.3])))
    for i in range(40):
        peaks[n + i] = (9, math.exp(50 - i))
        if i:
            saddles[n + i - 1, n + i] = (5.0 + i / 8, 0.1)
    for i in range(1, 30):
        peaks[n + 100 + i] = (9, math.exp(20 + i % 3))
        saddles[n + 100, n + 100 + i] = (18.0 + i / 10, 0.1)
    peaks[n + 100] = (9, math.exp(20.5))
    peaks |= {n + 200: (1, 5.0), n + 201: (3, math.inf), n + 202: (9, 2.0), n + 203: (3, math.inf), n + 204: (5, 1.0)}
    saddles |= {(n + 200, n + 201): (0.0, 0.5), (n + 201, n + 203): (0.3, math.inf), (n + 202, n + 203): (0.5, 0.1)}
    return peaks, saddles


@pytest.mark.parametrize("z", [1.5, 0.0])
def test_merges_in_rounds_are_those_one_after_another(spark, monkeypatch, z):
    peaks, saddles = graph(3, 150, 400)
    rounds = []
    contracted = clusters._contracted
    monkeypatch.setattr(clusters, "_contracted", lambda edges: rounds.append(1) or contracted(edges))
    if not z:  # no error that is infinite counts
        saddles = {ends: (s, 0.0) for ends, (s, e) in saddles.items()}
    want = one_after_another(peaks, saddles, z)
    with scope(spark):
        assert dict(map(tuple, merged(spark, peaks, saddles, z).collect())) == want
    assert 20 < len(set(want.values())) < len(peaks) - 20 or not z
    assert len(rounds) <= 6


def test_peaks_with_very_many_borders(spark, monkeypatch):
    peaks, saddles = graph(5, 30, 60)
    want = one_after_another(peaks, saddles, 2.0)
    monkeypatch.setattr(skew, "FEW", 0)
    monkeypatch.setattr(skew, "LEAST", 4)
    monkeypatch.setattr(skew, "PARTS", 10)
    with scope(spark):
        assert dict(map(tuple, merged(spark, peaks, saddles, 2.0).collect())) == want


def test_nothing_to_merge(spark):
    with scope(spark):
        assert merged(spark, {1: (9, 2.0)}, {}, 1.0).where("false").count() == 0
        assert [tuple(r) for r in merged(spark, {7: (9, 2.0)}, {(1, 2): (1.0, 0.1)}, 1.0).collect()] == [(7, 7)]  # a saddle of peaks that are not there


def test_borders_and_halo(spark):
    """Two blobs that touch and one far off, with copies of a point: borders, saddles, cores and halo as plain loops have them."""
    r = np.random.default_rng(8)
    at = np.concatenate([r.normal(0, 1, (90, 2)), r.normal(4, 1, (90, 2)), r.normal(40, 1, (40, 2)), [[3.0, 3.0]] * 5])
    before = set(left(spark))
    near = staged(knn(frame(spark, [(int(i), c.tolist()) for i, c in enumerate(at)]), 20), "near")
    dense = staged(kstar_density(near, 2, len(at)), "dense")
    peaks = density_peaks(near, dense)
    saddles = clusters.borders(near, dense, peaks)
    lists = {}
    for row in sorted(near.collect(), key=lambda x: x["rank"]):
        lists.setdefault(row["query_id"], []).append(row["neighbor_id"])
    point = {x["query_id"]: (x["kstar"], x["density"]) for x in dense.collect()}
    of = {x["query_id"]: x["peak"] for x in peaks.collect()}

    def first(i, peak):
        return next(((n, j) for n, j in enumerate(lists[i]) if j in of and of[j] == peak), (None, None))

    want = {}
    for i, (k, rho) in point.items():
        for other in set(of.values()) - {of[i]}:
            n, j = first(i, other)
            if n is not None and n <= k and first(j, of[i])[1] == i:
                ends = (min(of[i], other), max(of[i], other))
                want[ends] = min(want.get(ends, (math.inf,)), (error(k, rho) - math.log(rho) if rho < math.inf else -rho, i))
    got = {(x["a"], x["b"]): x for x in saddles.collect()}
    assert {ends: x["saddle"] for ends, x in got.items()} == {ends: i for ends, (_, i) in want.items()} and len(want) > 2
    assert all((x["log_rho"], x["err"]) == pytest.approx((math.log(point[x["saddle"]][1]), error(*point[x["saddle"]]))) for x in got.values())

    tops = {p: point[p] for p in set(of.values())}
    cluster = one_after_another(tops, {ends: (x["log_rho"], x["err"]) for ends, x in got.items()}, 0.8)
    joined = clusters.merged_peaks(dense, peaks, saddles, 0.8)
    assert dict(map(tuple, joined.collect())) == cluster and 1 < len(set(cluster.values())) < len(tops)
    rim = {}
    for (a, b), x in got.items():
        if cluster[a] != cluster[b]:
            for c in (cluster[a], cluster[b]):
                rim[c] = max(rim.get(c, -math.inf), x["log_rho"])
    number = {c: n for n, c in enumerate(sorted(set(cluster.values())))}
    rows = {x["query_id"]: x for x in clusters.assignment(dense, peaks, saddles, joined).collect()}
    assert set(rows) == set(point)
    for i, x in rows.items():
        c = cluster[of[i]]
        outer = math.log(point[i][1]) < rim.get(c, -math.inf)
        assert (x["cluster"], x["halo"], x["label"]) == (c, outer, -number[c] - 1 if outer else number[c])
    assert {x["halo"] for x in rows.values()} == {True, False}
    kept = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in set(left(spark)) - before}
    assert not kept & {"peak-edges", "peak-nodes", "peak-levels", "peak-roots", "top-edges", "rims", "first-of-peaks"}
