"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinia.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "vec_id long, embedding array<float>, label int, x int, at int")


def plain(x, wanted):
    x = x.astype(object)
    n, s = len(x), x.sum(0)
    dev = n * x - s
    c = dev.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    return [int(d @ d) for d in dev], e, c @ u / np.sqrt(e), np.trace(c.T @ c / n)


def test_against_eigh(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(700, 20)) * np.linspace(1, 3, 20)).astype(np.float32)
    rows = [(i, v.tolist(), 1, 2, 3) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0, 0, 0), (1001, [None] * 20, 0, 0, 0), (1002, [float("nan")] * 20, 0, 0, 0), (1003, [float("inf")] + [0.0] * 19, 0, 0, 0), (None, [0.5] * 20, 0, 0, 0), (3, vectors[3].tolist(), 0, 0, 0)]
    kept = np.concatenate([vectors, [[0.5] * 20], vectors[3:4]])
    deviation, values, white, trace = plain(np.floor(64 * kept.astype(float)).astype(np.int64) + 1_000_000, 8)
    got = whitening.whitened_rows(frame(spark, rows), 8)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = got.toPandas()
    assert len(out) == 702 * 8 and set(out["n"]) == {702} and out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    for j in range(8):
        own = out[out["component"] == j + 1]
        assert np.allclose(own["explained"], values[j] / trace, rtol=1e-10)
        first = own[own["vec_id"] == 0]["whitened"].iloc[0]
        sign = np.sign(first * white[0, j])
        named = own.dropna(subset=["vec_id"]).sort_values(["vec_id"])
        want = np.insert(white[:700, j], 4, white[701, j])  # vector 3 twice
        assert np.allclose(named["whitened"].to_numpy() * sign, want, atol=1e-8)
        assert np.allclose(own[own["vec_id"].isna()]["whitened"] * sign, white[700, j], atol=1e-8)
    assert sorted(out[out["component"] == 1]["deviation"]) == sorted(deviation)


def test_lobpcg_iterates_where_blocks_do_not_span_all():
    """With 300 dimensions and 4 components several passes are needed, and their residuals certify them."""
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    values = np.concatenate([[50, 49.9, 30, 29], np.linspace(20, 0, 296)])
    matrix = (turn * values) @ turn.T
    asked = []
    got, vectors, residuals, passes = whitening.lobpcg(lambda b: asked.append(b.shape[1]) or matrix @ b, 300, 4)
    assert 2 < passes == len(asked) and max(asked) <= 36
    assert np.allclose(got, values[:4]) and (residuals <= 1e-12 * 50).all()
    assert np.allclose(np.abs(np.diag(vectors.T @ turn[:, :4])), 1, atol=1e-9)
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda b: matrix @ b, 300, 4, passes=2)


def test_directions_without_spread_are_no_components(spark):
    rng = np.random.default_rng(1)
    two = rng.normal(size=(100, 2)) @ rng.normal(size=(2, 6))
    two = np.round(two * 4) / 4  # exact in steps of 1 / 64, so that the rank stays what rounding leaves
    two[:, 3:] = two[:, :3]
    out = whitening.whitened_rows(frame(spark, [(i, v.tolist(), 0, 0, 0) for i, v in enumerate(two)]), 32).toPandas()
    assert set(out["component"]) == {1, 2, 3} and out["identity_error"][0] < 1e-9


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[], []], [None]])
def test_no_components(spark, vectors):
    assert whitening.whitened_rows(frame(spark, [(i, v, 0, 0, 0) for i, v in enumerate(vectors)])).count() == 0


def test_what_raises(spark):
    with pytest.raises(ValueError):
        whitening.whitened_rows(frame(spark, [(1, [1.0], 0, 0, 0), (2, [1.0, 2.0], 0, 0, 0)]))
    with pytest.raises(Exception, match="64 bits"):
        whitening.whitened_rows(frame(spark, [(i, [1e9 * (i % 2), 0.0], 0, 0, 0) for i in range(100)])).collect()


def test_products_of_several_tasks_add_up(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (333, 7))
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(v.tolist(),) for v in x], 5), "x array<long>")
    assert (whitening._summed(rows, "x", lambda a: a.sum(0), (7,), "long") == x.sum(0)).all()
    assert np.allclose(whitening._summed(rows, "x", lambda a: a.T @ a, (7, 7)), x.T @ x)
    assert (whitening._summed(rows.where(F.lit(False)), "x", lambda a: a.sum(0), (7,)) == 0).all()
