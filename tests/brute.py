"""Brute force to compare with."""

import numpy as np


def knn(queries, base, k):
    """{(query, rank): (neighbour, d2)} over lists of (id, coordinates); sums run from the first dimension on."""
    out = {}
    for q, x in queries:
        found = []
        for p, y in base:
            d2 = 0.0
            for a, b in zip(x, y):
                d2 += (a - b) * (a - b)
            found.append((d2, p))
        for rank, (d2, p) in enumerate(sorted(found)[:k], 1):
            out[q, rank] = (p, d2)
    return out


def as_dict(df):
    return {(r["query_id"], r["rank"]): (r["neighbor_id"], r["d2"]) for r in df.collect()}


def rows(rng, n, dims, grid=None):
    x = rng.integers(0, grid, (n, dims)).astype(float) if grid else rng.random((n, dims))
    return [(int(i), c) for i, c in zip(rng.permutation(10 * n)[:n], x.tolist())]


def frame(spark, points, slices=3):
    return spark.createDataFrame(spark.sparkContext.parallelize(points, slices), "id long, coords array<double>")


def rng(seed):
    return np.random.default_rng(seed)
