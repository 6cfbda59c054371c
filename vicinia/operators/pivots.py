"""Cells for many dimensions: each point belongs to the nearest of a few pivots, and cells are left out by the triangle inequality.

Beyond a handful of dimensions boxes exclude next to nothing. What a cell knows here
is, for every pivot, the least and the largest distance of its points to it. A query
at distance D of a pivot is at least D - largest and least - D away from all of them.
On clustered points that excludes most cells; where it excludes few, the caller
compares everything, which is exact as well. Bounds are widened by what rounding may
have taken, so no cell is left out that could matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .cells import flat_coords
from .kernel import first_to_hold, square_distances

#: The most pivots, coordinates of the sample that they are chosen from, and rounds in which they move to the middle of their cells.
MOST_PIVOTS, SAMPLE_COORDINATES, ROUNDS = 128, 1 << 20, 4
#: What rounding may take from a distance, relative to the largest involved, in 64 and in 32 bits; entries of a strip.
SLACK, SLACK32, STRIP = 1e-11, 1e-4, 1 << 21


@dataclass
class Pivots:
    """`at`: a row a pivot, which is also a cell."""

    at: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.at)


def distances(q: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(square_distances(q, at))


def choose(sample: np.ndarray, wanted: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most `wanted` distinct pivots: each farthest from those before, then moved to the middle of what is nearest to it."""
    at = [int(np.argmin(((sample - sample.mean(0)) ** 2).sum(1)))]
    far = ((sample - sample[at[0]]) ** 2).sum(1)
    while len(at) < wanted and far.max() > 0:
        at.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(1))
    pivots = sample[at].copy()
    for _ in range(rounds):
        own = nearest(sample, pivots)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(pivots))
        pivots[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(pivots, axis=0)


def nearest(q: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(q), np.int64)
    step = max(1, STRIP // max(1, len(at)))
    for i in range(0, len(q), step):
        out[i : i + step] = square_distances(q[i : i + step], at).argmin(1)
    return out


def sample_pivots(pts: DataFrame, rows: int, dims: int, wanted: int) -> Pivots:
    """Pivots from a bounded sample of (id, coords): the points whose ids have the least hashes, a share of the scan."""
    most = max(wanted, SAMPLE_COORDINATES // dims)
    if rows > most:
        pts = pts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * most / rows))
    sample = np.array(pts.select("coords").limit(2 * most).toPandas()["coords"].to_list(), float).reshape(-1, dims)  # the limit only bounds chance
    return Pivots(choose(sample, wanted) if len(sample) else np.zeros((1, dims)))


def with_pivot_cell(pts: DataFrame, pivots: Pivots) -> DataFrame:
    """`pts` with `cell`, the place of the nearest pivot."""
    shipped = pts.sparkSession.sparkContext.broadcast(pivots.at)  # MOST_PIVOTS at most
    kept = [c for c in pts.columns if c != "cell"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = nearest(flat_coords(batch.column("coords")), shipped.value) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cells.astype(np.int32))], names=[*kept, "cell"])

    return pts.select(kept).mapInArrow(place, StructType([*(pts.schema[c] for c in kept), StructField("cell", IntegerType())]))


def pivot_table(celled: DataFrame, pivots: Pivots, weight: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, low, high): the sum of each cell's `weight`, and how near and how far its points are to each pivot.

    A task sends on one row a cell and pivot, so the driver gets the square of MOST_PIVOTS rows at most.
    """
    shipped, m = celled.sparkSession.sparkContext.broadcast(pivots.at), pivots.cells

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = np.zeros(m, np.int64), np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            coords, cell = flat_coords(batch.column("coords")), batch.column("cell").to_numpy(zero_copy_only=False)
            n += np.bincount(cell, batch.column(weight).to_numpy(zero_copy_only=False), m).astype(np.int64)
            step = max(1, STRIP // m)
            for i in range(0, len(coords), step):
                d = distances(coords[i : i + step], shipped.value)
                np.minimum.at(low, cell[i : i + step], d)
                np.maximum.at(high, cell[i : i + step], d)
        of, to = np.divmod(np.arange(m * m), m)
        told = n[of] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[told]) for x in (of, to, np.where(to == 0, n[of], 0), low.reshape(-1), high.reshape(-1))], names=["of", "to", "n", "low", "high"])

    found = celled.select("coords", "cell", weight).mapInArrow(measure, "of long, to long, n long, low double, high double")
    table = found.groupBy("of", "to").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    n, low, high = np.zeros(m, np.int64), np.full((m, m), np.inf), np.full((m, m), -np.inf)
    of, to = table["of"].to_numpy(), table["to"].to_numpy()
    low[of, to], high[of, to] = table["low"], table["high"]
    np.add.at(n, of, table["n"].to_numpy())
    return n, low, high


def gaps(d: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """(queries, cells): squared distances that all points of a cell are away from a query at least, by its distances `d` to the pivots."""
    out = np.zeros((len(d), len(low)))
    for c in range(len(low)):
        if np.isinf(low[c, 0]):  # without points
            out[:, c] = np.inf
            continue
        least = np.maximum(d - high[c], low[c] - d).max(1) - slack * (d.max(1) + high[c].max())
        out[:, c] = np.maximum(least, 0) ** 2
    return out * (1 - slack)


def counted_radius(d: np.ndarray, k: int, n: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """A squared distance of each query within which `k` points lie for sure; infinite where there are not so many."""
    cells = np.flatnonzero(n > 0)
    far = (d[:, cells] + high[cells, cells]) * (1 + slack)
    rows = np.repeat(np.arange(len(d)), len(cells))
    return first_to_hold(rows, far.reshape(-1) ** 2 * (1 + slack), np.tile(n[cells], len(d)), k, len(d))
