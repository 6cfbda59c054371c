"""Whitening of embeddings by the leading eigenvectors of their covariance, found by LOBPCG over the rows.

Vectors become whole numbers, x = floor(scale * c) + offset, so that sums and
deviations are exact: a row is centred as (n * x - S) / n, with S the sums of all
rows. The covariance itself is never formed. What LOBPCG asks for is its product
with a block of directions, which one pass over the rows gives: every task adds up
its rows' part, centred * (centred . block), and the parts are summed by their
place in the block, so the driver gets as many numbers as the block has, whatever
the rows.

LOBPCG: the block holds the iterate (the components and some guards), its
residuals and the previous directions, made orthonormal; Rayleigh-Ritz in their
span gives the next iterate. Residuals come from products, not from a recurrence,
and it ends where those of all components asked for are at most TOLERANCE of the
largest eigenvalue: that certifies them. If it does not come there in PASSES
passes it raises.

Nulls and edges: rows whose vector is null, or holds an entry that is null or not
finite, are dropped; a null id stays; repeated rows are rows each; vectors of
different lengths raise, and so do numbers whose exact deviation is beyond 64 bits
(of entries within 1, beyond a hundred million rows or so); directions in which the
rows do not differ, up to rounding, are no components, so rows that are all alike,
a single row and vectors without entries have none; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, staged

#: How entries become whole numbers.
SCALE, OFFSET = 64, 1_000_000
#: Residuals that certify a component, relative to the largest eigenvalue; the most passes over the rows; eigenvalues that count as none, so too.
TOLERANCE, PASSES, NOTHING = 1e-12, 500, 1e-12
#: Rows that are centred at once hold so many entries.
STRIP = 1 << 20


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that are complete and finite, as whole numbers."""
    c = F.col(vector).cast("array<double>")
    bad = c.isNull() | F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + OFFSET)
    return rows.where(~bad).select(F.col(id_column).alias("vec_id"), x.alias("x"))


def _strips(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    """The vectors of a column as matrices of bounded size."""
    if not batch.num_rows:
        return
    lists = batch.column(column)
    matrix = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    step = max(1, STRIP // max(1, matrix.shape[1]))
    for i in range(0, len(matrix), step):
        yield matrix[i : i + step]


def _summed(table: DataFrame, column: str, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str = "double") -> np.ndarray:
    """The sum of `part` over all strips of a column: a task sends on one number a place, and places are summed apart."""
    size, own = int(np.prod(shape)), np.int64 if kind == "long" else np.float64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(shape, own), False
        for batch in batches:
            for strip in _strips(batch, column):
                total, met = total + part(strip), True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.reshape(-1))], names=["at", "value"])

    out = np.zeros(size, own)
    found = table.select(column).mapInArrow(add, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).toPandas()  # `size` rows at most
    out[found["at"].to_numpy()] = found["value"].to_numpy()
    return out.reshape(shape)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly."""
    if len(x) and float(np.abs(x).max()) * n > 2.0**62:
        raise OverflowError("n * x is beyond 64 bits")
    return x * np.int64(n) - sums


def _square_sums(deviations: np.ndarray) -> np.ndarray:
    """Sums of squares by row, exactly."""
    if len(deviations) and float((deviations.astype(float) ** 2).sum(1).max()) > 2.0**62:
        raise OverflowError("a row's deviation is beyond 64 bits")
    return (deviations * deviations).sum(1)


def _unit(block: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `block` has outside the span of `beside`, which is orthonormal; what is there by rounding only goes."""
    for _ in range(2):
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        block = block - beside @ (beside.T @ block)
    if not block.size:
        return block[:, :0]
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    out = left[:, size > 1e-8]
    out = out - beside @ (beside.T @ out)
    return np.linalg.qr(out)[0][:, : len(beside) - beside.shape[1]]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, eigenvectors, norms of their residuals, passes) of the `wanted` largest of a symmetric operator
    without negative eigenvalues, known by its `product` with blocks of columns."""
    guards = min(dims, wanted + max(8, wanted // 4))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, guards)))[0]
    for done in range(1, passes + 1):
        image = product(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:guards], turn[:, ::-1][:, :guards]
        iterate, moved = basis @ turn, image @ turn
        residual = moved - iterate * values
        norms = np.linalg.norm(residual, axis=0)
        limit = tolerance * max(values[0], 0.0)
        if (norms[:wanted] <= limit).all():
            return values[:wanted], iterate[:, :wanted], norms[:wanted], done
        open_ = norms > limit
        previous = basis[:, guards:] @ turn[guards:]  # what the iterate took from outside the last one
        iterate = np.linalg.qr(iterate)[0]
        beside = [residual[:, open_], previous[:, open_] if previous.size else previous]
        basis = np.concatenate([iterate, _unit(np.concatenate([b for b in beside if b.size], axis=1), iterate)], axis=1)
    raise RuntimeError(f"no components of residuals below {tolerance} of the largest eigenvalue in {passes} passes; the largest is {norms[:wanted].max() / values[0]:.3g} of it")


@dataclass
class Components:
    """Of `n` rows with `sums`: eigenvalues falling, unit vectors as columns, norms of residuals, the covariance's trace, and the passes that LOBPCG took."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int


def principal(table: DataFrame, wanted: int) -> Components | None:
    """The leading components of a staged table (x: array<long>); None without rows."""
    n, least, dims = table.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if least != dims:
        raise ValueError(f"vectors of {least} and of {dims} entries")
    if not dims:
        return Components(n, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    sums = _summed(table, "x", lambda x: x.sum(0), (dims,), "long")
    trace = float(_summed(table, "x", lambda x: ((_deviations(x, n, sums) / n) ** 2).sum(keepdims=True)[0], (1,))[0]) / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = _deviations(x, n, sums) / n
            return centred.T @ (centred @ block)

        return _summed(table, "x", part, block.shape) / n

    if trace == 0:
        return Components(n, sums, np.zeros(0), np.zeros((dims, 0)), np.zeros(0), 0.0, 0)
    values, vectors, residuals, passes = lobpcg(product, dims, min(wanted, dims))
    real = values > NOTHING * values[0]
    return Components(n, sums, values[real], vectors[:, real], residuals[real], trace, passes)


def projected(table: DataFrame, found: Components) -> DataFrame:
    """(vec_id, deviation, whitened: array<double>) of a table (vec_id, x)."""
    n, sums, turn = found.n, found.sums, found.vectors / np.sqrt(found.values)
    id_type = table.schema["vec_id"].dataType

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for strip in _strips(batch, "x"):
                deviations = _deviations(strip, n, sums)
                out = (deviations / n) @ turn
                offsets = pa.array((np.arange(len(strip) + 1) * turn.shape[1]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(strip)), pa.array(_square_sums(deviations)), lists], names=["vec_id", "deviation", "whitened"])
                at += len(strip)

    return table.select("vec_id", "x").mapInArrow(project, f"vec_id {id_type.simpleString()}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of `rows` (whitened) minus the identity, by centring before multiplying."""
    mean = _summed(rows, "whitened", lambda w: w.sum(0), (components,)) / n
    second = _summed(rows, "whitened", lambda w: (w - mean).T @ (w - mean), (components, components)) / n
    return float(np.abs(second - np.eye(components)).max())


def whiten(rows: DataFrame, wanted: int = 32, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Components | None, float]:
    """(vec_id, deviation, whitened) of the rows that remain, staged, with the components and the identity error."""
    table = staged(whole_vectors(rows, id_column, vector), "whole-vectors")
    found = principal(table, wanted)
    if found is None or not len(found.values):
        empty = table.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).limit(0)
        return empty, found, 0.0
    out = staged(projected(table, found), "whitened")
    release(table)
    return out, found, identity_error(out, found.n, len(found.values))


def whitened_rows(rows: DataFrame, wanted: int = 32, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row a vector and component, from 1."""
    out, found, error = whiten(rows, wanted, id_column, vector)
    shares = F.array(*[F.lit(float(v / found.trace)) for v in found.values]) if found is not None and len(found.values) else F.array().cast("array<double>")
    long = out.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(found.n if found is not None else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
