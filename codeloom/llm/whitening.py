"""Whitening of embeddings by shifted Cholesky QR.

Vectors become whole numbers, so counts, sums and distances from the mean are
exact. Every pass over the fit list solves the centred rows against the
triangular factors found so far and sums the Gram matrix of what comes out; its
Cholesky factor is the next triangle. The first one is shifted, so that it exists
for any condition of the data. When the rows have become orthonormal, the product
of the triangles has the singular values and right vectors of the centred rows.

Tasks send one sum a task to the next stage and the driver sees matrices of the
dimension only; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

SCALE = 256  # steps per unit of an entry
MOST_PASSES = 10
_SAFE = 2**62  # whole numbers below are exact in 64 bits, their sums included
_PIECE = 1 << 20  # entries worked on at once


@dataclass(frozen=True)
class Whitening:
    """`n` distinct vectors with sums `sums`; `vectors` holds unit eigenvectors of their
    covariance as columns, `values` the eigenvalues, `trace` their sum over all components."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and `x`, the vector in whole steps, of rows that have one of finite entries only.

    Entries beyond the range of a long take its end.
    """
    entry = F.col("embedding").cast("array<double>")
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (embeddings.where(F.col("embedding").isNotNull() & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entry, lambda c: F.floor(c * SCALE)).alias("x")))


def _pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of bounded size, with their vectors as a matrix."""
    step = max(1, _PIECE // d)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            piece = batch.slice(start, step)
            yield piece, piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact; Python integers where 64 bits could be too few."""
    top = max(-int(x.min()), int(x.max()), 0) * n + max(map(abs, sums))
    if top >= _SAFE:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * np.int64(n) - np.array(sums, dtype=np.int64)


def _squared(away: np.ndarray) -> list[int | None]:
    """Sums of squares per row, null beyond the range of a long."""
    if away.dtype != object and int(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < _SAFE:
        return (away * away).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (sum(v * v for v in row) for row in away.tolist())]


def _column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and the exact sum of each dimension, halves of 32 bits apart."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for piece, x in _pieces(batches, d):
            rows += piece.num_rows
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"rows": [rows], "high": [high.tolist()], "low": [low.tolist()]})

    parts = fit.mapInArrow(add, "rows long, high array<long>, low array<long>")
    each = parts.select("rows", F.posexplode(F.arrays_zip("high", "low")))
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = (each.groupBy("pos").agg(F.sum("rows").alias("rows"), exact(F.col("col.high")).alias("high"),
                                    exact(F.col("col.low")).alias("low")).orderBy("pos").collect())
    return int(sums[0]["rows"]), [(int(r["high"]) << 32) + int(r["low"]) for r in sums]


def _gram(fit: DataFrame, d: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of the outer products of `rows_of` (width entries a row)."""
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _pieces(batches, d):
            made = rows_of(x)
            total += made.T @ made
        yield pa.RecordBatch.from_pydict({"g": [total[upper].tolist()]})

    parts = fit.mapInArrow(add, "g array<double>").select(F.posexplode("g"))
    sums = parts.groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
    gram = np.zeros((width, width))
    gram[upper] = [r["v"] for r in sums]
    return gram + np.triu(gram, 1).T


def _triangle(gram: np.ndarray, shift: float) -> np.ndarray | None:
    try:
        return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
    except np.linalg.LinAlgError:
        return None


def fit(vectors: DataFrame, d: int, components: int = 4) -> Whitening | None:
    """Components of the stored distinct vectors `x`, all of dimension `d`; none without any spread.

    Components whose deviation is below 1e-10 of the largest are noise and left out.
    """
    n, sums = _column_sums(vectors, d)

    def centred(x: np.ndarray) -> np.ndarray:
        return _from_mean(x, n, sums).astype(np.float64) / n

    triangles: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        rows = centred(x).T
        for r in triangles:
            rows = np.linalg.solve(r.T, rows)
        return rows.T

    rounding = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2
    product = np.eye(d)
    for _ in range(MOST_PASSES):
        gram = _gram(vectors, d, orthogonal, d)
        if not np.trace(gram) > 0:
            return None
        found, axes = np.linalg.eigh(gram)
        alive = found > 1e-9 * found[-1]
        if triangles and np.abs(found[alive] - 1).max() < 1e-3:
            # Orthonormal, but for directions that the rows have not got at all.
            last = _triangle(gram, 0.0) if alive.all() else None
            product = (last if last is not None else np.sqrt(np.maximum(found, 0))[:, None] * axes.T) @ product
            break
        plain = _triangle(gram, 0.0) if triangles and found[0] > 1e-6 * found[-1] else None
        r = plain if plain is not None else _triangle(gram, rounding * float(np.trace(gram)))
        triangles.append(r)
        product = r @ product
    else:
        raise RuntimeError("rows did not become orthonormal")
    _, deviations, right = np.linalg.svd(product)
    kept = [i for i in range(min(components, d)) if deviations[i] > 1e-10 * deviations[0]]
    axes = right[kept].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(len(kept))])
    values = deviations**2 / n

    def whitened(x: np.ndarray) -> np.ndarray:
        rows = centred(x) @ axes / np.sqrt(values[kept])
        return np.concatenate([rows, np.ones((len(rows), 1))], axis=1)

    moments = _gram(vectors, d, whitened, len(kept) + 1) / n
    means = moments[-1, :-1]
    error = np.abs(moments[:-1, :-1] - np.outer(means, means) - np.eye(len(kept))).max()
    return Whitening(n, sums, axes, values[kept], float(values.sum()), float(error))


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def project(vectors: DataFrame, model: Whitening) -> DataFrame:
    """One row per vector and component of `model`."""
    d, k = model.vectors.shape
    scaled = model.vectors / np.sqrt(model.values)
    share = model.values / model.trace

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _pieces(batches, d):
            away = _from_mean(x, model.n, model.sums)
            rows = len(x)
            at = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays([
                piece.column("vec_id").take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)),
                pa.array(_squared(away), pa.int64()).take(pa.array(at)),
                pa.array((away.astype(np.float64) / model.n @ scaled).ravel()),
                pa.array(np.tile(share, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(place, RESULT)


def whitening(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Whitened coordinates of `embeddings` (vec_id, embedding), learned from their distinct vectors.

    Result, per usable row and component: vec_id, component (from 1, by falling
    eigenvalue), n (distinct vectors), deviation (squared distance from the mean
    times n squared, exact; null where a long is too small), whitened, explained
    (the component's share of the variance), identity_error (how far the
    covariance of the whitened fit list is from the identity).

    Rows whose vector is null or has a null, NaN or infinite entry are left out,
    and so are those of another dimension than most rows have (the larger one
    of equals). A null id stays; repeated rows are all returned and learned from
    once. Fewer components are returned where the data have fewer; vectors
    without any spread, empty vectors and empty tables give no row. Other columns
    are ignored.
    """
    rows = cut_lineage(whole_vectors(embeddings), "whole_vectors")
    size = F.size("x")
    common = rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    model = None
    if common is not None and common["d"]:
        rows = rows.where(size == common["d"])
        model = fit(cut_lineage(rows.select("x").distinct(), "fit_list"), common["d"], components)
    if model is None:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), RESULT)
    return project(rows, model)
