"""Whitened embeddings by Chebyshev-filtered subspace iteration.

Leading eigenvectors of a covariance without the covariance: every step is one distributed pass that
sums the centred ``X'(XQ)`` of all rows for a block ``Q`` of a few more columns than are wanted. A
Chebyshev recurrence over such passes damps the unwanted part of the spectrum and raises the rest;
QR and a Rayleigh-Ritz step turn the filtered block into eigenpairs, and their residuals tell when
to stop. A last round with fresh random columns then looks for a direction that was missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.session import materialize

COMPONENTS = 32
# Columns beyond the wanted ones, most passes of one filter, rounds after which the block is widened by as
# many columns again, and how far a filter may raise the first wanted direction above the last.
GUARD, DEGREE, PATIENCE, LIFT = 16, 10, 6, 1e10
RESIDUAL = 2e-14  # of the largest eigenvalue, times the square root of the dimension
LEAST_SHARE = 1e-12  # of the largest eigenvalue: below it a direction holds rounding only
SCALE, SHIFT = 64, 1_000_000
SEED = 29
SAFE = 2**62


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x``, written once: every entry c as the whole number floor(64 c) + 1000000.

    Rows whose vector is null or holds a null or non-finite entry are left out, and so are vectors
    that are not of the commonest length (of equally common ones the longest).
    """
    named = rows.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(finite(F.col("v")))
    x = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT))
    kept = materialize(named.select("vec_id", x.alias("x")), "whiten-x")
    common = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("x") == (common["d"] if common else 0))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of an Arrow list column of whole numbers, all of length ``d``."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def summed(x: DataFrame, block: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all rows of the cells ``block`` gives for each batch, as a flat array.

    A task adds up its batches and gives one row per cell; Spark adds those, so the driver gets the
    cells alone, however many tasks there are.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None
        for batch in batches:
            own = block(matrix(batch.column(0), d)).ravel()
            cells = own if cells is None else cells + own
        if cells is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells, pa.float64())], ["cell", "v"])

    found = x.select("x").mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    cells = np.zeros(len(found))
    cells[found["cell"].to_numpy()] = found["v"].to_numpy()
    return cells


@dataclass(frozen=True)
class Moments:
    """Exact: the number of rows and the per-dimension sums."""

    n: int
    sums: list[int]

    @property
    def d(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n``: the whole part of the mean is taken off exactly, the rest in double."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest


def moments(x: DataFrame) -> Moments:
    """Sums are taken as decimals, so they are exact at any number of rows."""
    d = x.select(F.size("x")).first()
    if d is None:
        return Moments(0, [])
    cells = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("v").alias("n"))
    found = sorted((r["i"], int(r["s"]), r["n"]) for r in cells.collect())
    return Moments(found[0][2], [s for _, s, _ in found]) if found else Moments(0, [])


@dataclass(frozen=True)
class Spectrum:
    """Eigenvalues from the largest, unit eigenvectors as columns, and the trace of the covariance."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    rounds: int
    passes: int
    residual: float


def orthonormal(block: np.ndarray) -> np.ndarray:
    """QR, twice, of columns that were scaled to length 1."""
    size = np.linalg.norm(block, axis=0)
    q, _ = np.linalg.qr(block / np.where(size > 0, size, 1.0))
    return np.linalg.qr(q)[0]


def leading(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, trace: float) -> Spectrum:
    """The ``k`` largest eigenpairs of the symmetric, non-negative ``apply``.

    The spectrum above the smallest Ritz value of the block is wanted, that between 0 and it is
    damped. A round is one filter and one pass for Rayleigh-Ritz. Certified are ``k`` pairs whose
    residuals are at most rounding, if a further round, whose guard columns were made anew at random,
    finds the same values. Where the spectrum is so flat that this takes long, the block is widened;
    a block of all dimensions is exact at once.
    """
    rng = np.random.RandomState(SEED)
    width = min(d, k + GUARD)
    q = orthonormal(rng.standard_normal((d, width)))
    passes = rounds = waited = 0
    certified = None

    def widened(kept: np.ndarray, extra: int) -> np.ndarray:
        fresh = rng.standard_normal((d, extra))
        return orthonormal(np.hstack([kept, fresh - kept @ (kept.T @ fresh)]))

    while True:
        aq = apply(q)
        passes += 1
        values, turn = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q = q @ turn
        largest = max(float(values[0]), np.finfo(float).tiny)
        worst = float(np.linalg.norm(aq @ turn - q * values, axis=0)[:k].max())
        settled = worst <= RESIDUAL * np.sqrt(d) * largest
        same = certified is not None and bool(np.all(np.abs(values[:k] - certified) <= 1e-10 * largest))
        if width == d or trace <= 0 or (settled and same):
            return Spectrum(np.maximum(values[:k], 0), q[:, :k], trace, rounds, passes, worst / largest)
        low = max(float(values[-1]), LEAST_SHARE * largest)
        if settled:
            certified, waited = values[:k].copy(), 0
            q = widened(q[:, :k], width - k)
        elif waited == PATIENCE:
            extra = min(GUARD, d - width)
            q, width, waited = widened(q, extra), width + extra, 0
        degree = filter_degree(largest, float(values[k - 1]), low)
        q = orthonormal(filtered(apply, q, low, max(largest, 2 * low), degree))
        passes, rounds, waited = passes + degree, rounds + 1, waited + 1


def filter_degree(largest: float, least: float, low: float) -> int:
    """The most passes, up to ``DEGREE``, that raise ``largest`` at most ``LIFT`` times over ``least``."""
    growth = [np.arccosh(max(1.0, 2 * value / low - 1)) for value in (largest, least)]
    return int(np.clip(np.log(LIFT) / max(growth[0] - growth[1], 1e-3), 2, DEGREE))


def filtered(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, low: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial over [0, low], scaled to 1 at ``top``, applied to the block."""
    half = low / 2
    first = scale = half / (top - half)
    before, now = block, (apply(block) - half * block) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (2 * after / half) * (apply(now) - half * now) - scale * after * before
        scale = after
    return now


def spectrum(x: DataFrame, known: Moments, k: int = COMPONENTS) -> Spectrum:
    d, n = known.d, known.n
    # The trace is exact but for one rounding a row: squares of centred entries.
    trace = float(summed(x, lambda rows: np.square(known.centred(rows)).sum(axis=0), d).sum() / n)

    def apply(q: np.ndarray) -> np.ndarray:
        def block(rows: np.ndarray) -> np.ndarray:
            c = known.centred(rows)
            return c.T @ (c @ q)
        return summed(x, block, d).reshape(d, q.shape[1]) / n

    return leading(apply, d, min(k, d), trace)


def identity_error(x: DataFrame, known: Moments, basis: np.ndarray) -> float:
    """The largest entry, without sign, of the whitened rows' covariance less the identity."""
    k = basis.shape[1]
    mean = summed(x, lambda rows: (known.centred(rows) @ basis).sum(axis=0), known.d) / known.n

    def block(rows: np.ndarray) -> np.ndarray:
        w = known.centred(rows) @ basis - mean
        return w.T @ w

    return float(np.abs(summed(x, block, known.d).reshape(k, k) / known.n - np.eye(k)).max())


def deviations(rows: np.ndarray, known: Moments) -> list[int]:
    """The sum over dimensions of (n x - S)^2 for every row, in whole numbers of any size."""
    largest = max(int(np.abs(rows).max(initial=0)), 1)
    bound = known.n * largest + max(abs(s) for s in known.sums)
    if bound < SAFE:
        gap = rows * known.n - np.array(known.sums, np.int64)
        widest = int(np.abs(gap).max(initial=0))
        if widest * widest * known.d < SAFE:
            return np.square(gap).sum(axis=1).tolist()
    return [sum((known.n * int(v) - s) ** 2 for v, s in zip(row, known.sums)) for row in rows]


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    Components count from 1 by falling eigenvalue, up to ``components`` and to the rank: directions
    without variance have none. Rows as in ``whole_vectors``; repeated rows are rows of their own, a
    null id stays null, an empty table, one row or rows without any variance give no rows. Equal
    vectors get equal values. A deviation that does not fit 64 bits raises an error.
    """
    x = whole_vectors(rows, key, vector)
    known = moments(x)
    kind = x.schema["vec_id"].dataType.simpleString()
    shape = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = spectrum(x, known, components) if known.n else None
    rank = int((found.values > LEAST_SHARE * found.values[0]).sum()) if found is not None and found.values[0] > 0 else 0
    if not rank:
        return rows.sparkSession.createDataFrame([], shape)
    basis = found.vectors[:, :rank] / np.sqrt(found.values[:rank])
    explained = found.values[:rank] / found.trace
    error = identity_error(x, known, basis)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = matrix(batch.column(1), known.d)
            if not len(whole):
                continue
            # One sum a row and component in the same order, so that equal vectors get equal values.
            white = np.einsum("ij,jk->ik", known.centred(whole), basis, optimize=False)
            each = np.repeat(np.arange(len(whole)), rank)
            size = len(each)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, rank + 1), len(whole)), pa.int32()),
                pa.array(np.full(size, known.n), pa.int64()),
                pa.array(deviations(whole, known), pa.int64()).take(pa.array(each)),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, len(whole))),
                pa.array(np.full(size, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select("vec_id", "x").mapInArrow(project, shape)
