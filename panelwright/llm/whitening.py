"""Whitening of vectors: exact sums, a covariance centred before multiplying, and its leading eigenvectors.

Sums and covariances are added up by Spark from one small part of each task. The symmetric matrix of one row and column a
dimension is reduced to tridiagonal form by Householder reflections; bisection on Sturm counts gives the leading
eigenvalues and inverse iteration their vectors, made orthogonal within clusters. The projection is broadcast; its size
depends on the dimensions alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, whole_vectors
from .words import stored

SHIFT = 1_000_000
_LOW = (1 << 32) - 1
_LONG = 1 << 63
#: Rows whose products are held at once.
SLICE = 16_384


# Eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections that lead to them."""
    a, mirrors = a.astype(float).copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if np.linalg.norm(x[1:]) == 0:
            mirrors.append(None)
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k], a[k + 2 :, k] = -np.copysign(size, x[0]), 0
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: sign changes of the leading minors."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off**2, initial=0)))
    below = np.zeros(len(at), int)
    pivot = np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, all bisected together until neighbouring doubles enclose them."""
    reach = np.zeros(len(diagonal))
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    margin = np.finfo(float).eps * (np.abs(diagonal) + reach).max() * len(diagonal) + np.finfo(float).tiny
    low = np.full(count, (diagonal - reach).min() - margin)
    high = np.full(count, (diagonal + reach).max() + margin)
    most_below = len(diagonal) - 1 - np.arange(count)
    while True:
        middle = (low + high) / 2
        if not ((low < middle) & (middle < high)).any():
            return middle
        under = sturm_counts(diagonal, off, middle) <= most_below
        low, high = np.where(under, middle, low), np.where(under, high, middle)


def _factor(diagonal: np.ndarray, off: np.ndarray, value: float, least: float) -> list[tuple]:
    """Rows of an LU factorisation, with partial pivoting, of the tridiagonal matrix less ``value`` on its diagonal."""
    n, steps = len(diagonal), []
    first, second = diagonal[0] - value, off[0] if n > 1 else 0.0
    for i in range(n - 1):
        below, mid, after = off[i], diagonal[i + 1] - value, off[i + 1] if i + 2 < n else 0.0
        if abs(first) >= abs(below):
            pivot = first if abs(first) > least else least
            ratio = below / pivot
            steps.append((False, ratio, pivot, second, 0.0))
            first, second = mid - ratio * second, after
        else:
            ratio = first / below
            steps.append((True, ratio, below, mid, after))
            first, second = second - ratio * mid, -ratio * after
    steps.append((False, 0.0, first if abs(first) > least else least, 0.0, 0.0))
    return steps


def _solve(steps: list[tuple], right: np.ndarray) -> np.ndarray:
    x = right.tolist()
    for i, (swapped, ratio, *_) in enumerate(steps[:-1]):
        if swapped:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= ratio * x[i]
    for i in range(len(x) - 1, -1, -1):
        _, _, pivot, one, two = steps[i]
        value = x[i]
        if i + 1 < len(x):
            value -= one * x[i + 1]
        if i + 2 < len(x):
            value -= two * x[i + 2]
        x[i] = value / pivot
    return np.array(x)


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns of unit eigenvectors by inverse iteration; those of close eigenvalues are kept orthogonal."""
    n, random = len(diagonal), np.random.default_rng(11)
    norm = float((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max()) or 1.0
    eps = np.finfo(float).eps
    vectors, cluster, at = np.zeros((n, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        at = min(value, at - 4 * eps * norm) if j > cluster else value  # equal values would give equal vectors
        steps = _factor(diagonal, off, at, eps * norm)
        near, x = vectors[:, cluster:j], random.normal(size=n)
        for _ in range(5):
            for _ in range(2):
                x -= near @ (near.T @ x)
            x = _solve(steps, x / np.abs(x).max())
            x /= np.abs(x).max()
        for _ in range(2):
            x -= near @ (near.T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    return vectors


def principal_axes(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues that are not zero to double precision, and unit vectors as columns, largest entry positive."""
    scale = float(np.trace(covariance)) if len(covariance) else 0.0
    if not scale > 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    diagonal, off, mirrors = tridiagonal(covariance / scale)
    values = leading_eigenvalues(diagonal, off, min(count, len(covariance)))
    values = values[values > len(covariance) * 1e-14]
    axes = eigenvectors(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        if (v := mirrors[k]) is not None:
            axes[k + 1 :] -= 2 * np.outer(v, v @ axes[k + 1 :])
    largest = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    return values * scale, axes * np.where(largest < 0, -1.0, 1.0)


# Sums over all rows


@dataclass
class Centre:
    """Row count and exact sums. ``whole`` is the integer part of each mean, ``rest`` what n times the mean has beyond it."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    widest: int

    def shifted(self, x: np.ndarray) -> np.ndarray:
        return x - self.whole

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, with one rounding where n times the distance fits a long."""
        y = self.shifted(x)
        if self.n * (self.widest + 1) < _LONG // 2:
            return (self.n * y - self.rest) / self.n
        return y - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 over the dimensions, exact; None where it does not fit a long."""
        y, d = self.shifted(x), x.shape[1]
        if d * (self.widest + 1) ** 2 * self.n**2 < _LONG:
            return ((self.n * y - self.rest) ** 2).sum(axis=1).tolist()
        if d * (self.widest + 1) * max(self.widest + 1, self.n) < _LONG:
            squares, mixed = (y * y).sum(axis=1).tolist(), (y @ self.rest).tolist()
        else:
            rest = self.rest.tolist()
            squares = [sum(v * v for v in row) for row in y.tolist()]
            mixed = [sum(v * r for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
        last = sum(r * r for r in self.rest.tolist())
        exact = [self.n * (self.n * a - 2 * b) + last for a, b in zip(squares, mixed, strict=True)]
        return [v if v < _LONG else None for v in exact]


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, matrix(part.column(part.schema.get_field_index("x")), width)


def fit_centre(rows: DataFrame, width: int) -> Centre:
    """Exact sums by dimension: each task sends the halves of its 64-bit numbers added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _batches(batches, width):
            yield pa.RecordBatch.from_pydict(
                {
                    "i": np.arange(width, dtype=np.int32),
                    "high": (x >> 32).sum(axis=0),
                    "low": (x & _LOW).sum(axis=0),
                    "n": np.full(width, len(x)),
                    "least": x.min(axis=0),
                    "most": x.max(axis=0),
                }
            )

    parts = rows.select("x").mapInArrow(add, "i int, high long, low long, n long, least long, most long")
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = parts.groupBy("i").agg(*total, F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    whole, rest, n, widest = [0] * width, [0] * width, 0, 0
    for r in found.collect():
        n = r["n"]
        whole[r["i"]], rest[r["i"]] = divmod((int(r["high"]) << 32) + int(r["low"]), n)
        widest = max(widest, r["most"] - whole[r["i"]], whole[r["i"]] - r["least"])
    return Centre(n, np.array(whole, np.int64), np.array(rest, np.int64), widest)


def _summed_products(rows: DataFrame, width: int, size: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the outer products of ``values``: a triangle of each task's part, added up by Spark."""
    upper = np.triu_indices(size)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in _batches(batches, width):
            z = values(x)
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "v": total[upper]})

    found = rows.select("x").mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((size, size))
    i, j, v = (found.column(c).to_numpy() for c in ("i", "j", "v"))
    total[i, j] = total[j, i] = v
    return total


def fit_covariance(rows: DataFrame, centre: Centre) -> np.ndarray:
    """Covariance over all rows, divisor n, each row centred before it is multiplied."""
    width = len(centre.whole)
    return _summed_products(rows, width, width, centre.centred) / centre.n


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` of each usable row.

    All usable rows (see ``whole_vectors``) are the fit list; repeated rows count as often as they occur, and a null vec_id
    stays null. A component whose eigenvalue is zero to double precision is left out, as nothing can be divided by it:
    fewer than ``components`` come back from flat data, none from a single vector. Empty input gives no rows.
    ``deviation`` is null where it does not fit a long.
    """
    spark = vectors.sparkSession
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    rows = stored(whole_vectors(vectors, SHIFT), "whole")
    first = rows.select(F.size("x")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = first[0]
    centre = fit_centre(rows, width)
    covariance = fit_covariance(rows, centre)
    values, axes = principal_axes(covariance, components)
    count = len(values)
    if not count:
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast((centre, axes / np.sqrt(values), values / np.trace(covariance)))

    def project(x: np.ndarray) -> np.ndarray:
        centre, turn, _ = model.value
        return centre.centred(x) @ turn

    # The column of ones adds the sums of the projections themselves, which are zero but for rounding.
    ones = _summed_products(rows, width, count + 1, lambda x: np.column_stack([project(x), np.ones(len(x))])) / centre.n
    mean = ones[:-1, -1]
    error = float(np.abs(ones[:-1, :-1] - np.outer(mean, mean) - np.eye(count)).max())

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, _, explained = model.value
        for part, x in _batches(batches, width):
            n = len(x)
            ids = part.column(part.schema.get_field_index("vec_id"))
            every = pa.array(np.repeat(np.arange(n), count))
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": ids.take(every),
                    "component": pa.array(np.tile(np.arange(1, count + 1), n), pa.int32()),
                    "n": pa.array(np.full(n * count, centre.n), pa.int64()),
                    "deviation": pa.array(centre.deviation(x), pa.int64()).take(every),
                    "whitened": pa.array(project(x).reshape(-1)),
                    "explained": pa.array(np.tile(explained, n)),
                    "identity_error": pa.array(np.full(n * count, error)),
                }
            )

    return rows.mapInArrow(rows_out, schema)
