"""Vectors as whole numbers: which rows take part, and dense matrices from Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components from here on (times 64 they leave the range of a long) do not take part.
LARGEST = 2.0**52


def whole_vectors(vectors: DataFrame, shift: int = 0) -> DataFrame:
    """``vec_id`` and ``x``, each component c of ``embedding`` as floor(64 * c) + shift.

    Rows without a vector, with null or non-finite components or with one of 2**52 and more, empty vectors, and vectors of
    another than the commonest length (of equally common ones the shortest) take no part.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    ).where(f"size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < {LARGEST!r}D)")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    whole = F.transform("v", lambda c: F.floor(c * F.lit(64.0)) + F.lit(shift).cast("long"))
    return rows.where(F.size("v") == (common["n"] if common else 0)).select("vec_id", whole.alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
