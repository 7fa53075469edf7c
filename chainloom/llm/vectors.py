"""Vectors in Arrow batches, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for vectors that take part: not null or empty, without null or non-finite components, not all zero."""
    x = F.col(column)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays of doubles as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of bytes, eight a component."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows, np.float64)], pa.binary())


def unpacked(column) -> np.ndarray:
    """The matrix of a column of bytes."""
    values = [np.frombuffer(x, np.float64) for x in column]
    return np.stack(values) if values else np.zeros((0, 0))
