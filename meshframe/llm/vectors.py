"""Vectors as integers of fixed point, for operators whose sums and distances are exact."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from meshframe.llm import store


def finite(name: str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    vector = store.column(name)
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def fixed_point(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as int64.

    An error where squared distances of such vectors, times their length, would leave 64 bits (in 64 dimensions, components from about 23,000 on).
    """
    if not len(column):
        return np.empty((0, 0), np.int64)
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(len(column), -1)
    most = math.isqrt((1 << 63) - 1) // (2 * max(1, x.shape[1]))
    if x.size and np.abs(x).max() > most:
        raise ValueError(f"a component times {scale} exceeds {most}: distances would not be exact")
    return x.astype(np.int64)
