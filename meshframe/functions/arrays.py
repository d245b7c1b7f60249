"""Row-major index arithmetic on shapes and index columns."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def strides(shape: Sequence[int]) -> list[int]:
    """Cells between neighbours along each axis, last axis fastest."""
    return [prod(shape[d + 1 :]) for d in range(len(shape))]


def ravel(indices: Sequence[Column | str], shape: Sequence[int]) -> Column:
    """The linear index of a cell."""
    total = F.lit(0).cast("long")
    for i, stride in zip(indices, strides(shape), strict=True):
        total = total + (F.col(i) if isinstance(i, str) else i).cast("long") * F.lit(stride)
    return total


def unravel(linear: Column | str, shape: Sequence[int]) -> list[Column]:
    """The index along each axis of a linear index."""
    linear = F.col(linear) if isinstance(linear, str) else linear
    return [F.floor(linear / F.lit(s)).cast("long") % F.lit(n) if s > 1 else linear % F.lit(n) for s, n in zip(strides(shape), shape, strict=True)]


def extent_product(extent: Column | str) -> Column:
    """The number of cells of an extent array."""
    return F.aggregate(extent, F.lit(1).cast("long"), lambda n, e: n * e)
