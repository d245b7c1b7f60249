"""Array-style selections as offsets and extents, and balanced splits of a dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    """A box of cells; axes in `dropped` were picked by an integer."""

    offset: tuple[int, ...]
    extent: tuple[int, ...]
    dropped: tuple[int, ...] = ()


def region(key, shape: Sequence[int]) -> Region:
    """What key selects of an array of the shape, by NumPy's rules for basic slices of step 1.

    Negative indices wrap, upper bounds are cropped, missing axes are whole. IndexError: other steps,
    None, several ellipses, too many indices, and integers outside.
    """
    key = key if isinstance(key, tuple) else (key,)
    if sum(k is Ellipsis for k in key) > 1:
        raise IndexError("more than one ellipsis")
    if any(k is None for k in key):
        raise IndexError("new axes can't be made")
    given = len([k for k in key if k is not Ellipsis])
    if given > len(shape):
        raise IndexError(f"{given} indices for {len(shape)} axes")
    whole = [slice(None)] * (len(shape) - given)
    at = next((i for i, k in enumerate(key) if k is Ellipsis), len(key))
    full = [*key[:at], *whole, *key[at + 1 :]]
    offset, extent, dropped = [], [], []
    for axis, (k, n) in enumerate(zip(full, shape, strict=True)):
        if isinstance(k, slice):
            if k.step not in (None, 1):
                raise IndexError("only steps of 1")
            start, stop, _ = k.indices(n)
            offset.append(start)
            extent.append(max(0, stop - start))
        else:
            i = int(k)
            if not -n <= i < n:
                raise IndexError(f"index {i} is outside axis {axis} of {n}")
            offset.append(i % n)
            extent.append(1)
            dropped.append(axis)
    return Region(tuple(offset), tuple(extent), tuple(dropped))


def hyperslab(shape: Sequence[int], offset: Sequence[int] | None = None, extent: Sequence[int] | None = None) -> Region:
    """A box by offset and extent: offset [0] is all zeros, extent [-1] the rest. ValueError if it isn't inside."""
    n = len(shape)
    offset = [0] * n if offset is None or (list(offset) == [0] and n != 1) else list(offset)
    if len(offset) != n:
        raise ValueError(f"an offset of {len(offset)} axes for {n}")
    extent = [s - o for s, o in zip(shape, offset, strict=True)] if extent is None or list(extent) == [-1] else list(extent)
    if len(extent) != n:
        raise ValueError(f"an extent of {len(extent)} axes for {n}")
    for axis, (o, e, s) in enumerate(zip(offset, extent, shape, strict=True)):
        if o < 0 or e < 0 or o + e > s:
            raise ValueError(f"[{o}, {o + e}) is outside axis {axis} of {s}")
    return Region(tuple(offset), tuple(extent))


def plane(shape: Sequence[int], axis: int, at: int = 0) -> Region:
    """One plane of an array."""
    return region(tuple(at if d == axis else slice(None) for d in range(len(shape))), shape)


def part(shape: Sequence[int], fraction: int, where: str = "centre") -> Region:
    """A box of 1 / fraction of each axis: first, centre or last."""
    extent = [max(1, s // fraction) for s in shape]
    offset = {"first": [0] * len(shape), "centre": [(s - e) // 2 for s, e in zip(shape, extent, strict=True)], "last": [s - e for s, e in zip(shape, extent, strict=True)]}[where]
    return hyperslab(shape, offset, extent)


def split(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, extent) of each of the balanced parts of n rows: floors, with the rest spread evenly, the last up to the end."""
    start = [n // parts * r + -(-(n % parts) * r // parts) for r in range(parts)] + [n]
    return [(a, b - a) for a, b in zip(start[:-1], start[1:], strict=True)]


def split_rows(df: DataFrame, n: Column, parts: int) -> DataFrame:
    """df with part, start and extent: a row for each of the balanced parts of n rows, as in split."""
    whole, rest, r = F.floor(n / F.lit(parts)), n % F.lit(parts), F.col("part")
    start = lambda k: (whole * k + F.ceil(rest * k / F.lit(parts))).cast("long")
    found = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return found.withColumns({"start": start(r), "extent": F.when(r == parts - 1, n).otherwise(start(r + 1)) - start(r)})


def split_axis(shape: Sequence[int]) -> int:
    """The axis to split: the longest, the first of equal ones."""
    return max(range(len(shape)), key=lambda d: (shape[d], -d))


def mode_fields(mode: int) -> tuple[int, int]:
    """First index and number of the fields of an azimuthal mode: one for mode 0, real and imaginary for others."""
    if mode < 0:
        raise ValueError("modes start at 0")
    return (0, 1) if mode == 0 else (2 * mode - 1, 2)
