"""Merged count-min sketches of hashes that answer one question: can this hash occur twice?

Each task counts its own hashes in sparse rows of cells, capped at two. The rows are summed cell by cell by
(row, block); what is left of a cell is one bit, set if two or more hashes fell in it. A hash whose bits are
not all set occurs once for certain; the estimate never errs in the other direction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm.words import mix

ROWS = 2
#: Bits of a row: 8 for each hash that is expected, within these bounds. Beyond the upper one the filter lets more through; see crowded.
LEAST_BITS, MOST_BITS = 16, 27
BLOCK_BITS = 18
BUFFER = 1 << 20
SCHEMA = "sketch_row int, sketch_block int, cells binary"


def width_bits(expected: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(8 * max(1, expected)).bit_length()))


def crowded(expected: int) -> bool:
    """Whether a row has fewer cells than hashes: then most hashes look repeated, and an exact filter has to follow (see shared)."""
    return expected > 1 << MOST_BITS


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(h, 101 + row) >> np.uint64(64 - bits)


def _packed(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted cell numbers of a block as gaps of 16 bits (0xFFFF: go on), and one bit each for a count of two."""
    gaps = np.diff(cells, prepend=0)
    big = gaps // 0xFFFF
    out = np.zeros(len(gaps) + int(big.sum()), np.uint16)
    at = np.cumsum(big + 1) - 1
    out[:] = 0xFFFF
    out[at] = gaps % 0xFFFF
    return len(out).to_bytes(4, "little") + out.tobytes() + np.packbits(twice).tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    gaps = np.frombuffer(blob, np.uint16, n, 4).astype(np.int64)
    cells = np.cumsum(gaps)[gaps != 0xFFFF]
    return cells, np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 + 2 * n), count=len(cells)).astype(bool)


def _flushed(parts: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    block = min(BLOCK_BITS, bits)
    h = np.concatenate(parts)
    for row in range(ROWS):
        cells, counts = np.unique(_cells(h, row, bits), return_counts=True)
        cells = cells.astype(np.int64)
        numbers, at = np.unique(cells >> block, return_index=True)
        at = np.append(at, len(cells))
        blobs = [_packed(cells[a:b] & ((1 << block) - 1), counts[a:b] > 1) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch({"sketch_row": pa.array([row] * len(numbers), pa.int32()), "sketch_block": pa.array(numbers, pa.int32()), "cells": pa.array(blobs, pa.binary())})


def _count(batches: Iterator[pa.RecordBatch], hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for h in hashes(batches):
        held.append(h)
        size += len(h)
        if size >= BUFFER:
            yield from _flushed(held, bits)
            held, size = [], 0
    if size:
        yield from _flushed(held, bits)


def _merge(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """One bit for each cell of the (row, block) pairs of this partition; a partition holds few, in constant memory."""
    seen: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            counts = seen.setdefault((row, block), np.zeros(1 << min(BLOCK_BITS, bits), np.uint8))
            cells, twice = _unpacked(blob.as_py())
            counts[cells] = np.minimum(counts[cells] + 1 + twice, 2)
    for (row, block), counts in seen.items():
        yield pa.record_batch({"sketch_row": pa.array([row], pa.int32()), "sketch_block": pa.array([block], pa.int32()), "cells": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})


class Repeats:
    """The merged bits; at most ROWS * 2**MOST_BITS / 8 bytes (32 MB), whatever the input."""

    def __init__(self, bits: int, rows: list[bytearray]):
        self.bits, self.rows = bits, rows

    def may_repeat(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, held in enumerate(self.rows):
            cells = _cells(h, row, self.bits)
            byte = np.frombuffer(held, np.uint8)[(cells >> np.uint64(3)).astype(np.int64)]
            out &= (byte >> (7 - (cells & np.uint64(7))).astype(np.uint8)) & 1 > 0
        return out


def repeats(df: DataFrame, column: str, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: int):
    """A broadcast Repeats of all hashes that `hashes` makes of the column's batches."""
    bits = width_bits(expected)
    counted = df.select(F.col(column)).mapInArrow(partial(_count, hashes=hashes, bits=bits), SCHEMA)
    merged = counted.repartition("sketch_row", "sketch_block").mapInArrow(partial(_merge, bits=bits), SCHEMA)
    held = [bytearray((1 << bits) // 8) for _ in range(ROWS)]
    size = (1 << min(BLOCK_BITS, bits)) // 8
    for batch in merged.toArrow().to_batches():
        for row, block, bit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            held[row][block * size : (block + 1) * size] = bit.as_py()
    return df.sparkSession.sparkContext.broadcast(Repeats(bits, held))


def text_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
