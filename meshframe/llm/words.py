"""Vectorised word and shingle hashes over Arrow batches: no Python loop over words.

Words are runs of bytes of a class in the UTF-8 text. A word's hash is 64 bits of a keyed polynomial
over its bytes; a shingle's hash is a polynomial over its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that belong to words: all but ASCII white space; and digits, a-z and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_Q = pow(int(_P), -1, 1 << 64)
_pow = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _P and of its inverse modulo 2**64, n of each at least."""
    global _pow
    if len(_pow[0]) < n:
        _pow = tuple(np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n, np.uint64(x))))) for x in (_P, _Q))
    return _pow


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_piece(data: np.ndarray, cuts: np.ndarray, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of data; no word crosses a cut."""
    if lower:
        data = _LOWER[data]
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    edge[cuts] |= inside[cuts] & inside[cuts - 1]
    starts = np.flatnonzero(edge[:-1] & inside)
    if len(data) and inside[0]:
        starts = np.concatenate(([0], starts))
    edge[-1] = len(data) > 0 and inside[-1]
    ends = np.flatnonzero(edge[1:] & inside) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i+1]], and where each text's words begin in them.

    Long texts are cut at non-word bytes, so that temporary arrays stay near PIECE bytes.
    """
    hashes, starts, lo, end = [], [], int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(end, lo + PIECE)
        if hi < end:
            size = PIECE
            while True:
                part = data[lo:min(end, lo + size)]
                outside = np.flatnonzero(~table[_LOWER[part] if lower else part])
                if len(outside):
                    hi = lo + int(outside[-1]) + 1
                    break
                if lo + size >= end:
                    hi = end
                    break
                size *= 2
        cuts = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
        h, s = _hash_piece(data[lo:hi], cuts, table, lower)
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive entries of h, by doubling; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    m = (0xD6E8FEB86659FD93 + 2 * salt * 0x2545F4914F6CDD1D) & (1 << 64) - 1 | 1
    with np.errstate(over="ignore"):
        whole, done, power, size = None, 0, mix(h, salt), 1
        while True:
            if k & size:
                whole = power if whole is None else whole[: len(power) - done] * np.uint64(pow(m, size, 1 << 64)) + power[done:] if done else power
                done += size
            if size * 2 > k:
                break
            power = power[:-size] * np.uint64(pow(m, size, 1 << 64)) + power[size:]
            size *= 2
        return mix(whole[: len(h) - k + 1], salt + 1)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(batches: Iterator[pa.RecordBatch], name: str, table: np.ndarray, lower: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about PIECE bytes of text each, with the words' hashes and offsets by row."""
    for batch in batches:
        data, offs = texts(batch.column(batch.schema.get_field_index(name)))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(offs, offs[row] + PIECE, side="right")) - 1)
            to = min(to, batch.num_rows)
            h, at = word_hashes(data, offs[row : to + 1], table, lower)
            yield batch.slice(row, to - row), h, at
            row = to


def binaries(parts: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column whose i-th value holds the bytes of parts[at[i]:at[i+1]]."""
    width = parts.dtype.itemsize * (parts.shape[1] if parts.ndim > 1 else 1)
    offsets = (np.asarray(at, np.int64) - int(at[0])) * width
    data = np.ascontiguousarray(parts[int(at[0]) : int(at[-1])]).tobytes()
    if len(data) < (1 << 31) - 1:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])
    raise ValueError("a batch of over 2 GB")
