"""Sorted sequences of integers in near-minimal space, read at any place.

n values up to u take about 2 + log2(u / n) bits each: the lower bits as they are, the upper ones in unary, as set bits. The place of
every SAMPLE-th set bit is kept too, in 32 bits; from there the i-th set bit is found in a few bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Values for each kept place, and values whose lower bits are packed at once (a multiple of 8).
SAMPLE, BLOCK = 256, 1 << 16
#: Values of a sequence at most: the places fit 32 bits.
MOST = 1 << 30


class Layout:
    """Where the parts of a sequence of n values up to `last` lie: lower bits, upper bits, kept places."""

    def __init__(self, n: int, last: int):
        self.n, self.last = n, last
        self.low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        self.low_bytes = (n * self.low_bits + 7) // 8
        self.high_bytes = ((last >> self.low_bits) + n + 7) // 8 if n else 0
        self.places = -(-n // SAMPLE)
        self.size = self.low_bytes + self.high_bytes + 4 * self.places


def dump(values: np.ndarray) -> bytes:
    """The bytes of values, which are uint64 and don't fall."""
    n = len(values)
    if n > MOST:
        raise ValueError(f"{n} values: a sequence has at most {MOST}")
    if not n:
        return b""
    at = Layout(n, int(values[-1]))
    low, width = [], np.arange(at.low_bits, dtype=np.uint64)
    for lo in range(0, n if at.low_bits else 0, BLOCK):
        bits = values[lo : lo + BLOCK, None] >> width & np.uint64(1)
        low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    ones = (values >> np.uint64(at.low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(at.high_bytes, np.uint8)
    np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    return b"".join(low) + high.tobytes() + ones[::SAMPLE].astype("<u4").tobytes()


class Sequence:
    """A stored sequence; read(offset, size) gives bytes of it."""

    def __init__(self, n: int, last: int, read: Callable[[int, int], bytes]):
        self.at, self.read = Layout(n, last), read

    def _place(self, i: int) -> int:
        return int(np.frombuffer(self.read(self.at.low_bytes + self.at.high_bytes + 4 * i, 4), "<u4")[0])

    def _ones(self, a: int, b: int) -> np.ndarray:
        """Places of the set bits a to b - 1."""
        first, stop = a // SAMPLE, -(-b // SAMPLE)
        start = self._place(first) // 8
        end = self._place(stop) // 8 + 1 if stop < self.at.places else self.at.high_bytes
        bits = np.unpackbits(np.frombuffer(self.read(self.at.low_bytes + start, end - start), np.uint8), bitorder="little")
        ones = np.flatnonzero(bits) + 8 * start
        skip = int(np.searchsorted(ones, self._place(first)))  # set bits before the kept one, in its byte
        return ones[skip + a - first * SAMPLE : skip + b - first * SAMPLE]

    def values(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, as uint64."""
        if a >= b:
            return np.empty(0, np.uint64)
        high = (self._ones(a, b) - np.arange(a, b)).astype(np.uint64)
        bits = self.at.low_bits
        if not bits:
            return high
        start, end = a * bits // 8, (b * bits + 7) // 8
        raw = np.unpackbits(np.frombuffer(self.read(start, end - start), np.uint8), bitorder="little")
        own = raw[a * bits - 8 * start :][: (b - a) * bits].reshape(b - a, bits).astype(np.uint64)
        return high << np.uint64(bits) | (own << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
