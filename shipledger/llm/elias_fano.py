"""Elias-Fano code of a non-decreasing sequence, with select.

n values up to u take n * (2 + log2(u / n)) bits or so: the low ``l`` bits of every value are
stored as they are, the rest in unary in one bit vector, where value i sets bit
``(value >> l) + i``. ``select(i)`` finds the i-th set bit from the nearest sampled one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Set bits of a byte, and the place of its k-th set bit.
_ONES = _BITS.sum(axis=1).astype(np.int64)
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable")


def low_width(n: int, universe: int) -> int:
    return max(0, (universe // max(1, n)).bit_length() - 1)


def build(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(low width, low bits, high bits, position of every 64th set bit) of sorted values."""
    values = np.asarray(values, dtype=np.int64)
    n = len(values)
    if n == 0:
        return 0, b"", b"", b""
    width = low_width(n, int(values[-1]) + 1)
    low = values & ((1 << width) - 1)
    shifts = np.arange(width, dtype=np.int64)
    low_bits = np.packbits(((low[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little")
    places = (values >> width) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
    high[places] = 1
    return (
        width,
        low_bits.tobytes(),
        np.packbits(high, bitorder="little").tobytes(),
        places[::SAMPLE].astype("<u4").tobytes(),
    )


class EliasFano:
    """Reads what ``build`` made; holds the code, not the values."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, width
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")

    def select(self, i: int) -> int:
        """Value number ``i``, counted from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left = i % SAMPLE
        place = int(self.samples[i // SAMPLE])
        if left:
            byte = (place + 1) // 8
            skip = (place + 1) % 8
            while True:
                bits = np.unpackbits(self.high[byte : byte + 32], bitorder="little")
                ones = np.flatnonzero(bits[skip:])
                if len(ones) >= left:
                    place = byte * 8 + skip + int(ones[left - 1])
                    break
                left -= len(ones)
                byte, skip = byte + 32, 0
        low = 0
        for bit in range(self.width):
            at = i * self.width + bit
            low |= (int(self.low[at >> 3]) >> (at & 7) & 1) << bit
        return (place - i) << self.width | low

    def select_many(self, places: np.ndarray) -> np.ndarray:
        """The values of many numbers at once, each by select: byte by rank, bit inside the byte by table."""
        places = np.asarray(places, dtype=np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.n):
            raise IndexError(places)
        if not len(places):
            return np.zeros(0, dtype=np.int64)
        ranks = np.cumsum(_ONES[self.high], dtype=np.int64)
        byte = np.searchsorted(ranks, places, side="right")
        inside = places - ranks[byte] + _ONES[self.high[byte]]
        values = (byte * 8 + _SELECT[self.high[byte], inside] - places) << self.width
        for bit in range(self.width):
            at = places * self.width + bit
            values |= (self.low[at >> 3].astype(np.int64) >> (at & 7) & 1) << bit
        return values

    def all(self) -> np.ndarray:
        """All values, decoded at once."""
        if self.n == 0:
            return np.zeros(0, dtype=np.int64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (places - np.arange(self.n)) << self.width
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width]
            weights = 1 << np.arange(self.width, dtype=np.int64)
            values = values | (bits.reshape(self.n, self.width) @ weights)
        return values
