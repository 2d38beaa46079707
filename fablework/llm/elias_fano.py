"""Elias-Fano code of a non-decreasing sequence, with a select structure of 32-bit samples.

The upper bits stand in unary in a bit vector of at most ``2 n`` bits, the lower ``l`` bits are
packed: about ``2 + log2(universe / n)`` bits an entry. Every ``EVERY``-th one of the bit vector has
its position sampled, so ``select`` reads one sample and a short stretch of the vector.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 256
HEAD = struct.Struct("<IQBII")  # n, universe, low bits, bytes of low part, bytes of high part


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing, not negative."""
    v = np.asarray(values, np.uint64)
    n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = np.zeros((n + (universe >> low) + 8) // 8 + 1, np.uint8)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return HEAD.pack(n, universe, low, len(lows), len(high)) + lows + high.tobytes() + ones[::EVERY].astype("<u4").tobytes()


class EliasFano:
    """Reads an encoded sequence in place."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.universe, self.low, a, b = HEAD.unpack_from(data)
        at = HEAD.size
        self.low_bytes, self.high_bytes = memoryview(data)[at : at + a], memoryview(data)[at + a : at + a + b]
        self.lows = np.frombuffer(data, np.uint8, a, at)
        self.high = np.frombuffer(data, np.uint8, b, at + a)
        samples = -(-self.n // EVERY)
        self.samples = np.frombuffer(data, "<u4", samples, at + a + b)
        self.size = at + a + b + 4 * samples

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low):
            bit = i * self.low + k
            out |= ((self.lows[bit >> 3] >> (bit & 7)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: int) -> int:
        """The ``i``-th value (from 0): a sample, the words of the bit vector after it, and the low bits."""
        at = int(self.samples[i // EVERY])
        ones, byte = i % EVERY, at >> 3
        word = int.from_bytes(self.high_bytes[byte : byte + 8], "little") >> (at & 7) << (at & 7)
        while (have := word.bit_count()) <= ones:
            ones, byte = ones - have, byte + 8
            word = int.from_bytes(self.high_bytes[byte : byte + 8], "little")
        for _ in range(ones):
            word &= word - 1  # drops the lowest one
        one = byte * 8 + (word & -word).bit_length() - 1
        bit = i * self.low
        low = int.from_bytes(self.low_bytes[bit >> 3 : (bit + self.low + 7) >> 3], "little") >> (bit & 7)
        return ((one - i) << self.low) | (low & ((1 << self.low) - 1))

    def span(self, i: int) -> tuple[int, int]:
        """Where document ``i`` begins and ends, if the values are ends."""
        return self.select(i - 1) if i else 0, self.select(i)

    def select_all(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i).astype(np.uint64) << np.uint64(self.low)) | self._low(i)
