"""Elias-Fano coding of a non-decreasing sequence, with select.

Each value is split into low bits, stored packed, and a high part, stored in
unary in a bit vector: value i sets the bit at position ``high + i``. That
takes about 2 + log2(largest / count) bits a value. Select finds the i-th set
bit from a sparse sample of positions, so any value is read without a table of
64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<qqb7x")


class EliasFano:
    def __init__(self, count: int, largest: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.largest, self.low_bits, self.low, self.high = count, largest, low_bits, low, high
        ones = np.unpackbits(high, bitorder="little") if len(high) else np.zeros(0, np.uint8)
        # Positions of every SAMPLE-th set bit: the only table select needs.
        self.sampled = np.flatnonzero(ones)[::SAMPLE].astype(np.int64)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        count = len(values)
        largest = int(values[-1]) if count else 0
        if count and (values[0] < 0 or np.any(np.diff(values) < 0)):
            raise ValueError("values must be non-negative and in order")
        low_bits = max(0, (largest // count).bit_length() - 1) if count else 0
        bits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        marks = np.zeros((largest >> low_bits) + count if count else 0, np.uint8)
        marks[(values >> low_bits) + np.arange(count)] = 1
        return cls(count, largest, low_bits, low, np.packbits(marks, bitorder="little"))

    def _lows(self, start: int, stop: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(stop - start, np.int64)
        first, last = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")
        bits = bits[first % 8 : first % 8 + last - first].reshape(-1, self.low_bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, index: int) -> int:
        """The value at ``index``."""
        return ((self.position(index) - index) << self.low_bits) + int(self._lows(index, index + 1)[0])

    def position(self, index: int) -> int:
        """The place of the set bit with this number."""
        if not 0 <= index < self.count:
            raise IndexError(index)
        at = int(self.sampled[index // SAMPLE])
        left, byte = index % SAMPLE, at // 8
        bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        bits[: at % 8] = 0
        while True:
            ones = np.flatnonzero(bits)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left -= len(ones)
            byte += 64
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")

    def range(self, start: int, stop: int) -> np.ndarray:
        """The values from ``start`` up to ``stop``: select finds the first, a scan of the bits the others."""
        if start >= stop:
            return np.zeros(0, np.int64)
        first, last = self.position(start), self.position(stop - 1)
        byte = first // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : last // 8 + 1], bitorder="little")) + byte * 8
        ones = ones[(ones >= first) & (ones <= last)]
        return ((ones - np.arange(start, stop)) << self.low_bits) + self._lows(start, stop)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count] if self.count else np.zeros(0)
        return ((ones.astype(np.int64) - np.arange(self.count)) << self.low_bits) + self._lows(0, self.count)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.count, self.largest, self.low_bits) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        count, largest, low_bits = _HEAD.unpack_from(data)
        n_low = -(-count * low_bits // 8)
        low = np.frombuffer(data, np.uint8, n_low, _HEAD.size)
        return cls(count, largest, low_bits, low, np.frombuffer(data, np.uint8, offset=_HEAD.size + n_low))
