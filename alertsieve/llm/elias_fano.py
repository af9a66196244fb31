"""Elias-Fano coding of non-decreasing offsets, with select.

``n`` offsets up to ``u`` are kept as ``l = floor(log2(u / n))`` low bits each
and a bit vector of their high parts in unary: about ``n * (2 + log2(u / n))``
bits.  ``select(i)`` finds the i-th set bit by a 32-bit count for each 512
bits of the vector, then inside that block; no table of offsets is made.
``select_range`` does so for a run of offsets at once.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBxxxxxxx")
_BLOCK = 64  # bytes: 512 bits


class EliasFano:
    def __init__(self, n: int, u: int, l: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.u, self.l = n, u, l
        self._low, self._high, self._counts = low, high, counts

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        l = max(0, (u // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.reshape(-1), bitorder="little")
        at = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        size = -(-(int(at[-1]) + 1 if n else 1) // (8 * _BLOCK)) * _BLOCK
        unary = np.zeros(size * 8, dtype=np.uint8)
        unary[at] = 1
        return cls._with_counts(n, u, l, low, np.packbits(unary, bitorder="little"))

    @classmethod
    def _with_counts(cls, n, u, l, low, high):
        ones = np.bitwise_count(high).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)
        counts = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32)
        return cls(n, u, l, low, high, counts)

    def to_bytes(self) -> bytes:
        return (_HEAD.pack(self.n, self.u, self.l) + struct.pack("<QQ", len(self._low), len(self._high))
                + self._low.tobytes() + self._high.tobytes() + self._counts.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data, at: int = 0) -> tuple["EliasFano", int]:
        """The coding that starts at byte ``at``, and where it ends."""
        n, u, l = _HEAD.unpack_from(data, at)
        a, b = struct.unpack_from("<QQ", data, at + _HEAD.size)
        at += _HEAD.size + 16
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        counts = np.frombuffer(data, "<u4", b // _BLOCK, at + a + b)
        return cls(n, u, l, low, high, counts), at + a + b + counts.nbytes

    def _low_bits(self, i: int) -> int:
        first = i * self.l
        value = int.from_bytes(self._low[first >> 3:(first + self.l + 7) >> 3].tobytes(), "little")
        return (value >> (first & 7)) & ((1 << self.l) - 1)

    def select(self, i: int) -> int:
        """The i-th offset."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self._counts, i, side="right")) - 1
        bits = np.unpackbits(self._high[block * _BLOCK:(block + 1) * _BLOCK], bitorder="little")
        at = block * _BLOCK * 8 + int(np.flatnonzero(bits)[i - int(self._counts[block])])
        return ((at - i) << self.l) | self._low_bits(i)

    def select_range(self, a: int, b: int) -> np.ndarray:
        """Offsets ``a`` to ``b - 1`` as int64; only their blocks are unpacked."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, dtype=np.int64)
        first, last = (int(np.searchsorted(self._counts, i, side="right")) - 1 for i in (a, b - 1))
        bits = np.unpackbits(self._high[first * _BLOCK:(last + 1) * _BLOCK], bitorder="little")
        skip = int(self._counts[first])
        at = first * _BLOCK * 8 + np.flatnonzero(bits)[a - skip:b - skip]
        out = (at - np.arange(a, b)).astype(np.int64) << self.l
        if self.l:
            start, end = a * self.l, b * self.l
            low = np.unpackbits(self._low[start >> 3:(end + 7) >> 3], bitorder="little")
            low = low[start & 7:(start & 7) + end - start].reshape(b - a, self.l)
            out |= (low.astype(np.int64) << np.arange(self.l)).sum(axis=1)
        return out

    def all(self) -> np.ndarray:
        """Every offset, as int64."""
        at = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[:self.n]
        out = (at - np.arange(self.n)).astype(np.int64) << self.l
        if self.l:
            bits = np.unpackbits(self._low, count=self.n * self.l, bitorder="little").reshape(self.n, self.l)
            out |= (bits.astype(np.int64) << np.arange(self.l)).sum(axis=1)
        return out
