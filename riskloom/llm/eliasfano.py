"""Elias-Fano codes of ascending numbers with constant-time select.

A number is split: its low bits are stored as they are, its high part in unary in a bit vector where
the i-th one stands at (high part + i). With ``log2(range / count)`` low bits that is at most two bits
a number above them. Counts of ones per 512 bits let select jump to its block, so no table of offsets is
needed. All queries are answered for whole arrays at a time.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 8  # words of 64 bits per counted block
HEAD = struct.Struct("<qqqB")  # count, smallest, words of the upper part, low bits


def encode(values: np.ndarray) -> bytes:
    """Bytes of an ascending int64 array; equal neighbours are fine."""
    n = len(values)
    if not n:
        return HEAD.pack(0, 0, 0, 0)
    base = int(values[0])
    shifted = (values.astype(np.int64) - np.int64(base)).view(np.uint64)
    low_bits = max(0, ((int(shifted[-1]) + 1) // n).bit_length() - 1)
    ones = (shifted >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    words = -(-(int(ones[-1]) + 1) // (64 * BLOCK)) * BLOCK
    upper = np.zeros(words * 64, np.uint8)
    upper[ones] = 1
    upper = np.packbits(upper, bitorder="little")
    counts = np.bitwise_count(upper.view("<u8")).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
    before = np.append(0, np.cumsum(counts)[:-1]).astype("<u4")
    low = np.zeros(0, np.uint8)
    if low_bits:
        digits = (shifted[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(digits.astype(np.uint8).ravel(), bitorder="little")
    return HEAD.pack(n, base, words, low_bits) + upper.tobytes() + before.tobytes() + low.tobytes()


class Decoder:
    """Select over the bytes of :func:`encode`, which may be followed by anything."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.count, self.base, words, self.low_bits = HEAD.unpack_from(data, at)
        at += HEAD.size
        self.upper = np.frombuffer(data, "<u8", words, at)
        at += 8 * words
        self.before = np.frombuffer(data, "<u4", words // BLOCK, at)
        at += 4 * (words // BLOCK)
        size = -(-self.count * self.low_bits // 8)
        self.low = np.concatenate([np.frombuffer(data, "u1", size, at), np.zeros(9, np.uint8)])
        self.end = at + size

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at ``index``."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.before, index, side="right") - 1
        rest = index - self.before[block]
        words = self.upper[block[:, None] * BLOCK + np.arange(BLOCK)]
        ends = np.cumsum(np.bitwise_count(words).astype(np.int64), axis=1)
        word = (ends <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(word > 0, ends[np.arange(len(index)), word - 1], 0)
        bits = np.unpackbits(words[np.arange(len(index)), word].astype("<u8").view("u1")
                             .reshape(-1, 8), axis=1, bitorder="little")
        inside = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        high = (block * BLOCK + word) * 64 + inside - index
        value = (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(index)
        return value.view(np.int64) + np.int64(self.base)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        first = index * self.low_bits
        window = self.low[(first >> 3)[:, None] + np.arange(9)].astype(np.uint64)
        shift = (first & 7).astype(np.uint64)
        value = (window[:, :8] << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(
            axis=1, dtype=np.uint64) >> shift
        over = np.where(shift > 0, window[:, 8] << (np.uint64(64) - np.maximum(shift, np.uint64(1))),
                        np.uint64(0))
        return (value | over) & np.uint64((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        parts = [self.select(np.arange(i, min(i + 8192, self.count)))
                 for i in range(0, self.count, 8192)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)
