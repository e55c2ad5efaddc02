"""Elias-Fano sequences and the token file format built on them.

A file holds the ids of its documents in one array and, as Elias-Fano sequences, the ascending
doc_ids and where each document starts. All integers are little-endian:

    magic 8 bytes "LGTOKEN2" | width u32 (2 or 4 bytes an id) | documents without an id u32 (they come first) | documents u64 | ids u64
    | bytes of section 1 u64 | bytes of section 2 u64
    | section 1: doc_ids less the first, preceded by the first (i64)
    | section 2: starts of the documents, and the number of ids
    | ids

A sequence of n values up to u takes n * (2 + log2(u / n)) bits and a hint of 32 bits for every
256th value, where its bit is. One value is selected from its hint; many are from counts of the ones
before each byte, in 32 bits too.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"LGTOKEN2"
HINT = 256


#: Where the k-th one of each byte is, from the lowest bit.
_BIT = np.array([[b for b in range(8) if x >> b & 1] + [0] * (8 - x.bit_count()) for x in range(256)], np.int64)


class EliasFano:
    """A non-descending sequence of integers from 0, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, hints: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.hints = n, low_bits, low, high, hints

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, upper = len(v), int(v[-1]) if len(v) else 0
        if n and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("the values must not descend, nor be under 0")
        low_bits = max(0, (upper // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.int64)
        low = np.packbits((v[:, None] >> shifts & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> low_bits) + np.arange(n)
        if n and ones[-1] >= 1 << 32:
            raise ValueError("too long a sequence for hints of 32 bits")
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::HINT].astype("<u4"))

    def dump(self) -> bytes:
        head = struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.hints))
        return head + self.low.tobytes() + self.high.tobytes() + self.hints.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes | memoryview) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<QQQQQ", data)
        low = np.frombuffer(data, np.uint8, a, 40)
        high = np.frombuffer(data, np.uint8, b, 40 + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", c, 40 + a + b))

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return ((self.low[at >> 3] >> (at & 7) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """Value i: from the nearest hint, bytes are counted up to the one that holds its bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.hints[i // HINT]), i % HINT
        byte = at >> 3
        rest = int(self.high[byte]) >> (at & 7) << (at & 7)
        left += 1
        while (ones := rest.bit_count()) < left:
            left, byte = left - ones, byte + 1
            rest = int(self.high[byte])
        for _ in range(left - 1):
            rest &= rest - 1
        place = byte * 8 + (rest & -rest).bit_length() - 1
        low = int(self._low(np.array([i], np.int64))[0]) if self.low_bits else 0
        return (place - i) << self.low_bits | low

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``: the byte of each one's bit from the counts of ones before, the bit from a table."""
        i = np.asarray(i, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(i)
        counts = np.bitwise_count(self.high)
        before = np.cumsum(counts, dtype=np.uint32) - counts
        byte = np.searchsorted(before, i.astype(np.uint32), side="right") - 1
        place = byte * 8 + _BIT[self.high[byte], i - before[byte]]
        return (place - i) << self.low_bits | (self._low(i) if self.low_bits else 0)

    def all(self) -> np.ndarray:
        i = np.arange(self.n, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (ones - i) << self.low_bits | (self._low(i) if self.low_bits else 0)


def dump_tokens(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, missing: int = 0) -> bytes:
    """A file of documents: ``missing`` ones without an id, then those of ``doc_ids`` in ascending order; ``ids`` is all their ids in that order."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    first = int(doc_ids[0]) if len(doc_ids) else 0
    one = struct.pack("<q", first) + EliasFano.of(np.asarray(doc_ids, np.int64) - first).dump()
    two = EliasFano.of(np.append(0, np.cumsum(np.asarray(lengths, np.int64)))).dump()
    head = MAGIC + struct.pack("<IIQQQQ", width, missing, missing + len(doc_ids), len(ids), len(one), len(two))
    return head + one + two + np.asarray(ids, f"<u{width}").tobytes()


class TokenFile:
    """A token file in memory: ``doc_ids``, ``bounds`` and the ids of a document by its place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        width, self.missing, self.documents, self.n_ids, one, two = struct.unpack_from("<IIQQQQ", data, 8)
        view = memoryview(data)[48:]
        self.first = struct.unpack_from("<q", view)[0]
        self.doc_ids = EliasFano.load(view[8:one])
        self.bounds = EliasFano.load(view[one : one + two])
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, one + two)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """(doc_id, ids) of the document at place i."""
        doc_id = None if i < self.missing else self.first + self.doc_ids.select(i - self.missing)
        return doc_id, self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]
