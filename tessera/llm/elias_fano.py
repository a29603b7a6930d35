"""Elias-Fano sequences over numpy arrays, and files that hold several of them.

A sorted sequence of n integers below a bound takes about 2 + log2(bound / n) bits an
element: low bits packed, high bits in unary. All operations take arrays of queries.
"""

from __future__ import annotations

import json

import numpy as np

_U = np.uint64
_ONE = _U(1)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each 64-bit word."""
    at = np.zeros(len(word), np.uint64)
    k = k.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((word >> at) & _U((1 << half) - 1)).astype(np.int64)
        right = k >= low
        k = np.where(right, k - low, k)
        at = np.where(right, at + _U(half), at)
    return at.astype(np.int64)


class Bits:
    """A bit vector with select for ones and zeros; `before` counts the ones before each word."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    def select1(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, "right") - 1
        return word * 64 + _select_in_word(self.words[word], k - self.before[word])

    def select0(self, k: np.ndarray, zeros_before: np.ndarray) -> np.ndarray:
        word = np.searchsorted(zeros_before, k, "right") - 1
        return word * 64 + _select_in_word(~self.words[word], k - zeros_before[word])


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray], name: str):
        n, low, top = (int(x) for x in parts[f"{name}.shape"])
        self.n, self.low, self.top = n, low, top
        self.lows = parts[f"{name}.lows"]
        self.bits = Bits(parts[f"{name}.highs"], parts[f"{name}.before"])
        self.zeros = np.arange(len(self.bits.before), dtype=np.int64) * 64 - self.bits.before

    @staticmethod
    def encode(values: np.ndarray, bound: int, name: str) -> dict[str, np.ndarray]:
        """Arrays of the sorted values (uint64, below `bound`)."""
        n = len(values)
        low = max(0, (max(bound, 1) // max(n, 1)).bit_length() - 1)
        high = (values >> _U(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
        top = int(high[-1]) if n else 0
        flags = np.zeros(-(-(n + top + 1) // 64) * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        words = np.packbits(flags, bitorder="little").view("<u8")
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]))
        lows = np.zeros(8, np.uint8)
        if low and n:
            flat = np.zeros((n, low), np.uint8)
            for bit in range(low):
                flat[:, bit] = (values >> _U(low - 1 - bit)) & _ONE
            lows = np.concatenate((np.packbits(flat.ravel()), lows))
        return {f"{name}.shape": np.array([n, low, top]), f"{name}.lows": lows, f"{name}.highs": words, f"{name}.before": before}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        at, value = bit >> 3, np.zeros(len(i), np.uint64)
        span = (self.low + 14) // 8
        if span > 8:  # 57 bits and more may touch nine bytes
            first = self.lows[at].astype(np.uint64)
            for b in range(1, 9):
                value = (value << _U(8)) | self.lows[at + b]
            drop = ((72 - (bit & 7) - self.low)).astype(np.uint64)
            value = (value >> drop) | np.where(drop > 0, first << np.where(drop > 0, _U(64) - drop, _U(0)), _U(0))
        else:
            for b in range(span):
                value = (value << _U(8)) | self.lows[at + b]
            value >>= (span * 8 - (bit & 7) - self.low).astype(np.uint64)
        return value & _U((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        high = (self.bits.select1(i) - i).astype(np.uint64)
        return (high << _U(self.low)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x where it equals x, else -1: a bucket by the high bits, then its low bits."""
        out = np.full(len(x), -1, np.int64)
        high = (x >> _U(self.low)).astype(np.int64)
        inside = np.flatnonzero((high <= self.top) & (self.n > 0))
        if not len(inside):
            return out
        h = high[inside]
        hi = self.bits.select0(h, self.zeros) - h
        lo = np.zeros(len(h), np.int64)
        some = np.flatnonzero(h > 0)
        lo[some] = self.bits.select0(h[some] - 1, self.zeros) - (h[some] - 1)
        low, end = x[inside] & _U((1 << self.low) - 1), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        there = np.flatnonzero(lo < end)
        there = there[self._low(lo[there]) == low[there]]
        out[inside[there]] = lo[there]
        return out


def dump(parts: dict[str, np.ndarray]) -> bytes:
    """A file of named arrays: a JSON table of contents, then each array at a multiple of 8."""
    table, at = {}, 0
    for name, a in parts.items():
        table[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(table).encode()
    head = head.ljust(-(-len(head) // 8) * 8)
    body = [np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in parts.values()]
    return len(head).to_bytes(8, "little") + head + b"".join(body)


def load(buffer) -> dict[str, np.ndarray]:
    """The arrays of a file, as views of its (memory-mapped) bytes."""
    view = memoryview(buffer)
    size = int.from_bytes(view[:8], "little")
    table = json.loads(bytes(view[8 : 8 + size]))
    return {name: np.frombuffer(view, kind, n, 8 + size + at) for name, (kind, n, at) in table.items()}
