"""A logarithmic family of sparse suffix arrays over anchored contexts.

Entries are (suffix, reversed left context, slot): the bytes from an anchor on, the
bytes before it backwards, and whose they are. A new batch is sorted into a suffix
array of its own, merge-scanned against every level for long matches, and becomes a
level; levels of equal size merge, so that an entry is merged a logarithmic number
of times and the levels' sizes fall geometrically.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from itertools import groupby

Entry = tuple[bytes, bytes, int]


def common_prefix(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class SuffixFamily:
    """Finds, per slot, the windows of `length` bytes around its anchor that some other slot's context has too.

    mask[slot] has bit d set if the window that starts d bytes before the anchor is
    shared. Suffixes are cut at `length` bytes and left contexts at length - core, as
    no window reaches further.
    """

    def __init__(self, length: int = 200, core: int = 64):
        self.length, self.core, self.reach = length, core, length - core
        self.levels: list[list[Entry]] = []
        self.mask: dict[int, int] = {}

    def add(self, batch: Iterable[Entry]) -> None:
        fresh = sorted(batch)
        if not fresh:
            return
        top = b"\xff" * (self.length - self.core + 1)
        for core, same in groupby(fresh, key=lambda e: e[0][: self.core]):
            group = list(same)
            self.match(group)
            for level in self.levels:
                lo = bisect_left(level, (core,))
                hi = bisect_left(level, (core + top,), lo)
                if lo < hi:
                    self.match(sorted(level[lo:hi] + group))
        self.levels.append(fresh)
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = sorted(self.levels[-1] + last)  # two sorted runs: one linear merge

    def match(self, group: list[Entry]) -> None:
        """Marks the windows shared within entries of one core, in suffix order.

        Neighbours are joined from the longest common prefix down, the smaller set
        into the larger; within the larger, the longest common left context of an
        entry is that with a neighbour in the order of reversed left contexts. No pairs
        are formed: n log n neighbours are looked at.
        """
        n = len(group)
        if n < 2:
            return
        right = [common_prefix(group[i][0], group[i + 1][0]) for i in range(n - 1)]
        sets: list[list[tuple[bytes, int]]] = [[(e[1], e[2])] for e in group]
        owner = list(range(n))

        def find(i: int) -> int:
            while owner[i] != i:
                owner[i] = owner[owner[i]]
                i = owner[i]
            return i

        mask = self.mask
        for i in sorted(range(n - 1), key=right.__getitem__, reverse=True):
            a, b = find(i), find(i + 1)
            if len(sets[a]) < len(sets[b]):
                a, b = b, a
            large, small, low = sets[a], sets[b], self.length - right[i]
            for item in small:
                at = bisect_left(large, item)
                for other in large[max(at - 1, 0) : at + 1]:
                    high = min(common_prefix(item[0], other[0]), self.reach)
                    if high >= low:
                        bits = ((1 << (high - low + 1)) - 1) << low
                        mask[item[1]] = mask.get(item[1], 0) | bits
                        mask[other[1]] = mask.get(other[1], 0) | bits
            large.extend(small)
            large.sort()
            sets[b] = []
            owner[b] = a


def runs(mask: int) -> list[tuple[int, int]]:
    """Maximal runs (low, high) of set bits."""
    out, at = [], 0
    while mask:
        skip = (mask & -mask).bit_length() - 1
        mask >>= skip
        at += skip
        length = (~mask & (mask + 1)).bit_length() - 1
        out.append((at, at + length - 1))
        mask >>= length
        at += length
    return out
