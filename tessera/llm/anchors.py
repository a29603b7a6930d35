"""Content-defined anchors: positions that equal strings choose alike.

For every window of `length` bytes the k-gram with the least hash in it (the leftmost
of ties) is an anchor. The choice depends on the window's bytes alone, so two equal
windows have their anchors at the same offset, and comparing what surrounds anchors
with equal k-grams finds every repeated window. About one position in
(length - k + 2) / 2 is an anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BLOCK = 1 << 16
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_TABLES = _RNG.integers(0, 2**63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


class Rolling:
    """Hashes of all substrings of one length, by differences of a running polynomial."""

    def __init__(self, block: int, which: int):
        self.table = _TABLES[which]
        self.up = _powers(_BASES[which], block)
        self.down = _powers(pow(_BASES[which], -1, 2**64), block)

    def running(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, running: np.ndarray, length: int) -> np.ndarray:
        h = running[length:] - running[:-length]
        h *= self.down[: len(h)]
        return _mix(h)


@dataclass(frozen=True)
class Found:
    """Anchors in ascending position (of the whole buffer), their k-gram hashes, and the windows that chose them."""

    position: np.ndarray
    key: np.ndarray
    window_start: np.ndarray
    window_anchor: np.ndarray


class Anchors:
    def __init__(self, length: int = 200, k: int = 64):
        if not 0 < k <= length:
            raise ValueError("the anchor's k-gram must fit in the window")
        self.length, self.k, self.w = length, k, length - k + 1
        self.rolling = [Rolling(_BLOCK + length, i) for i in range(2)]
        self.slot = _U((1 << (_BLOCK + length).bit_length()) - 1)

    def _window_ok(self, n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, np.maximum(starts, ends - self.length + 1), 1)
        np.add.at(step, ends, -1)
        return np.cumsum(step[:n]) == 0

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: bool = False) -> Found:
        """Anchors of the texts data[starts[i]:ends[i]], which follow each other; no window crosses texts.

        With `windows`, also every window's start and its anchor's position.
        """
        ok = self._window_ok(len(data), starts, ends)
        at, keys, win, chosen = [], [], [], []
        for off in range(0, max(len(data) - self.length + 1, 0), _BLOCK):
            valid = ok[off : off + _BLOCK]
            if not valid.any():
                continue
            part = data[off : off + _BLOCK + self.length - 1]
            h = self.rolling[0].of(self.rolling[0].running(part), self.k)
            v = (h & ~self.slot) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= self.w:
                v = np.minimum(v[:-width], v[width:])
                width *= 2
            if self.w > width:
                v = np.minimum(v[: width - self.w], v[self.w - width :])
            least = (v[: len(valid)] & self.slot).astype(np.int64)
            start = np.flatnonzero(valid[: len(least)])
            least = least[start]
            if not len(least):
                continue
            new = np.concatenate(([True], least[1:] != least[:-1]))
            at.append(least[new] + off)
            keys.append(h[least[new]])
            if windows:
                win.append(start + off)
                chosen.append(least + off)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        position, first = np.unique(join(at, np.int64), return_index=True)
        return Found(position, join(keys, np.uint64)[first], join(win, np.int64), join(chosen, np.int64))

    def window_hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows at `starts` (ascending)."""
        out = [np.zeros(len(starts), np.uint64) for _ in range(2)]
        if len(starts):
            for off in range(int(starts[0]) // _BLOCK * _BLOCK, int(starts[-1]) + 1, _BLOCK):
                lo, hi = np.searchsorted(starts, (off, off + _BLOCK))
                if lo < hi:
                    part = data[off : off + _BLOCK + self.length - 1]
                    for h, roll in zip(out, self.rolling):
                        h[lo:hi] = roll.of(roll.running(part), self.length)[starts[lo:hi] - off]
        return out[0], out[1]
