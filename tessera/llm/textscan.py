"""Vectorised scans of many texts at once, over their concatenated UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken together; a longer text makes a piece by itself.
TOGETHER = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_VALUE = np.random.default_rng(20230517).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads low-entropy differences."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def pieces(texts: pa.Array, together: int = TOGETHER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, starts, ends) for runs of consecutive texts (binary, no nulls)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + together, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def word_blocks(texts: pa.Array, together: int = TOGETHER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bool, bool]]:
    """`pieces`, with a long text in several: each is cut behind white space, so no word is in two.

    The last two tell whether the piece opens its texts and whether it closes them.
    """
    for lo, hi, data, starts, ends in pieces(texts, together):
        if len(data) <= 2 * together:
            yield lo, hi, data, starts, ends, True, True
            continue
        at = 0
        while at < len(data):
            to = at + together
            while to < len(data):
                space = np.flatnonzero(SPACE[data[to : to + together]])
                to += int(space[0]) + 1 if len(space) else together
                if len(space):
                    break
            to = min(to, len(data))
            yield lo, hi, data[at:to], np.zeros(1, np.int64), np.array([to - at]), at == 0, to == len(data)
            at = to


def word_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each run without ASCII white space; words end with their text."""
    space = SPACE[data]
    before = np.concatenate(([True], space[:-1])) if len(data) else space
    after = np.concatenate((space[1:], [True])) if len(data) else space
    full = starts < ends
    before[starts[full]] = True
    after[ends[full] - 1] = True
    first = np.flatnonzero(~space & before)
    last = np.flatnonzero(~space & after) + 1
    return first, last, np.searchsorted(ends, first, "right")


#: Bytes of words hashed at a time.
_RUN = 1 << 18
_UP = powers(_RUN)


def _sum(data: np.ndarray) -> np.uint64:
    """The running polynomial of one word, however long."""
    total, scale = 0, 1
    for at in range(0, len(data), _RUN):
        part = data[at : at + _RUN]
        total += scale * int((_VALUE[part] * _UP[: len(part)]).sum(dtype=np.uint64))
        scale = scale * pow(_BASE, _RUN, 1 << 64) % (1 << 64)
    return _U(total % (1 << 64))


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, the same wherever it stands.

    A polynomial with odd coefficients modulo 2^64: two given words collide with a
    probability of about 2^-60 for words of ordinary length, not against an adversary.
    """
    length = last - first
    out = length.astype(np.uint64)
    total = np.concatenate(([0], np.cumsum(length)))
    at = 0
    while at < len(first):
        to = int(np.searchsorted(total, total[at] + _RUN, "right")) - 1
        if to <= at:
            out[at] += _sum(data[first[at] : last[at]])
            at += 1
            continue
        begin, n = total[at:to] - total[at], length[at:to]
        place = np.arange(total[to] - total[at]) - np.repeat(begin, n)
        out[at:to] += np.add.reduceat(_VALUE[data[place + np.repeat(first[at:to], n)]] * _UP[place], begin)
        at = to
    return mix(out)
