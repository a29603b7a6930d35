"""Order-preserving packing of documents into fixed windows by dynamic programming.

The documents of an input split, in their order, are one stream of tokens. A window is
a stretch of it of at most `length` tokens; it costs its padding, a little for being a
window at all, and a penalty if it ends within a document: small at the end of a
sentence, larger elsewhere. With f the least cost up to a boundary at position p,
    f(p) = penalty(p) + length - p + min { f(q) + q : p - length <= q < p }
so the minimum runs over a sliding window of boundaries, kept in a monotone queue. A
window whose size is a power of two needs no padding and is an extra transition. No
row is shuffled and a split keeps one stretch of the stream in memory at a time.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..functions.names import col
from .common import text_of
from .tokens import encoder

#: Tokens of penalty for a window, for ending it after a sentence, and for ending it elsewhere in a document.
PER_WINDOW, SENTENCE_CUT, HARD_CUT = 8, 4, 24
#: Where sentences are longer than this, positions at this distance are boundaries too.
_GRID = 64
#: Tokens taken together before windows are settled.
_STRETCH = 1 << 18


def boundaries(sentence_ends: np.ndarray, document_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions where a window may end, and their penalties; 0 comes first."""
    soft = np.unique(np.concatenate(([0], sentence_ends, document_ends)))
    gaps = np.diff(soft)
    extra = [np.arange(p + _GRID, p + g, _GRID) for p, g in zip(soft[:-1][gaps > _GRID], gaps[gaps > _GRID])]
    at = np.concatenate([soft, *extra])
    cost = np.concatenate((np.full(len(soft), SENTENCE_CUT), np.full(len(at) - len(soft), HARD_CUT)))
    order = np.argsort(at, kind="stable")
    at, cost = at[order], cost[order]
    cost[np.isin(at, document_ends)] = 0
    cost[0] = 0
    return at, cost


def cuts(at: np.ndarray, cost: np.ndarray, length: int, last: bool) -> list[int]:
    """Ends of the windows of least cost over boundaries `at` (from 0 on).

    If more of the stream is to come (`last` false), they end at the cheapest boundary
    of the last `length` tokens and what is left over is the next stretch's start. At
    the stream's end the rest is covered by windows whose sizes are powers of two
    where that costs less than padding it.
    """
    pos, pen = at.tolist(), cost.tolist()
    n = len(pos)
    if n == 1:
        return []
    index = {p: i for i, p in enumerate(pos)}
    least, come = [0.0] * n, [0] * n
    queue: deque[int] = deque()
    sizes = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    for j in range(1, n):
        i, p = j - 1, pos[j]
        value = least[i] + pos[i]
        while queue and least[queue[-1]] + pos[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
        while pos[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        best, source = least[i] + pos[i] + length - p, i
        for size in sizes:
            i = index.get(p - size)
            if i is not None and least[i] < best:
                best, source = least[i], i
        least[j], come[j] = best + pen[j] + PER_WINDOW, source
    end, tail = n - 1, []
    if last:
        options = [(least[n - 1], n - 1)]
        i = n - 2
        while i >= 0 and pos[n - 1] - pos[i] < length:
            options.append((least[i] + (pos[n - 1] - pos[i]).bit_count() * (PER_WINDOW + HARD_CUT), i))
            i -= 1
        end = min(options)[1]
        p = pos[end]
        while p < pos[n - 1]:
            p += 1 << ((pos[n - 1] - p).bit_length() - 1)
            tail.append(p)
    else:
        start = int(np.searchsorted(at, at[-1] - length))
        end = min(range(max(start, 1), n), key=lambda i: (least[i], -i))
    out = []
    while end:
        out.append(pos[end])
        end = come[end]
    return out[::-1] + tail


class Stream:
    """Tokens on their way into windows; yields pieces (id, start, length, crc32, document tokens, window, offset)."""

    def __init__(self, length: int, first_window: int):
        self.length, self.window = length, first_window
        self.docs: deque[tuple[object, np.ndarray, np.ndarray, int]] = deque()  # id, ids, sentence ends, tokens already placed
        self.size = 0

    def push(self, doc_id, ids: np.ndarray, sentence_ends: np.ndarray) -> None:
        self.docs.append((doc_id, ids, sentence_ends, 0))
        self.size += len(ids)

    def settle(self, last: bool) -> Iterator[tuple]:
        """Settles stretch by stretch until less than one is left, or all if no more will come."""
        while self.size >= _STRETCH or last and self.size:
            yield from self._stretch(last and self.size <= 2 * _STRETCH, 2 * _STRETCH)

    def _stretch(self, last: bool, most: int) -> Iterator[tuple]:
        base, ends, stops = 0, [], []
        for _, ids, sentences, placed in self.docs:
            n = min(len(ids) - placed, most - base)
            lo, hi = np.searchsorted(sentences, (placed, placed + n), "right")
            stops.append(sentences[lo:hi] - placed + base)
            base += n
            if placed + n == len(ids):
                ends.append(base)
            if base == most:
                break
        soft = np.concatenate(stops)
        at, cost = boundaries(np.append(soft, base), np.array(ends, np.int64))
        if base not in ends[-1:] and base not in soft[-1:]:
            cost[-1] = HARD_CUT
        here = 0
        for end in cuts(at, cost, self.length, last):
            offset = 0
            while here < end:
                doc_id, ids, sentences, placed = self.docs[0]
                n = min(len(ids) - placed, end - here)
                part = ids[placed : placed + n]
                yield doc_id, placed, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), self.window, offset
                here, offset = here + n, offset + n
                if placed + n == len(ids):
                    self.docs.popleft()
                else:
                    self.docs[0] = (doc_id, ids, sentences, placed + n)
            self.window += 1
        self.size -= here


def pack(
    docs: DataFrame, tokenizer: tuple, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
    end_id: int = 1, keep: list[str] | None = None,
) -> DataFrame:
    """One row per piece: the id (or the columns `keep`), start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids and one end id lie in order in consecutive windows; each id in
    exactly one piece. Window numbers are unique in the table: the input split's number
    and a count within it. Null and empty texts are the end id alone; repeated ids and
    rows are documents of their own; an empty table gives no rows. A long document is cut
    into windows stretch by stretch. Other columns are ignored.
    """
    keep = keep or [id_col]
    rows = docs.select(*[col(c) for c in keep], text_of(col(text_col)).alias("_packed"))
    types = [rows.schema[c].dataType.simpleString() for c in keep]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        encode = encoder(*tokenizer)
        stream = Stream(length, TaskContext.get().partitionId() << 33)
        schema = pa.schema([*zip(keep, (to_arrow_type(rows_types[c]) for c in keep)), *((c, pa.int64()) for c in COLUMNS)])

        def out(last: bool):
            found = [(*p[0], *p[1:]) for p in stream.settle(last)]
            for lo in range(0, len(found), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[lo : lo + (1 << 15)]), schema)], schema=schema)

        for batch in batches:
            for i in range(len(batch)):
                text = batch.column(len(keep))[i].as_py()
                ids = encode.encode(text)
                stops = np.flatnonzero(encode.ends_sentence[ids]) + 1
                stream.push(tuple(batch.column(c)[i].as_py() for c in range(len(keep))), np.append(ids, np.uint32(end_id)), stops)
                if stream.size >= _STRETCH:
                    yield from out(False)
        yield from out(True)

    rows_types = {c: rows.schema[c].dataType for c in keep}
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(keep, types))
    return rows.mapInArrow(run, schema + "".join(f", {c} long" for c in COLUMNS))


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
