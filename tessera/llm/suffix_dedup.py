"""Repeated long substrings by a logarithmic family of suffix arrays.

Equal texts are first merged into one (with their count). Every text then emits the
hashes of its anchors (see `anchors`), counted over the whole corpus; only anchors
whose k-gram occurs again go on. Their contexts are dealt out by k-gram, and within
each task stream in batches into a `SuffixFamily`. A k-gram with more than
`hot` occurrences would make one task's group grow with the corpus; the windows
around its anchors are hashed (128 bits) instead: a task settles those it has twice
itself and sends one row for each, so that a window costs a row a task however often
it occurs, and those that several tasks sent are repeated too. The answer is the same.
What is repeated comes back to the texts as spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col, cols
from .anchors import Anchors
from .common import free_name, stored, text_key, text_of
from .suffix_family import SuffixFamily, runs
from .textscan import pieces

#: Bytes of text that one vectorised scan takes together; a longer text is scanned by itself, in blocks.
_TOGETHER = 1 << 21
#: Contexts in a batch of the family.
_BATCH = 8192


def _binary(column) -> pa.Array:
    return column.cast(pa.binary())


def _emit_anchors(length: int, k: int):
    def run(batches):
        scan = Anchors(length, k).scan
        for batch in batches:
            for lo, _, data, starts, ends in pieces(_binary(batch.column(1)), _TOGETHER):
                found = scan(data, starts, ends)
                if not len(found.key):
                    continue
                doc = np.searchsorted(ends, found.position, "right")
                order = np.lexsort((found.key, doc))
                doc, key = doc[order], found.key[order]
                first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
                n = np.diff(np.append(first, len(key)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first].view(np.int64)), batch.column(0).take(pa.array(doc[first] + lo)), pa.array(n.astype(np.int64))],
                    names=["key", "th", "n"],
                )

    return run


#: Rows of the contexts' table: an anchor's context; a window around a hot anchor; a window
#: whose occurrences in its task are settled already; a settled run of windows (at, h1).
_CONTEXT, _WINDOW, _SETTLED, _RUN = range(4)
_CONTEXT_SCHEMA = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("th", pa.binary()), ("at", pa.int64()), ("suffix", pa.binary()), ("before", pa.binary())])
_CONTEXT_SQL = "kind int, h1 long, h2 long, th binary, at long, suffix binary, before binary"
#: Windows around hot anchors that a task settles together.
_WINDOWS = 1 << 20


def _equal_pairs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each group in it, size of each row's group in it) of equal pairs."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    size = np.diff(np.append(first, len(a)))
    return order, first, np.repeat(size, size)


def _runs_of(owner: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the runs that windows at consecutive positions cover."""
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + 1))))
    last = np.append(new[1:], len(at)) - 1
    return owner[new], at[new], at[last] + length if len(at) else at


class _HotWindows:
    """Windows around hot anchors, each sent on once for all its occurrences in a task."""

    def __init__(self, length: int):
        self.length, self.texts, self.held, self.size = length, [], [], 0

    def add(self, th: bytes, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        self.held.append((h1, h2, np.full(len(at), len(self.texts)), at))
        self.texts.append(th)
        self.size += len(at)

    def flush(self):
        if not self.size:
            return
        h1, h2, owner, at = (np.concatenate(x) for x in zip(*self.held))
        order, first, size = _equal_pairs(h1, h2)
        here = order[size > 1]
        one = order[first]
        texts = pa.array(self.texts, pa.binary())
        run_owner, start, end = _runs_of(owner[here], at[here], self.length)
        for kind, a, b, who, where in (
            (np.where(size[first] > 1, _SETTLED, _WINDOW), h1[one].view(np.int64), h2[one].view(np.int64), owner[one], at[one]),
            (np.full(len(start), _RUN), end, np.zeros(len(start), np.int64), run_owner, start),
        ):
            n = len(where)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(a), pa.array(b), texts.take(pa.array(who)), pa.array(where), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                schema=_CONTEXT_SCHEMA,
            )
        self.texts, self.held, self.size = [], [], 0


def _emit_contexts(length: int, k: int):
    names = _CONTEXT_SCHEMA.names

    def run(batches):
        anchors, windows = Anchors(length, k), _HotWindows(length)
        for batch in batches:
            cold, hot = batch.column(2), batch.column(3)
            for lo, hi, data, starts, ends in pieces(_binary(batch.column(1)), _TOGETHER):
                found = anchors.scan(data, starts, ends, windows=any(len(hot[i]) for i in range(lo, hi)))
                bounds = np.searchsorted(found.position, np.append(starts, len(data)))
                rows = {name: [] for name in names}
                blob = data.tobytes()
                for i in range(lo, hi):
                    th = batch.column(0)[i].as_py()
                    a, b = bounds[i - lo], bounds[i - lo + 1]
                    position, key = found.position[a:b], found.key[a:b].view(np.int64)
                    start, end = int(starts[i - lo]), int(ends[i - lo])
                    wanted = np.isin(key, cold[i].values.to_numpy(zero_copy_only=False))
                    for p, x in zip(position[wanted].tolist(), key[wanted].tolist()):
                        for name, value in zip(names, (_CONTEXT, x, 0, th, p - start, blob[p : min(p + length, end)], blob[max(start, p - length + k) : p][::-1])):
                            rows[name].append(value)
                    if len(hot[i]):
                        chosen = position[np.isin(key, hot[i].values.to_numpy(zero_copy_only=False))]
                        l2, h2 = np.searchsorted(found.window_start, (start, end))
                        at = found.window_start[l2:h2][np.isin(found.window_anchor[l2:h2], chosen)]
                        windows.add(th, at - start, *anchors.window_hashes(data, at))
                        if windows.size >= _WINDOWS:
                            yield from windows.flush()
                if rows["th"]:
                    yield pa.RecordBatch.from_pydict(rows, schema=_CONTEXT_SCHEMA)
        yield from windows.flush()

    return run


def _repeated_windows(length: int):
    """Spans of windows that came from more than one place; every task that has a window sent one row of it."""

    def run(batches):
        held = [tuple(batch.columns) for batch in batches if len(batch)]
        if not held:
            return
        h1, h2, kind, at = (np.concatenate([h[i].to_numpy(zero_copy_only=False) for h in held]) for i in (0, 1, 2, 4))
        th = pa.chunked_array([h[3] for h in held]).combine_chunks()
        order, _, size = _equal_pairs(h1, h2)
        here = order[size > 1]
        here = here[kind[here] == _WINDOW]
        codes = th.dictionary_encode()
        owner, start, end = _runs_of(codes.indices.to_numpy()[here], at[here], length)
        yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(owner)), pa.array(start), pa.array(end)], names=["th", "start", "end"])

    return run


def _family_spans(length: int, k: int):
    def run(batches):
        family, owner = SuffixFamily(length, k), []
        for batch in batches:
            th, at, suffix, before = (batch.column(i).to_pylist() for i in range(1, 5))
            for lo in range(0, len(th), _BATCH):
                first = len(owner)
                owner.extend(zip(th[lo : lo + _BATCH], at[lo : lo + _BATCH]))
                family.add((s, b, first + i) for i, (s, b) in enumerate(zip(suffix[lo : lo + _BATCH], before[lo : lo + _BATCH])))
        found = [(owner[slot][0], owner[slot][1] - high, owner[slot][1] - low + length) for slot, mask in family.mask.items() for low, high in runs(mask)]
        for lo in range(0, len(found), 1 << 16):
            th, start, end = zip(*found[lo : lo + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(th, pa.binary()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["th", "start", "end"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _finish(length: int):
    schema = pa.schema([("th", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        for batch in batches:
            rows = []
            texts = _binary(batch.column(1))
            for i in range(len(batch)):
                text = texts[i].as_buffer()
                n, data = len(text), memoryview(text)
                if batch.column(2)[i].as_py() > 1 and n >= length:
                    spans = [(0, n)]
                else:
                    spans = merged([(s["start"], s["end"]) for s in batch.column(3)[i].as_py() or ()])
                kept, at = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(data[at:start])
                    at = end
                kept.update(data[at:])
                rows.append((batch.column(0)[i].as_py(), n, sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _texts_and_spans(docs: DataFrame, text_col: str, length: int, k: int = 64, hot: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(th, t, copies) of distinct texts, and (th, spans) of those with repeats, spans not merged yet."""
    text = text_of(col(text_col))
    texts = docs.select(text_key(text).alias("th"), text.alias("t")).groupBy("th").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    texts = stored(texts, "texts")
    keys = stored(texts.select("th", "t", "copies").mapInArrow(_emit_anchors(length, k), "key long, th binary, n long"), "anchors")
    again = keys.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1")
    cold, many = F.col("total") <= hot, F.col("total") > hot
    wanted = keys.join(again, "key").groupBy("th").agg(
        F.collect_list(F.when(cold, F.col("key"))).alias("cold"), F.collect_list(F.when(many, F.col("key"))).alias("hot")
    )
    contexts = texts.join(wanted, "th").select("th", "t", "cold", "hot")
    contexts = stored(contexts.mapInArrow(_emit_contexts(length, k), _CONTEXT_SQL), "contexts")
    span = "th binary, start long, end long"
    family = contexts.where(F.col("kind") == _CONTEXT).select("h1", "th", "at", "suffix", "before").repartition("h1")
    windows = contexts.where(F.col("kind").isin(_WINDOW, _SETTLED)).select("h1", "h2", "kind", "th", "at").repartition("h1", "h2")
    settled = contexts.where(F.col("kind") == _RUN).select("th", F.col("at").alias("start"), F.col("h1").alias("end"))
    spans = family.mapInArrow(_family_spans(length, k), span).unionByName(windows.mapInArrow(_repeated_windows(length), span)).unionByName(settled)
    spans = spans.groupBy("th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts, spans


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 200, k: int = 64, hot: int = 4096) -> DataFrame:
    """Per distinct text: th (its key), n_bytes, n_removed, n_spans, kept_sha256, spans.

    `spans` are the maximal runs of UTF-8 bytes covered by a string of `length` bytes
    that starts anywhere else too: in another text, in another row with the same text,
    or elsewhere in the same text, overlaps included. Null text counts as empty; texts
    shorter than `length` have no spans; an empty table gives no rows.
    """
    texts, spans = _texts_and_spans(docs, text_col, length, k, hot)
    done = texts.join(spans, "th", "left").select("th", "t", "copies", "spans")
    return done.mapInArrow(
        _finish(length),
        "th binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>",
    )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, **options) -> DataFrame:
    """`repeated_spans` for every row: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    One row for each input row: null ids, repeated ids and repeated rows included
    (a repeated row is a copy like any other). Other columns are ignored.
    """
    found = stored(repeated_spans(docs, text_col, length, **options), "spans")
    rows = docs.select(col(id_col), text_key(text_of(col(text_col))).alias("_th"))
    return rows.join(found.withColumnRenamed("th", "_th"), "_th").drop("_th")


def _cut(length: int):
    def run(batches):
        for batch in batches:
            texts, out, cut = _binary(batch.column(1)), [], []
            for i in range(len(batch)):
                text = texts[i].as_py()
                if batch.column(2)[i].as_py() > 1 and len(text) >= length:
                    out.append("")
                    cut.append(True)
                    continue
                parts, at = [], 0
                for start, end in merged([(s["start"], s["end"]) for s in batch.column(3)[i].as_py() or ()]):
                    while start < end and text[start] & 0xC0 == 0x80:  # whole characters only
                        start += 1
                    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
                        end -= 1
                    parts.append(text[at:start])
                    at = end
                rest = b"".join([*parts, text[at:]])
                out.append(rest.decode())
                cut.append(len(rest) < len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(cut, pa.bool_())], names=["th", "kept", "cut"])

    return run


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = 200, **options) -> DataFrame:
    """`docs` with the repeated spans cut out of their texts, whole characters at a time.

    Rows of which something was cut and nothing is left but white space go; other columns,
    whatever their names, and texts without repeats, null or empty ones too, are unchanged.
    Repeated rows are copies like any other; an empty table stays empty.
    """
    texts, spans = _texts_and_spans(docs, text_col, length, **options)
    kept = texts.join(spans, "th", "left").select("th", "t", "copies", "spans").mapInArrow(_cut(length), "th binary, kept string, cut boolean")
    key, mine = free_name(docs, "_key"), free_name(docs, "_kept")
    kept = kept.select(F.col("th").alias(key), F.struct("kept", "cut").alias(mine))
    rows = docs.withColumn(key, text_key(text_of(col(text_col))))
    rows = rows.withColumn(text_col, F.when(col(text_col).isNull(), F.lit(True)))  # of the text only whether it was null is moved
    rows = rows.join(kept, key).where(~F.col(f"{mine}.cut") | F.rlike(f"{mine}.kept", F.lit(r"[^\x20\x09-\x0D]")))
    return rows.select(*[F.when(col(c).isNull(), F.col(f"{mine}.kept")).alias(c) if c == text_col else col(c) for c in docs.columns])
