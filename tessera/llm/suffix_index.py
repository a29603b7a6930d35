"""A logarithmic family of suffix arrays that stays in the shared folder, for corpora that come in batches.

A level is a table of contexts of anchors (see `anchors`), sorted by k-gram and suffix: a
sparse suffix array. A new batch gets one, is merge-scanned against the levels for long
matches, and becomes a level itself; levels of equal size merge, so that a context is
rewritten a logarithmic number of times. Levels hold contexts of at most 2 * length - k
bytes, some five times the text; texts themselves are not kept. A state is named by a manifest that is
written last: an `add` that fails leaves the state before it, and can be repeated.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col
from .anchors import Anchors
from .common import stored, text_key, text_of
from .suffix_dedup import _CONTEXT_SQL, _SETTLED, _TOGETHER, _WINDOW, _WINDOWS, _binary, _finish, _HotWindows, _repeated_windows
from .suffix_family import SuffixFamily, runs
from .textscan import pieces

_LEVEL = "key long, th binary, at long, suffix binary, before binary"
_FOUND = "th binary, start long, end long"
_TEXTS = "th binary, copies long"
_ORDER = ("key", "suffix", "th", "at")


def _all_contexts(length: int, k: int):
    """(th, text) to the contexts of all anchors; `before` runs forwards."""
    schema = pa.schema([("key", pa.int64()), ("th", pa.binary()), ("at", pa.int64()), ("suffix", pa.binary()), ("before", pa.binary())])

    def run(batches):
        anchors = Anchors(length, k)
        for batch in batches:
            for lo, _, data, starts, ends in pieces(_binary(batch.column(1)), _TOGETHER):
                found, blob = anchors.scan(data, starts, ends), data.tobytes()
                which = np.searchsorted(ends, found.position, "right")
                for first in range(0, len(which), _WINDOWS // 16):
                    part = slice(first, first + _WINDOWS // 16)
                    at, doc = found.position[part], which[part]
                    spans = list(zip(at.tolist(), starts[doc].tolist(), ends[doc].tolist()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.key[part].view(np.int64)), batch.column(0).take(pa.array(doc + lo)), pa.array(at - starts[doc]),
                            pa.array([blob[p : min(p + length, e)] for p, _, e in spans], pa.binary()), pa.array([blob[max(s, p - length + k) : p] for p, s, _ in spans], pa.binary()),
                        ],
                        schema=schema,
                    )

    return run


def _scan(length: int, k: int):
    """Spans of windows shared within a k-gram, whose contexts follow each other; one k-gram is held at a time."""

    def run(batches):
        family, now, group, out = SuffixFamily(length, k), None, [], []

        def settle():
            family.mask.clear()
            family.match(sorted((s, b[::-1], slot) for slot, (_, _, s, b) in enumerate(group)))
            for slot, mask in family.mask.items():
                th, at = group[slot][:2]
                out.extend((th, at - high, at - low + length) for low, high in runs(mask))

        def rows():
            part = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))], names=["th", "start", "end"])
            out.clear()
            return part

        for batch in batches:
            for key, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    settle()
                    now, group = key, []
                    if len(out) >= 1 << 14:
                        yield rows()
                group.append(entry)
        settle()
        if out:
            yield rows()

    return run


def _hot_windows(length: int, k: int):
    """Contexts of hot anchors to hashed windows: of the windows around an anchor, those that choose it."""

    def run(batches):
        anchors, windows = Anchors(length, k), _HotWindows(length)
        for batch in batches:
            th, at, suffix, before = (batch.column(i).to_pylist() for i in range(1, 5))
            for lo in range(0, len(th), 4096):
                some = slice(lo, lo + 4096)
                data = np.frombuffer(b"".join(b + s for b, s in zip(before[some], suffix[some])), np.uint8)
                left = np.array([len(b) for b in before[some]])
                ends = np.cumsum(left + [len(s) for s in suffix[some]])
                starts = np.append(0, ends[:-1])
                found = anchors.scan(data, starts, ends, windows=True)
                row = np.searchsorted(ends, found.window_start, "right")
                own = found.window_anchor == (starts + left)[row]
                start, row = found.window_start[own], row[own]
                h1, h2 = anchors.window_hashes(data, start)
                bounds = np.searchsorted(row, np.arange(len(ends) + 1))
                for i in range(len(ends)):
                    part = slice(bounds[i], bounds[i + 1])
                    windows.add(th[lo + i], start[part] - starts[i] - left[i] + at[lo + i], h1[part], h2[part])
                if windows.size >= _WINDOWS:
                    yield from windows.flush()
        yield from windows.flush()

    return run


class SuffixIndex:
    """The family in the folder `path`, which all executors share; one writer at a time.

    `length`, `k` and `hot` must be the same in every call on one folder. Null text
    counts as empty; empty and short texts have no windows. Equal texts, within a batch
    or over batches, are held once with their count; an empty batch adds no level.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = 200, k: int = 64, hot: int = 4096):
        self.spark, self.path, self.length, self.k, self.hot = spark, path.rstrip("/"), length, k, hot

    def _folder(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def _files(self):
        return self._folder().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        files = self._files()
        if not files.exists(self._folder()):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(self._folder()) if s.getPath().getName().startswith("manifest-"))
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return [n for n in names if files.exists(path(f"{self.path}/{n}/_SUCCESS"))]

    def _state(self) -> list[tuple[str, str, int]]:
        """(kind, folder, size) of the newest state, levels from the largest to the smallest."""
        made = self._manifests()
        if not made:
            return []
        rows = self.spark.read.parquet(f"{self.path}/{made[-1]}").collect()
        return [(r.kind, r.name, r.size) for r in sorted(rows, key=lambda r: r.place)]

    def levels(self) -> list[int]:
        """Contexts in each level."""
        return [size for kind, _, size in self._state() if kind == "level"]

    def _read(self, state, kind: str, schema: str) -> DataFrame:
        names = [f"{self.path}/{name}" for k, name, _ in state if k == kind]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, label: str) -> str:
        name = f"{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _level(self, contexts: DataFrame) -> tuple[str, str, int]:
        name = self._write(contexts.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER), "level")
        return "level", name, self.spark.read.schema(_LEVEL).parquet(f"{self.path}/{name}").count()

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Adds a batch: its suffix array is scanned against all levels, and what repeats is noted for old and new texts."""
        length, k, state = self.length, self.k, self._state()
        text = text_of(col(text_col))
        texts = docs.select(text_key(text).alias("th"), text.alias("t")).groupBy("th").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
        texts = stored(texts, "batch")
        counts = ("texts", self._write(texts.select("th", "copies"), "texts"), 0)
        fresh = texts.join(self._read(state, "texts", _TEXTS), "th", "left_anti").select("th", "t")
        batch = self._level(fresh.mapInArrow(_all_contexts(length, k), _LEVEL))
        state.append(counts)
        if batch[2]:
            mine, others = self._read([batch], "level", _LEVEL), self._read(state, "level", _LEVEL)
            keys = stored(mine.groupBy("key").agg(F.count("*").alias("n")), "keys")
            old = others.select("key").join(keys.select("key"), "key").groupBy("key").agg(F.count("*").alias("old"))
            again = stored(keys.join(old, "key", "left").select("key", (F.col("n") + F.coalesce("old", F.lit(0))).alias("total")).where("total > 1"), "again")
            both = mine.unionByName(others).join(again, "key")
            cold = both.where(F.col("total") <= self.hot).drop("total").repartition("key").sortWithinPartitions("key", "suffix")
            hot = stored(both.where(F.col("total") > self.hot).drop("total").mapInArrow(_hot_windows(length, k), _CONTEXT_SQL), "windows")
            windows = hot.where(F.col("kind").isin(_WINDOW, _SETTLED)).select("h1", "h2", "kind", "th", "at").repartition("h1", "h2")
            settled = hot.where(~F.col("kind").isin(_WINDOW, _SETTLED)).select("th", F.col("at").alias("start"), F.col("h1").alias("end"))
            found = cold.mapInArrow(_scan(length, k), _FOUND).unionByName(windows.mapInArrow(_repeated_windows(length), _FOUND)).unionByName(settled)
            state.append(("found", self._write(found, "found"), 0))
            levels = [s for s in state if s[0] == "level"] + [batch]
            while len(levels) > 1 and levels[-2][2] <= levels[-1][2]:
                pair = [levels.pop() for _ in range(2)]
                levels.append(self._level(self._read(pair, "level", _LEVEL)))
            state = [s for s in state if s[0] != "level"] + levels
        self._commit(state)

    def _commit(self, state: list[tuple[str, str, int]]) -> None:
        made = self._manifests()
        rows = [(i, *s) for i, s in enumerate(state)]
        number = int(made[-1].split("-")[1]) + 1 if made else 0
        name = f"manifest-{number:08d}"
        self.spark.createDataFrame(rows, "place int, kind string, name string, size long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")
        wanted, path, files = {name, *(s[1] for s in state)}, self.spark._jvm.org.apache.hadoop.fs.Path, self._files()
        for status in files.listStatus(self._folder()):
            if status.getPath().getName() not in wanted:
                files.delete(path(f"{self.path}/{status.getPath().getName()}"), True)

    def report(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """For each row of `docs` whose text was added: id, n_bytes, n_removed, n_spans, kept_sha256, spans, over all batches so far.

        The same as `suffix_dedup` over the batches together; null and repeated ids are kept, other columns ignored.
        """
        state, text = self._state(), text_of(col(text_col))
        copies = self._read(state, "texts", _TEXTS).groupBy("th").agg(F.sum("copies").alias("copies"))
        spans = self._read(state, "found", _FOUND).groupBy("th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        texts = docs.select(text_key(text).alias("th"), text.alias("t")).groupBy("th").agg(F.first("t").alias("t"))
        rows = texts.join(copies, "th").join(spans, "th", "left").select("th", "t", "copies", "spans")
        done = rows.mapInArrow(_finish(self.length), "_th binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
        return docs.select(col(id_col), text_key(text).alias("_th")).join(stored(done, "report"), "_th").drop("_th")

