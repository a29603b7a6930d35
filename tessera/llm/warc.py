"""WARC archives of page captures, and their index by external k-way merging.

Captures are written as gzip-compressed WARC/1.1 records, one archive per task, with
equal payloads stored once and referred to by revisit records. Archives are then read
back record by record, a task each; each gives a run of index entries, sorted on its own
by URL key and time and written as a file of blocks. A merge task has a range of keys: it
opens each run at the range's first block and streams the blocks through a loser tree, so
that it holds one block of each run. Where there are more runs than it may open, groups of
them are merged into longer ones first. The ranges in their order are the captures' history.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from operator import itemgetter
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from . import files
from .common import shared_dir, stored, text_of

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
#: Bytes of an archive after which a task starts another.
ARCHIVE = 1 << 30
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20
#: Entries of a run's block; runs that one task merges; entries of a range, as a target; blocks that ranges are cut from.
BLOCK_ROWS, FAN_IN, RANGE_ROWS, SAMPLE_BLOCKS = 1 << 11, 64, 1 << 17, 100_000


def url_key(url: str | None) -> str:
    """Sort key of a URL: the host's labels from the top down, then port, path and query, in lower case."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    labels = host.removeprefix("www.").split(".")[::-1]
    return ",".join(labels) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_time(page_id: int | None) -> str:
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{capture_time(page_id)}|{digest}')}>"


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: tuple[int, str | None] | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the payload's length, and no payload.

    refers_to: page id and URL of the response that a revisit refers to by its record id.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}",
        f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        page, target = refers_to
        head += [
            f"WARC-Profile: {_PROFILE}",
            f"WARC-Refers-To: {record_id(page, target, digest)}",
            f"WARC-Refers-To-Target-URI: {quote(target or '', safe=_URL_SAFE)}",
            f"WARC-Refers-To-Date: {capture_time(page)}",
            f"X-Refers-To-Page-ID: {page}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def members(source, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of an archive, read in order."""
    at, waiting = 0, b""
    while at < size or waiting:
        begin, inflate, content = at - len(waiting), zlib.decompressobj(31), []
        while not inflate.eof:
            if not waiting:
                waiting = source.read_at(min(_READ, size - at), at)
                if not waiting:
                    raise ValueError(f"archive ends within the record at {begin}")
                at += len(waiting)
            content.append(inflate.decompress(waiting))
            waiting = inflate.unused_data if inflate.eof else b""
        yield begin, at - len(waiting) - begin, b"".join(content)


def parse(content: bytes) -> tuple[dict[str, str], int, bytes]:
    """(WARC headers, length that the HTTP header states, payload) of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    stated = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields, stated, payload


class LoserTree:
    """Merges sorted runs: each next item costs one comparison per level, against the losers on its path."""

    def __init__(self, runs: Iterable[Iterable], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads = [self._pull(i) for i in range(len(self.runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _pull(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x < y)  # the run's number settles ties before the items are asked

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self.losers[at] < 0:  # the other side has not come yet
                self.losers[at] = i
                return
            if self._beats(self.losers[at], i):
                i, self.losers[at] = self.losers[at], i
            at //= 2
        self.losers[0] = i

    def __iter__(self):
        while (head := self.heads[self.losers[0]]) is not None:
            yield head[2]
            winner = self.losers[0]
            self.heads[winner] = self._pull(winner)
            self._play(winner)


def _with_roles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    payload = text_of(col(html_col)).cast("binary")
    rows = pages.select(col(id_col).alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= LEAST_SHARED
    shared = rows.where(large).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(stored(shared, "shared-payloads"), "digest", "left")
    revisit = large & (F.col("page_id") < F.col("first.page_id"))
    first = lambda c: F.when(revisit, F.col(f"first.{c}"))
    return rows.select("page_id", "url", "payload", "digest", first("page_id").alias("refers_to"), first("url").alias("refers_to_url"))


def write_archives(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write archives to a new shared folder; (folder, the names of committed tasks' archives).

    Payloads are html in UTF-8 (null: empty). Of equal payloads of LEAST_SHARED bytes or
    more, captures of the largest page_id are responses and others revisit it; a null
    page_id is always a response. The capture time is the epoch of the collection plus
    page_id seconds. Archives roll over at ARCHIVE bytes.
    """
    folder = shared_dir(pages.sparkSession, "warc")

    def run(batches):
        task = TaskContext.get()
        sink, count, done = None, 0, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to, target in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None or sink.tell() >= ARCHIVE:
                    if sink:
                        sink.close()
                    done.append(f"captures-{task.partitionId()}-{task.taskAttemptId()}-{count}.warc.gz")
                    sink, count = files.create(folder, done[-1]), count + 1
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                sink.write(squeeze.compress(record(page_id, url, digest, payload, None if refers_to is None else (refers_to, target))) + squeeze.flush())
        if sink:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    return folder, stored(_with_roles(pages, id_col, html_col).mapInArrow(run, "archive string"), "archives")


_ENTRY = pa.schema(
    [("url_key", pa.string()), ("capture_time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_ENTRY_SQL = "url_key string, capture_time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _order(entry: tuple):
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8]


def _batches(entries: Iterable[tuple], size: int = 1 << 14):
    block: list[tuple] = []
    for entry in entries:
        block.append(entry)
        if len(block) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), _ENTRY)], schema=_ENTRY)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), _ENTRY)], schema=_ENTRY)


_KEYS = ("url_key", "capture_time", "page_id", "archive", "offset")


def read_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Index entries of each archive, read from its records in order and sorted on their own, a task for each archive.

    A response's payload is hashed again and must have the digest and length its
    headers state; a revisit's are those of the payload it refers to.
    """

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.reader(folder, name) as source:
                    yield from _batches(entries(name, source))

    def entries(name, source):
        for offset, length, content in members(source, files.size(folder, name)):
            fields, stated, payload = parse(content)
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            if fields["warc-type"] == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"{name}: the record at {offset} does not hold what it states")
            page, refers = (fields.get(f"x-{x}page-id") for x in ("", "refers-to-"))
            yield (
                url_key(fields["warc-target-uri"]), fields["warc-date"].translate({ord(c): None for c in "-:TZ"}), None if page is None else int(page),
                stated, digest, fields["warc-type"], None if refers is None else int(refers), name, offset, length,
            )

    tasks = max(1, archives.count())  # a number of its own, as adaptive execution would merge these few rows
    return archives.repartitionByRange(tasks, "archive").mapInArrow(run, _ENTRY_SQL).sortWithinPartitions(*_KEYS)


def _write_blocks(folder: str, name: str, batches: Iterable[pa.RecordBatch]):
    """A run as a file of blocks; (rows, first entry's key) of each."""
    with files.create(folder, name) as sink, pa.ipc.new_file(sink, _ENTRY) as out:
        for batch in (b.slice(at, BLOCK_ROWS) for b in batches for at in range(0, len(b), BLOCK_ROWS)):
            out.write_batch(batch.cast(_ENTRY))
            yield len(batch), [batch.column(_ENTRY.get_field_index(k))[0].as_py() for k in _KEYS]


_BLOCK_SQL = "file string, rows long, url_key string, capture_time string, page_id long, archive string, offset long"


def write_runs(entries: DataFrame, folder: str) -> DataFrame:
    """Write each partition of sorted entries as a run; the blocks: (file, rows, first key)."""

    def run(batches):
        task = TaskContext.get()
        name = f"run-{task.partitionId()}-{task.taskAttemptId()}.arrow"
        found = [(name, n, *key) for n, key in _write_blocks(folder, name, batches)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _BLOCK_TYPES)], names=["file", "rows", *_KEYS])

    return stored(entries.mapInArrow(run, _BLOCK_SQL), "index-runs")


_BLOCK_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _sort_key(key) -> tuple:
    url, at, page, archive, offset = key
    return url, at, page is not None, page or 0, archive, offset


def _from(folder: str, name: str, low: tuple | None, high: tuple | None):
    """(key, entry) of a run from key `low` to before `high`; one block is held at a time."""
    with files.reader(folder, name) as source:
        blocks = pa.ipc.open_file(source)
        at, end = 0, blocks.num_record_batches
        if low is not None:  # the last block that begins at or before it
            lo, hi = 0, end
            while lo < hi:
                mid = (lo + hi) // 2
                first = blocks.get_batch(mid).slice(0, 1)
                if _order(tuple(c[0].as_py() for c in first.columns)) <= low:
                    lo = mid + 1
                else:
                    hi = mid
            at = max(lo - 1, 0)
        for i in range(at, end):
            for entry in zip(*(c.to_pylist() for c in blocks.get_batch(i).columns)):
                key = _order(entry)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, entry


def ranges(blocks: DataFrame) -> list[tuple[tuple | None, tuple | None]]:
    """Ranges of keys with about as many entries each, cut from a bounded sample of the blocks' first keys."""
    spark, total = blocks.sparkSession, blocks.agg(F.count("*"), F.sum("rows")).first()
    n = max(1, -(-(total[1] or 0) // RANGE_ROWS), min(spark.sparkContext.defaultParallelism, total[0] or 0))
    some = blocks if total[0] <= SAMPLE_BLOCKS else blocks.where(F.pmod(F.xxhash64(*_KEYS), F.lit(total[0] // SAMPLE_BLOCKS + 1)) == 0)
    keys = sorted({_sort_key(r) for r in some.select(*_KEYS).collect()})
    cuts = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
    return list(zip([None, *cuts], [*cuts, None]))


def merge_index(blocks: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """All entries in order of URL key, time and page: ranges of keys, each a loser-tree merge of its runs.

    Ranges are cut by the whole sort key, so captures of one URL are split by time however
    many there are. A task opens at most `fan_in` runs; more are merged in passes, by
    range and group, into runs of a range.
    """
    spark, parts = blocks.sparkSession, ranges(blocks)
    names = [r.file for r in blocks.select("file").distinct().orderBy("file").collect()]
    runs = {i: names for i in range(len(parts))}
    schema = "range int, part int, files array<string>"

    def tasks(jobs):
        return spark.createDataFrame([(r, g, f) for r, g, f in jobs], schema).repartitionByRange(max(1, len(jobs)), "range", "part")

    def merged(range_id: int, held: list[str]):
        return (entry for _, entry in LoserTree([_from(folder, f, *parts[range_id]) for f in held], itemgetter(0)))

    def longer(batches):
        task = TaskContext.get()
        for batch in batches:
            for r, g, held in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"merged-{r}-{g}-{task.taskAttemptId()}.arrow"
                for _ in _write_blocks(folder, name, _batches(merged(r, held), BLOCK_ROWS)):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([name])], names=["range", "file"])

    def last(batches):
        for batch in batches:
            for r, _, held in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches(merged(r, held))

    while max(map(len, runs.values()), default=0) > fan_in:
        jobs = [(r, g // fan_in, held[g : g + fan_in]) for r, held in runs.items() for g in range(0, len(held), fan_in)]
        done = stored(tasks(jobs).mapInArrow(longer, "range int, file string"), "merged-runs")
        runs = {r: [] for r in runs}
        for row in done.orderBy("range", "file").collect():
            runs[row["range"]].append(row["file"])
    return tasks([(r, 0, held) for r, held in runs.items()]).mapInArrow(last, _ENTRY_SQL)


def capture_history(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Write the pages as archives, read them back, and return the merged index, one entry per page row.

    Repeated rows are captures of their own; null urls have an empty target; an empty
    table gives no entries; other columns are ignored.
    """
    folder, archives = write_archives(pages, id_col, html_col)
    return merge_index(write_runs(read_runs(archives, folder), folder), folder)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), best AS (
  SELECT payload_digest, max(page_id) AS page FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT p.page_id, payload_bytes, p.payload_digest,
  CASE WHEN p.page_id < best.page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < best.page THEN best.page END AS refers_to
FROM p LEFT JOIN best ON p.payload_digest = best.payload_digest AND p.payload_bytes >= 1000
"""
