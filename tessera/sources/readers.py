"""Tables of files as DataFrames, by data sources that executors read.

All values are text and each row has its 1-based position in the file (`_line`); types
come from the columns they are mapped to, so nothing depends on inference. A file's
rows are numbered by the one task that reads it; many files are read by many tasks.
"""

from __future__ import annotations

import csv
import io
import re
import shutil
import sqlite3
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import cols
from ..operators.lookup import with_source
from ..operators.merge import merge_views, recovery_state
from ..plans.preset import PresetError, Selector
from .catalog import Entry, detect, open_entry, read_bytes, siblings
from .sqlgate import check_sql, connect, quoted

LINE = "_line"


def _text(value: object) -> str | None:
    """A cell as text; nothing stays nothing, whole numbers have no point, bytes are hexadecimal."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bytes):
        return value.hex()
    return str(value)


# Delimited text


def csv_rows(entry: Entry, options: dict) -> Iterator[list[str]]:
    """Records from the header on; blank lines are passed over."""
    skip = int(options.get("skip_rows", 0) or 0) + int(options.get("header_row", 0) or 0)
    with io.TextIOWrapper(open_entry(entry), encoding=options.get("encoding") or "utf-8-sig", newline="") as text:
        rows = csv.reader(text, delimiter=str(options.get("delimiter") or ("\t" if entry.name.lower().endswith(".tsv") else ",")))
        for number, row in enumerate(rows):
            if number >= skip and row:
                yield row


def csv_columns(entry: Entry, options: dict) -> list[str]:
    return [c.strip("﻿") for c in next(csv_rows(entry, options), [])]


def _csv_table(entry: Entry, selector: Selector) -> tuple[list[str], Callable[[], Iterator[list]]]:
    options = dict(selector.read)

    def rows():
        source = csv_rows(entry, options)
        next(source, None)
        for row in source:
            yield [None if c == "" else c for c in row]

    return csv_columns(entry, options), rows


# Spreadsheets

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_names(entry: Entry) -> dict[str, str]:
    """Sheets of a workbook in order, with the parts that hold them."""
    book = zipfile.ZipFile(open_entry(entry))
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_SHEET}sheets")
    out = {}
    for s in sheets if sheets is not None else ():
        target = targets[s.get(_REL)].lstrip("/")
        out[s.get("name")] = target if target.startswith("xl/") else f"xl/{target}"
    return out


def _elements(stream, tag: str) -> Iterator[ET.Element]:
    """Elements of a tag as they end; their parent is emptied after each, so that a long part is never held."""
    path: list[ET.Element] = []
    for event, node in ET.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(node)
            continue
        path.pop()
        if node.tag == tag:
            yield node
            if path:
                path[-1].clear()


def _sheet_rows(entry: Entry, sheet: str) -> Iterator[list[str | None]]:
    parts = sheet_names(entry)
    if sheet not in parts:
        raise ValueError(f"{entry.logical_path} has no sheet {sheet!r}")
    book = zipfile.ZipFile(open_entry(entry))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as stream:
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in _elements(stream, f"{_SHEET}si")]
    last = 0
    with book.open(parts[sheet]) as stream:
        for row in _elements(stream, f"{_SHEET}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{_SHEET}c"):
                letters = re.match("[A-Z]+", cell.get("r") or "")
                at = 0
                for c in letters[0] if letters else "":
                    at = at * 26 + ord(c) - 64
                at = at - 1 if letters else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = cell.get("t"), cell.find(f"{_SHEET}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if kind == "s" else {"0": "False", "1": "True"}.get(value.text, value.text) if kind == "b" else value.text
            number = int(row.get("r") or last + 1)
            yield from ([] for _ in range(number - last - 1))
            last = number
            yield cells


def _excel_table(entry: Entry, selector: Selector) -> tuple[list[str], Callable[[], Iterator[list]]]:
    skip = int(selector.read.get("skip_rows", 0) or 0) + int(selector.read.get("header_row", 0) or 0)

    def body():
        rows = _sheet_rows(entry, selector.sheet)
        for _ in range(skip):
            next(rows, None)
        return rows

    header = next(body(), [])
    columns = [c if c not in (None, "") else f"Unnamed: {i}" for i, c in enumerate(header)]

    def rows():
        source = body()
        next(source, None)
        for row in source:
            if any(c not in (None, "") for c in row):
                yield [c if c != "" else None for c in row]

    return columns, rows


# SQLite


def _staged(entry: Entry, folder: str, sidecars: bool) -> str:
    """A copy of a database, with its sidecar files or without."""
    path = Path(folder) / "database"
    with open_entry(entry) as source, path.open("wb") as target:
        shutil.copyfileobj(source, target)
    if sidecars:
        for suffix, side in siblings(entry).items():
            with open_entry(side) as source, open(f"{path}{suffix}", "wb") as target:
                shutil.copyfileobj(source, target)
    return str(path)


def sqlite_tables(entry: Entry) -> list[str]:
    with tempfile.TemporaryDirectory() as folder:
        db = connect(_staged(entry, folder, True), immutable=False)
        try:
            return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        finally:
            db.close()


def _select(selector: Selector) -> str:
    return check_sql(selector.sql) if selector.sql else f"SELECT * FROM {quoted(selector.table)}"


#: When a database on disk is copied before it is read: always, never, or if its preset is of the primary tier.
STAGING = ("always", "never", "tier")


def copied(staging: str, tier: str | None) -> bool:
    if staging not in STAGING:
        raise ValueError(f"staging {staging!r}: expected one of {', '.join(STAGING)}")
    return staging == "always" or staging == "tier" and tier == "primary"


def _sqlite_table(entry: Entry, selector: Selector, sidecars: bool, copy: bool = True) -> tuple[list[str], Callable[[], Iterator[list]]]:
    in_place = not copy and not entry.chain and not sidecars  # a log is only read with a copy: reading it writes beside it

    def run(limit: int | None):
        with tempfile.TemporaryDirectory() as folder:
            db = connect(entry.disk_path if in_place else _staged(entry, folder, sidecars), immutable=not sidecars)
            try:
                if selector.table and not db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (selector.table,)).fetchone():
                    raise ValueError(f"{entry.logical_path} has no table {selector.table!r}")
                if selector.sql:
                    db.execute("PRAGMA full_column_names = 1")
                    db.execute("PRAGMA short_column_names = 0")
                cursor = db.execute(_select(selector))
                yield [d[0] for d in cursor.description]
                for n, row in enumerate(cursor):
                    if limit is not None and n >= limit:
                        return
                    yield [_text(v) for v in row]
            except sqlite3.DatabaseError as wrong:
                raise ValueError(f"{entry.logical_path}: {wrong}") from wrong
            finally:
                db.close()

    def rows():
        source = run(None)
        next(source)
        yield from source

    return next(run(0)), rows


# Nested XML reports

_DIALECTS: dict[str, Callable] = {}


def register_dialect(namespace: str):
    """Register `fn(entry, model) -> (columns, rows)` for reports of a namespace."""

    def add(fn):
        _DIALECTS[namespace] = fn
        return fn

    return add


def namespace_of(entry: Entry) -> str | None:
    found = re.search(rb"""xmlns=["']([^"']+)["']""", read_bytes(entry, 65536))
    return found[1].decode() if found else None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _events(entry: Entry) -> Iterator[tuple[str, ET.Element]]:
    """Start and end events of a document, read in pieces; control characters are dropped."""
    parser = ET.XMLPullParser(["start", "end"])
    bad = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    with open_entry(entry) as stream:
        while piece := stream.read(1 << 20):
            parser.feed(bad.sub(b"", piece))
            yield from parser.read_events()


def report_models(entry: Entry, wanted: str | None = None) -> Iterator[ET.Element]:
    """Top-level models of a report as they end, each freed after use; of one type, only its blocks are parsed."""
    head, blocks, _ = block_index(entry)
    if wanted is None or not blocks:
        yield from _top_models(_events(entry), wanted)
        return
    for kind, first, end in blocks:
        if kind is None or kind == wanted:
            yield from _top_models(_stretch_events(entry, head, first, end), wanted)


def model_fields(model: ET.Element) -> dict[str, str]:
    """A model's own fields; a time's format under its name and .format."""
    out = {}
    for f in model:
        if _local(f.tag) == "field":
            value = next((v for v in f if _local(v.tag) == "value"), None)
            text = "".join(value.itertext()).strip() if value is not None else ""
            out[f.get("name")] = text or None
            if value is not None and value.get("format"):
                out[f"{f.get('name')}.format"] = value.get("format")
    return out


def _inline(model: ET.Element, prefix: str = "") -> dict[str, str]:
    out = {prefix + k: v for k, v in model_fields(model).items()}
    for f in model:
        if _local(f.tag) == "modelField":
            for inner in f:
                if _local(inner.tag) == "model":
                    out |= _inline(inner, f"{prefix}{f.get('name') or inner.get('type')}.")
    return out


#: Columns of the place where a model was found, as the reader of reports adds them.
SOURCE_COLUMNS = {"source_path": "path", "source_name": "name", "source_table": "table_name", "source_offset": "offset"}


_MARK = re.compile(rb"<!\[CDATA\[|<!--|<modelType(?=[\s>])|</modelType\s*>|<extraInfos(?=[\s>/])")


def block_index(entry: Entry) -> tuple[bytes, list[tuple[str | None, int, int]], int | None]:
    """(the root's start tag, blocks of models as (type, first byte, end), first byte of the sources), by one scan for marks.

    Nothing is parsed; marks within CDATA and comments do not count.
    """
    head, blocks, sources = b"", [], None
    kept, base, until, start, kind = b"", 0, None, None, None
    with open_entry(entry) as stream:
        while True:
            piece = stream.read(1 << 20)
            kept += piece
            at = 0
            if not head and (root := re.search(rb"<[A-Za-z_][^>]*>", kept)):
                head = root[0]
            while True:
                if until:
                    end = kept.find(until, at)
                    if end < 0:
                        at = max(at, len(kept) - 8)
                        break
                    at, until = end + len(until), None
                    continue
                mark = _MARK.search(kept, at)
                if not mark:
                    at = max(at, len(kept) - 32)
                    break
                word = mark[0]
                if word.startswith(b"<!"):
                    at, until = mark.end(), b"]]>" if word == b"<![CDATA[" else b"-->"
                    continue
                if word == b"<modelType":
                    close = kept.find(b">", mark.end())
                    if close < 0:
                        at = mark.start()
                        break
                    name = re.search(rb"""\stype\s*=\s*["']([^"']*)["']""", kept[mark.end() : close])
                    start, kind, at = base + mark.start(), name[1].decode() if name else None, close + 1
                    if kept[close - 1 : close] == b"/":
                        start = None
                    continue
                if word.startswith(b"</modelType") and start is not None:
                    blocks.append((kind, start, base + mark.end()))
                    start = None
                elif word == b"<extraInfos" and sources is None:
                    sources = base + mark.start()
                at = mark.end()
            kept, base = kept[at:], base + at
            if not piece:
                return head, blocks, sources


def _stretch_events(entry: Entry, head: bytes, first: int, end: int | None) -> Iterator[tuple[str, ET.Element]]:
    """Events of a stretch of a document, under its root; what lies before it is passed over, not parsed."""
    parser = ET.XMLPullParser(["start", "end"])
    bad = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    parser.feed(head)
    with open_entry(entry) as stream:
        stream.seek(first)
        left = None if end is None else end - first
        while left is None or left > 0:
            piece = stream.read(1 << 20 if left is None else min(1 << 20, left))
            if not piece:
                break
            left = None if left is None else left - len(piece)
            parser.feed(bad.sub(b"", piece))
            yield from parser.read_events()


def _top_models(events: Iterator[tuple[str, ET.Element]], wanted: str | None) -> Iterator[ET.Element]:
    path: list[ET.Element] = []
    for event, node in events:
        if event == "start":
            path.append(node)
            continue
        path.pop()
        if _local(node.tag) == "model" and not any(_local(p.tag) == "model" for p in path):
            if wanted is None or node.get("type") == wanted:
                yield node
            node.clear()
            if path:
                path[-1].remove(node)


def block_models(entry: Entry, head: bytes, first: int, end: int | None) -> Iterator[ET.Element]:
    """Top-level models of one block."""
    return _top_models(_stretch_events(entry, head, first, end), None)


def source_entries(entry: Entry) -> Iterator[tuple[str, str | None, str | None, str | None, str | None, str | None]]:
    """(model id, path, name, table, offset, size): where each model was found, in document order; the models before are not parsed."""
    head, _, first = block_index(entry)
    for event, node in _events(entry) if first is None else _tolerant(_stretch_events(entry, head, first, None)):
        if event == "end" and _local(node.tag) == "extraInfo":
            info = next((n for n in node.iter() if _local(n.tag) == "nodeInfo"), None)
            if info is not None:
                yield (node.get("id"), *(info.get(k) for k in ("path", "name", "tableName", "offset", "size")))
            node.clear()


def _tolerant(events: Iterator) -> Iterator:
    """Events up to the end of the document, whose last tags close what the stretch did not open."""
    try:
        yield from events
    except ET.ParseError:
        return


def inline_report(entry: Entry, model: str) -> tuple[list[str], Callable[[], Iterator[list]]]:
    """One row per top-level model of a type: single submodels inline as Parent.Field, lists of submodels left out."""
    columns: dict[str, None] = {"uuid": None, "deleted_state": None, "decoding_confidence": None}
    for node in report_models(entry, model):
        columns |= dict.fromkeys(_inline(node))

    def rows():
        for node in report_models(entry, model):
            values = {"uuid": node.get("id"), "deleted_state": node.get("deleted_state"), "decoding_confidence": node.get("decoding_confidence")} | _inline(node)
            yield [values.get(c) for c in columns]

    return list(columns), rows


# Fixed value: the name space of the nested report format.
register_dialect("http://pa.cellebrite.com/report/2.0")(inline_report)


def _xml_table(entry: Entry, selector: Selector) -> tuple[list[str], Callable[[], Iterator[list]]]:
    namespace = namespace_of(entry)
    if namespace not in _DIALECTS:
        raise ValueError(f"{entry.logical_path}: no dialect for reports of {namespace}")
    columns, rows = _DIALECTS[namespace](entry, selector.model)
    if _DIALECTS[namespace] is inline_report:  # its sources are joined by read_table
        columns = [*columns, *(c for c in SOURCE_COLUMNS if c not in columns)]
    return columns, rows


# The data source

_FORMATS: dict[str, Callable] = {"csv": _csv_table, "excel": _excel_table, "xml": _xml_table}


def register_reader(kind: str):
    """Register `fn(entry, selector) -> (columns, rows)` for a format."""

    def add(fn):
        _FORMATS[kind] = fn
        return fn

    return add


def table_of(entry: Entry, selector: Selector, sidecars: bool = False, copy: bool = True) -> tuple[list[str], Callable[[], Iterator[list]]]:
    if selector.format == "sqlite":
        return _sqlite_table(entry, selector, sidecars, copy)
    if selector.format not in _FORMATS:
        raise PresetError(f"no reader for {selector.format}")
    return _FORMATS[selector.format](entry, selector)


def peek_columns(entry: Entry, selector: Selector) -> list[str] | None:
    """A unit's columns; None where they cannot be told without running a query, or at all."""
    if selector.sql:
        return None
    try:
        return table_of(entry, selector, sidecars=True)[0]
    except (ValueError, OSError, KeyError, ET.ParseError, zipfile.BadZipFile):
        return None


class _Part(InputPartition):
    def __init__(self, entry: Entry, selector: Selector):
        self.entry, self.selector = entry, selector


class FileTables(DataSource):
    """Format `tessera`: the same unit of one or more files, a partition for each."""

    @classmethod
    def name(cls):
        return "tessera"

    def schema(self):
        raise PresetError("read files through read_table")

    def reader(self, schema):
        return _FileReader(self.options, schema)


class _FileReader(DataSourceReader):
    def __init__(self, options, schema):
        import base64
        import pickle

        self.entries, self.selector, self.sidecars, self.copy, formats, dialects = pickle.loads(base64.b64decode(options["plan"]))  # noqa: S301  made by read_table
        _FORMATS.update(formats)
        _DIALECTS.update(dialects)
        self.formats, self.dialects = formats, dialects
        self.columns = [f.name for f in schema.fields[2:]]

    def partitions(self):
        return [_Part(e, self.selector) for e in self.entries]

    def read(self, partition):
        _FORMATS.update(self.formats)
        _DIALECTS.update(self.dialects)
        names, rows = table_of(partition.entry, partition.selector, self.sidecars, self.copy)
        names = unique_names(names)
        at = [names.index(c) if c in names else None for c in self.columns]
        for line, row in enumerate(rows(), 1):
            yield (partition.entry.logical_path, line, *[None if i is None or i >= len(row) else row[i] for i in at])


def unique_names(names: list[str]) -> list[str]:
    """Names with repeats numbered: a, a.1, a.2; names that differ in case alone are repeats."""
    out: list[str] = []
    for n in names:
        name, i = n, 0
        while name.lower() in (o.lower() for o in out):
            i += 1
            name = f"{n}.{i}"
        out.append(name)
    return out


def _own(registered: dict[str, Callable]) -> dict[str, Callable]:
    """What callers have registered; it goes to executors with the plan."""
    return {k: f for k, f in registered.items() if f.__module__ != __name__}


def _scan(spark: SparkSession, entries: list[Entry], selector: Selector, columns: list[str], sidecars: bool, copy: bool = True) -> DataFrame:
    import base64

    from pyspark import cloudpickle as pickle

    spark.dataSource.register(FileTables)
    schema = T.StructType([T.StructField("_file", T.StringType()), T.StructField(LINE, T.LongType()), *[T.StructField(c, T.StringType()) for c in columns]])
    plan = base64.b64encode(pickle.dumps((entries, selector, sidecars, copy, _own(_FORMATS), _own(_DIALECTS)))).decode()
    return spark.read.format("tessera").schema(schema).option("plan", plan).load()


class ReportSources(DataSource):
    """Format `tessera_sources`: where a report's models were found, in document order, read by an executor."""

    @classmethod
    def name(cls):
        return "tessera_sources"

    def schema(self):
        return "seq long, id string, path string, name string, table_name string, offset string, size string"

    def reader(self, schema):
        return _SourcesReader(self.options)


class _SourcesReader(DataSourceReader):
    def __init__(self, options):
        import base64
        import pickle

        self.entry = pickle.loads(base64.b64decode(options["plan"]))  # noqa: S301  made by read_sources

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for i, row in enumerate(source_entries(self.entry)):
            yield (i, *row)


def read_sources(spark: SparkSession, entry: Entry) -> DataFrame:
    import base64
    import pickle

    spark.dataSource.register(ReportSources)
    return spark.read.format("tessera_sources").option("plan", base64.b64encode(pickle.dumps(entry)).decode()).load()


def read_table(spark: SparkSession, entry: Entry, selector: Selector, staging: str = "always", tier: str | None = None) -> DataFrame:
    """One unit of one file: `_line`, the columns as text, and `_recovery` (live, wal, journal; null for other formats).

    A database is read without and with its sidecar files; equal rows are one. Models of a
    report get the columns of the first place where they were found.
    """
    columns = unique_names(table_of(entry, selector, sidecars=True)[0])
    if selector.format == "xml" and _DIALECTS.get(namespace_of(entry)) is inline_report:
        own = [c for c in columns if c not in SOURCE_COLUMNS]
        rows = _scan(spark, [entry], selector, own, False).drop("_file")
        found = read_sources(spark, entry).select("seq", "id", *[F.col(c).alias(n) for n, c in SOURCE_COLUMNS.items()])
        return with_source(rows, found, "uuid", "id", ["seq"], [n for n in SOURCE_COLUMNS if n in columns]).withColumn("_recovery", F.lit(None).cast("string"))
    if selector.format != "sqlite":
        return _scan(spark, [entry], selector, columns, False).drop("_file").withColumn("_recovery", F.lit(None).cast("string"))
    database = _scan(spark, [entry], selector, columns, False, copied(staging, tier))
    side = siblings(entry)
    label = "wal" if "-wal" in side else "journal" if "-journal" in side else "wal"
    whole = _scan(spark, [entry], selector, columns, True) if side else database
    merged = recovery_state(merge_views(database, whole, columns, label))
    from pyspark.sql import Window

    ordered = merged.withColumn(LINE, F.row_number().over(Window.orderBy("position")).cast("long"))
    return ordered.select(LINE, *cols(columns), F.col("recovery").alias("_recovery"))


def check_kind(entry: Entry, selector: Selector) -> None:
    kind = detect(entry)
    if kind != selector.format:
        raise PresetError(f"{entry.logical_path} is {kind or 'of an unknown format'}, not {selector.format}")
