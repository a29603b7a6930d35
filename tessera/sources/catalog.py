"""What lies where: folders and archives as one name space of logical paths.

Cataloguing reads names and first bytes only and runs on the driver; contents are read
by executors through the sources of this package.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

#: Limits: nested archives that are opened in memory, and entries that look like bombs.
NESTED_BYTES = 512 << 20
BOMB_BYTES, BOMB_RATIO = 64 << 20, 200
_CHUNK = 1 << 20
SIDECARS = ("-wal", "-shm", "-journal")


class ZipBomb(ValueError):
    """An archive entry that expands beyond reason."""


def clean(path: str) -> str:
    return "/".join(s for s in path.replace("\\", "/").split("/") if s)


@dataclass(frozen=True)
class Entry:
    """A file on disk, or one within archives: `chain` names the entries from the outermost archive inwards."""

    disk_path: str
    logical_path: str
    chain: tuple[str, ...] = ()
    size: int = 0

    @property
    def name(self) -> str:
        return self.logical_path.rpartition("/")[2]


@dataclass
class Catalog:
    root: str
    entries: list[Entry] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def __iter__(self) -> Iterator[Entry]:
        return iter(self.entries)


def check_bomb(info: zipfile.ZipInfo) -> None:
    if info.file_size > BOMB_BYTES and info.file_size > BOMB_RATIO * max(info.compress_size, 1):
        raise ZipBomb(f"{info.filename}: {info.file_size} bytes from {info.compress_size}")


def _open_chain(disk_path: str, chain: tuple[str, ...]) -> zipfile.ZipFile:
    """The innermost archive of a chain of nested ones."""
    archive = zipfile.ZipFile(disk_path)
    for name in chain:
        info = archive.getinfo(name)
        check_bomb(info)
        if info.file_size > NESTED_BYTES:
            raise ValueError(f"{name}: a nested archive of {info.file_size} bytes is not opened")
        archive = zipfile.ZipFile(io.BytesIO(archive.read(info)))
    return archive


def open_entry(entry: Entry):
    """A binary stream of the entry's content."""
    if not entry.chain:
        return open(entry.disk_path, "rb")
    archive = _open_chain(entry.disk_path, entry.chain[:-1])
    info = archive.getinfo(entry.chain[-1])
    check_bomb(info)
    return archive.open(info)


def read_bytes(entry: Entry, limit: int | None = None) -> bytes:
    with open_entry(entry) as stream:
        return stream.read() if limit is None else stream.read(limit)


def fingerprint(entry: Entry) -> str:
    """SHA-256 of the content, read in pieces."""
    digest = hashlib.sha256()
    with open_entry(entry) as stream:
        while piece := stream.read(_CHUNK):
            digest.update(piece)
    return digest.hexdigest()


def _is_archive(head: bytes, read_names) -> bool:
    if not head.startswith(b"PK\x03\x04"):
        return False
    try:
        return "xl/workbook.xml" not in read_names()
    except zipfile.BadZipFile:
        return True


def discover(root: str | Path, depth: int | None = None) -> Catalog:
    """Files below a folder, or in an archive, or one file; nested archives are opened down to `depth`.

    By default a folder's archives stay closed and an archive's own entries are listed
    (depth 0 and 1). Sidecar files of databases are left out: they are read with their
    database. A broken archive is an opaque file and a warning.
    """
    root = Path(root)
    if not root.exists():
        raise FileNotFoundError(root)
    out = Catalog(str(root))
    deepest = depth if depth is not None else (0 if root.is_dir() else 1)
    files = sorted(p for p in root.rglob("*") if p.is_file()) if root.is_dir() else [root]
    for p in files:
        logical = clean(str(p.relative_to(root))) if root.is_dir() else p.name
        if logical.endswith(SIDECARS):
            continue
        entry = Entry(str(p), logical, (), p.stat().st_size)
        with p.open("rb") as stream:
            head = stream.read(4)
        if deepest > 0 and _is_archive(head, lambda p=p: zipfile.ZipFile(p).namelist()):
            prefix = f"{logical}/" if root.is_dir() else ""
            _walk_archive(out, entry, prefix, 1, deepest)
        else:
            out.entries.append(entry)
    return out


def _walk_archive(out: Catalog, archive: Entry, prefix: str, level: int, deepest: int) -> None:
    try:
        with _open_chain(archive.disk_path, archive.chain) as z:
            inner = []
            for info in sorted(z.infolist(), key=lambda i: clean(i.filename)):
                if info.is_dir() or clean(info.filename).endswith(SIDECARS):
                    continue
                entry = Entry(archive.disk_path, prefix + clean(info.filename), (*archive.chain, info.filename), info.file_size)
                with z.open(info) as stream:
                    head = stream.read(4)
                nested = level < deepest and head.startswith(b"PK\x03\x04") and info.file_size <= NESTED_BYTES
                inner.append((entry, nested and _is_archive(head, lambda z=z, info=info: zipfile.ZipFile(io.BytesIO(z.read(info))).namelist())))
    except (zipfile.BadZipFile, ValueError, NotImplementedError, RuntimeError) as wrong:
        out.warnings.append(f"{archive.logical_path}: cannot be opened as an archive: {wrong}")
        out.entries.append(archive)
        return
    for entry, nested in inner:
        if nested:
            _walk_archive(out, entry, f"{entry.logical_path}/", level + 1, deepest)
        else:
            out.entries.append(entry)


def detect(entry: Entry) -> str | None:
    """sqlite, plist, excel, archive, xml by content; csv by suffix alone; else None."""
    head = read_bytes(entry, 4096)
    if head.startswith(b"SQLite format 3\0"):
        return "sqlite"
    if head.startswith(b"bplist00"):
        return "plist"
    if head.startswith(b"PK\x03\x04"):
        try:
            with open_entry(entry) as stream:  # its directory only
                names = zipfile.ZipFile(stream).namelist()
        except zipfile.BadZipFile:
            return "archive"
        return "excel" if "xl/workbook.xml" in names else "archive"
    text = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    if text.startswith(b"<?xml") or (text.startswith(b"<") and b"xmlns" in text):
        return "plist" if b"<!DOCTYPE plist" in text else "xml"
    return "csv" if entry.name.lower().endswith((".csv", ".tsv")) else None


def siblings(entry: Entry) -> dict[str, Entry]:
    """A database's sidecar files, by suffix."""
    out = {}
    for suffix in SIDECARS:
        if not entry.chain:
            p = Path(entry.disk_path + suffix)
            if p.exists():
                out[suffix] = Entry(str(p), entry.logical_path + suffix, (), p.stat().st_size)
        else:
            with _open_chain(entry.disk_path, entry.chain[:-1]) as z:
                name = entry.chain[-1] + suffix
                if name in z.namelist():
                    out[suffix] = Entry(entry.disk_path, entry.logical_path + suffix, (*entry.chain[:-1], name), z.getinfo(name).file_size)
    return out


class Integrity:
    """Hashes of the files that a run reads, before and after it."""

    def __init__(self, entries: list[Entry]):
        self.entries = [e for e in dict.fromkeys(entries)]
        self.before = {e.logical_path: fingerprint(e) for e in self.entries}

    def verify(self) -> dict[str, dict[str, str | bool]]:
        """Both hashes of each file and whether they agree."""
        out = {}
        for e in self.entries:
            after = fingerprint(e)
            out[e.logical_path] = {"before": self.before[e.logical_path], "after": after, "unchanged": after == self.before[e.logical_path]}
        return out


def archive_fingerprint(path: str | Path, names: list[str]) -> dict[str, str]:
    """Hashes of an archive's table of contents and of the entries that are read, whatever its size."""
    with zipfile.ZipFile(path) as z:
        table = hashlib.sha256()
        for i in sorted(z.infolist(), key=lambda i: i.filename):
            table.update(f"{i.filename}\0{i.file_size}\0{i.CRC:08x}\0{i.header_offset}\n".encode())
        out = {"table": table.hexdigest(), "size": str(Path(path).stat().st_size)}
        for name in names:
            with z.open(name) as stream:
                out[f"entry:{name}"] = hashlib.file_digest(stream, "sha256").hexdigest()
    return out
