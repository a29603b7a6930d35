"""Binary files in the shared folder, written and read by executors."""

from __future__ import annotations

from functools import lru_cache

from pyarrow import fs


@lru_cache(maxsize=64)
def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there; a path without a scheme is local to all."""
    return _filesystem(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def create(folder: str, name: str):
    """A new file to write to; the folder is made if need be."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None)


def reader(folder: str, name: str):
    """A file open for random access; memory-mapped where the file system is a mounted one."""
    system, path = place(folder)
    if isinstance(system, fs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(f"{path}/{name}")
    return system.open_input_file(f"{path}/{name}")


def size(folder: str, name: str) -> int:
    system, path = place(folder)
    return system.get_file_info(f"{path}/{name}").size
