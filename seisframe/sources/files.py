"""Random access to one file on a file system that driver and executors share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow.fs as arrow_fs

from .. import codec, spec


def filesystem(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return arrow_fs.FileSystem.from_uri(uri)
    return arrow_fs.LocalFileSystem(), uri


def local_path(uri: str) -> str:
    """The path of a file that is written in place, which only POSIX file systems allow."""
    system, path = filesystem(uri)
    if not isinstance(system, arrow_fs.LocalFileSystem):
        raise ValueError(f"{uri}: files are written in place, on a shared POSIX path")
    return path


def read_at(uri: str, at: int, n: int) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        return f.read_at(n, at)


def file_size(uri: str) -> int:
    system, path = filesystem(uri)
    info = system.get_file_info(path)
    if info.type != arrow_fs.FileType.File:
        raise FileNotFoundError(uri)
    return info.size


@dataclass(frozen=True)
class FileInfo:
    """What the preamble and the size of a SEG-Y file say."""

    path: str
    nt: int
    dt: int
    format: int
    trace_count: int
    sorting: int

    @property
    def esize(self) -> int:
        return codec.element_size(self.format)

    @property
    def record(self) -> int:
        return spec.TRACE_BYTES + self.nt * self.esize


def open_info(uri: str) -> FileInfo:
    """Parse the binary header; a ragged tail is no trace."""
    size = file_size(uri)
    if size < spec.PREAMBLE:
        raise ValueError(f"{uri} is too short for a SEG-Y file")
    head = np.frombuffer(read_at(uri, spec.TEXT_BYTES, spec.BINARY_BYTES), dtype=np.uint8)[None]
    code = int(codec.field(head, 25, 2)[0])
    nt = int(codec.field(head, 21, 2)[0]) & 0xFFFF
    sorting = int(codec.field(head, 29, 2)[0])
    record = spec.TRACE_BYTES + nt * codec.element_size(code)
    return FileInfo(uri, nt, int(codec.field(head, 17, 2)[0]), code, (size - spec.PREAMBLE) // record, sorting if sorting in spec.SORTINGS else 0)
