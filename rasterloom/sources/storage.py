"""Files by URI, from tasks and from the driver: local paths and the stores that pyarrow reaches, read in ranges."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyarrow import fs

# Schemes that name the same store under another name.
ALIASES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a local path."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", uri)
    if m is None:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if m[1] == "file":
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(ALIASES.get(m[1], m[1]) + uri[len(m[1]) :])


def reaches(uri: str) -> bool:
    """Whether Python can get at a URI by itself; else only Spark's readers may."""
    try:
        place(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False
    return True


def open_input(uri: str) -> pa.NativeFile:
    """A file to read from any position, in ranges."""
    store, path = place(uri)
    return store.open_input_file(path)


def make_folder(uri: str) -> None:
    store, path = place(uri)
    store.create_dir(path, recursive=True)


def write(uri: str, data: bytes) -> None:
    """A small file, whole or not at all, in folders that are made where they miss; a second time gives the same file."""
    store, path = place(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    if not isinstance(store, fs.LocalFileSystem):  # stores show a file when it is closed
        with store.open_output_stream(path) as f:
            f.write(data)
        return
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def local(uri: str) -> str | None:
    """The local path of a URI, if it has one."""
    store, path = place(uri)
    return path if isinstance(store, fs.LocalFileSystem) else None
