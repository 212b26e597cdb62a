"""Files that a data source reads in pieces, wherever they are."""

from __future__ import annotations

from typing import BinaryIO

from pyarrow import fs


def opened(path: str) -> BinaryIO:
    """A file to read and seek in, by a plain path or an address of a store that pyarrow knows (file, hdfs, s3, gs, abfs)."""
    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)
