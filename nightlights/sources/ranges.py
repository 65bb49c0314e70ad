"""Byte ranges of files, read where the rows that name them lie: contents never move, and a file of any size is taken in pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a task is given to read, and that it holds at once.
SHARE, PIECE = 128 << 20, 32 << 20
#: Names by which Spark knows stores that have another name here.
_STORES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest if scheme == "file" else path)
    return fs.FileSystem.from_uri(f"{_STORES.get(scheme, scheme)}:{rest}")


def reachable(path: str) -> bool:
    """Whether tasks can open files of the path's store themselves; some stores only Spark's readers reach."""
    try:
        _place(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


@contextmanager
def opened(path: str) -> Iterator:
    """read(first byte, bytes) of a file; fewer bytes than asked for are an error."""
    store, name = _place(path)
    with store.open_input_file(name) as f:

        def read(start: int, size: int) -> bytes:
            got = f.read_at(size, start)
            if len(got) < size:
                raise ValueError(f"{path} ends before byte {start + size}")
            return got

        yield read


def spread(items: DataFrame, size: Column) -> DataFrame:
    """items, small rows that name what is to be read, over as many tasks as their bytes ask for."""
    total = items.agg(F.sum(size)).first()[0] or 0
    return items.repartition(max(1, -(-int(total) // SHARE)))
