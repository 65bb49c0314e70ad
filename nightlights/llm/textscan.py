"""Vectorised scanning of many texts at once: words, lines and rolling hashes over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: ASCII white space: \x20 and \x09-\x0D. In UTF-8 these bytes occur in no other character.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and all bytes from 0x80.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
#: BASE's inverse modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK = 1 << 19
#: Rows of an Arrow batch whose texts are taken out at a time.
ROWS = 512


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts' bytes) from Arrow batches, in blocks of about limit bytes: memory follows the block and the longest text."""
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        data, first, size = encoded(batch.column(column)), 0, 0
        for i, x in enumerate(data):
            if size and size + len(x) > limit:
                yield batch.slice(first, i - first), data[first:i]
                first, size = i, 0
            size += len(x) + 1
        if first < len(data):
            yield batch.slice(first), data[first:]


def record(**columns) -> pa.RecordBatch:
    """A batch of the named columns, in the order given."""
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(BLOCK * 2, 1 << (n - 1).bit_length()))


@lru_cache(1)
def symbol_codes() -> np.ndarray:
    """A 64-bit code for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: spreads each bit of h over all bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over codes; span() turns two of them into a position-free hash."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
        return out


def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each pair; equal sequences get equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def joined(data: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer with a line feed after each, and each text's first byte (one more entry: the end)."""
    whole = b"\n".join(data) + b"\n"
    if lower:
        whole = whole.lower()
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in data], out=starts[1:])
    return np.frombuffer(whole, np.uint8), starts


def words(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each maximal run of bytes for which inside holds."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def repeated(h: np.ndarray) -> np.ndarray:
    """Whether each hash occurs twice or more."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(h), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.searchsorted(twice, h)
    return twice[np.minimum(at, len(twice) - 1)] == h


def covered(starts: np.ndarray, length, n: int) -> np.ndarray:
    """Which of n places lie in a window [start, start + length)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:n]) > 0
