"""Cubes written as raw scans: one 16-bit file each in the layout that frames.read_scans reads, with a text header beside it.

Tasks write their columns at their places in files of a pending folder; only the commit gives these their names. A task that is
run again writes the same bytes to the same places, and a job that fails leaves nothing behind.
"""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COLUMNS = {"scan": "string", "r": "int", "c": "int", "spectrum": "array<int>"}


@dataclass
class Columns(WriterCommitMessage):
    """The columns of each scan that a task has written."""

    written: dict[str, list[int]] = field(default_factory=dict)


class CubeWriter(DataSourceArrowWriter):
    """Takes pixels in the order of (scan, c), all of a column in one task, and holds one column at a time."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = re.sub("^(file:)?/+", "/", options["path"]).rstrip("/"), overwrite
        self.samples, self.bands, self.lines = int(options["samples"]), int(options["bands"]), int(options.get("lines", 0))
        self.waves = [float(x) for x in options.get("waves", "").split(",") if x]
        self.pending = f"{self.path}/.pending-{uuid4().hex}"

    def _at(self, scan: str) -> str:
        return f"{self.pending}/{scan}.raw"

    def _put(self, scan: str, c: int, block: np.ndarray) -> None:
        os.makedirs(self.pending, exist_ok=True)
        f = os.open(self._at(scan), os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            data, place = memoryview(block.tobytes()), c * block.nbytes
            while data:
                n = os.pwrite(f, data, place)
                data, place = data[n:], place + n
        finally:
            os.close(f)

    def _checked(self, scan: str | None, c: int | None) -> None:
        if not scan or scan.startswith(".") or "/" in scan:
            raise ValueError(f"{scan!r} can't name a file")
        if c is None or c < 0 or (self.lines and c >= self.lines):
            raise ValueError(f"scan {scan} has no column {c}")

    def _fill(self, block: np.ndarray, seen: np.ndarray, key: tuple[str, int], part: pa.RecordBatch) -> None:
        r = part.column("r").fill_null(-1).to_numpy()
        if r.min() < 0 or r.max() >= self.samples:
            raise ValueError(f"column {key[1]} of scan {key[0]} has rows outside 0 to {self.samples - 1}")
        if seen[r].any() or len(np.unique(r)) < len(r):
            raise ValueError(f"column {key[1]} of scan {key[0]} has a pixel twice")
        seen[r] = True
        size = pc.list_value_length(part.column("spectrum")).fill_null(0).to_numpy()
        flat = part.column("spectrum").flatten().fill_null(0).to_numpy()
        if size.max() > self.bands or (len(flat) and (flat.min() < 0 or flat.max() > 65535)):
            raise ValueError(f"column {key[1]} of scan {key[0]} has over {self.bands} channels, or values that 16 bits can't hold")
        channel = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        block[channel, self.samples - 1 - np.repeat(r, size)] = flat

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Columns:
        done, key, block, seen = Columns(), None, None, None

        def close() -> None:
            if key is not None:
                self._put(*key, block)
                done.written.setdefault(key[0], []).append(key[1])

        for batch in iterator:
            keys = list(zip(batch.column("scan").to_pylist(), batch.column("c").to_pylist(), strict=True))
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[a] != key:
                    close()
                    self._checked(*keys[a])
                    key, block, seen = keys[a], np.zeros((self.bands, self.samples), "<u2"), np.zeros(self.samples, bool)
                self._fill(block, seen, key, batch.slice(a, b - a))
        close()
        return done

    def _header(self, scan: str, lines: int) -> None:
        text = [f"samples = {self.samples}", f"lines = {lines}", f"bands = {self.bands}"]
        text += ["Wavelength = {", *(f"{w!r}," for w in self.waves), "}"] if self.waves else []
        with open(f"{self.pending}/{scan}.hdr", "w") as f:
            f.write("\n".join(text) + "\n")

    def commit(self, messages: list[Columns | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        columns: dict[str, list[int]] = {}
        for m in messages:
            for scan, cs in (m.written if m else {}).items():
                columns.setdefault(scan, []).extend(cs)
        for scan, cs in columns.items():
            if len(set(cs)) < len(cs):
                raise ValueError(f"a column of scan {scan} was written by several tasks")
            if not self.overwrite and os.path.exists(f"{self.path}/{scan}.hdr"):
                raise FileExistsError(f"{self.path} has a scan {scan}")
            lines = self.lines or max(cs) + 1
            os.truncate(self._at(scan), lines * self.bands * self.samples * 2)
            self._header(scan, lines)
        for scan in columns:
            if os.path.exists(f"{self.path}/{scan}.hdr"):
                os.remove(f"{self.path}/{scan}.hdr")
            os.replace(self._at(scan), f"{self.path}/{scan}.raw")
            os.replace(f"{self.pending}/{scan}.hdr", f"{self.path}/{scan}.hdr")
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[Columns | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class RawCubes(DataSource):
    """Options: path, samples, bands, lines (as many as there are columns), waves (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "rawcubes"

    def writer(self, schema: StructType, overwrite: bool) -> CubeWriter:
        found = {f.name: f.dataType.simpleString() for f in schema.fields}
        if found != COLUMNS:
            raise ValueError(f"raw cubes have columns {COLUMNS}, not {found}")
        return CubeWriter(dict(self.options), overwrite)


def write_raw_cubes(cubes: DataFrame, path: str, samples: int, bands: int, lines: int | None = None, waves: list[float] | None = None, overwrite: bool = False) -> None:
    """Writes cubes (scan, r, c, spectrum) as <scan>.raw, by column, channel and descending row, and <scan>.hdr, under path.

    Pixels, channels and columns that are missing are 0; a scan ends with its last column, or after lines. Scans that are there
    already are an error, or replaced if overwrite; others stay. Null or impossible names and places, a pixel given twice and
    values beyond 16 bits are errors, and then nothing is written. An image column is a task's least share: rows x channels x 2
    bytes. The folder must be one that all tasks can write at any place of a file: a mounted one, no object store.
    """
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"files in {path} can't be written at a place")
    spark = cubes.sparkSession
    spark.dataSource.register(RawCubes)
    options = {"path": path, "samples": samples, "bands": bands} | ({"lines": lines} if lines else {}) | ({"waves": ",".join(repr(float(w)) for w in waves)} if waves else {})
    rows = cubes.select(*[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()])
    rows.repartition("scan", "c").sortWithinPartitions("scan", "c", "r").write.format("rawcubes").mode("overwrite" if overwrite else "append").options(**options).save()
