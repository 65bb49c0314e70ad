"""Spectra of pixels as vectors: sums of many scans place by place, and medians along image rows, without a row for each channel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of sums that a task holds before it hands them on.
HELD = 1 << 23


def as_vectors(scans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, c, at array<int>, v array<double>: the channels of each pixel that have a value, and the values. scans have a row for
    each channel (channel, value), or an array of a pixel's channels (spectrum), which stays as it is: at is null."""
    if "spectrum" in scans.columns:
        return scans.select(*keys, "r", "c", F.lit(None).cast("array<int>").alias("at"), F.col("spectrum").cast("array<double>").alias("v"))
    cells = scans.select(*keys, "r", "c", F.struct(F.col("channel").cast("int").alias("at"), F.col("value").cast("double").alias("v")).alias("x"))
    return cells.groupBy(*keys, "r", "c").agg(F.array_sort(F.collect_list("x")).alias("x")).select(*keys, "r", "c", F.col("x.at").alias("at"), F.col("x.v").alias("v"))


def as_cells(vectors: DataFrame, keys: list[str], kind: str = "bigint") -> DataFrame:
    """keys, r, c, channel, value of vectors without at, channels without a value left out."""
    return vectors.select(*keys, "r", "c", F.posexplode("v").alias("channel", "value")).where("value IS NOT NULL").select(*keys, "r", "c", "channel", F.col("value").cast(kind).alias("value"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's vectors, one a row, NaN where there is no value."""
    v, at = batch.column("v"), batch.column("at")
    flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    size = np.diff(ends)
    flat = flat[ends[0] : ends[-1]]
    row = np.repeat(np.arange(len(size)), size)
    if at.null_count < len(at):
        column = at.values.to_numpy(zero_copy_only=False)[at.offsets[0].as_py() : at.offsets[len(at)].as_py()]
    else:
        column = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)
    out = np.full((len(size), int(column.max()) + 1 if len(column) else 0), np.nan)
    out[row, column] = flat
    return out


def lists(values: np.ndarray) -> pa.ListArray:
    """A list for each row, null where NaN."""
    flat = np.ascontiguousarray(values).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(flat, mask=np.isnan(flat)))


class Sums:
    """Element-wise sums of vectors by key."""

    def __init__(self):
        self.places, self.total, self.seen = {}, np.zeros((0, 0)), np.zeros((0, 0), bool)

    def add(self, keys: list[tuple], x: np.ndarray) -> None:
        where = np.fromiter((self.places.setdefault(k, len(self.places)) for k in keys), np.int64, len(keys))
        rows, width = len(self.places), max(x.shape[1], self.total.shape[1])
        if rows > len(self.total) or width > self.total.shape[1]:
            grow = ((0, max(rows, 2 * len(self.total)) - len(self.total) if rows > len(self.total) else 0), (0, width - self.total.shape[1]))
            self.total, self.seen = np.pad(self.total, grow), np.pad(self.seen, grow)
        order = np.argsort(where, kind="stable")
        first = np.flatnonzero(np.diff(where[order], prepend=-1))
        there, x = ~np.isnan(x), np.nan_to_num(x)
        into = where[order][first]
        self.total[into, : x.shape[1]] += np.add.reduceat(x[order], first, axis=0)
        self.seen[into, : x.shape[1]] |= np.logical_or.reduceat(there[order], first, axis=0)

    def take(self) -> tuple[list[tuple], np.ndarray]:
        """The keys and their sums, NaN where nothing was added."""
        n = len(self.places)
        return list(self.places), np.where(self.seen[:n], self.total[:n], np.nan)


def _summing(keys: list[str], ordered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, types = Sums(), None

        def given(found: list[tuple], values: np.ndarray) -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 20) // max(1, values.shape[1]))
            for k in range(0, len(found), step):
                own = found[k : k + step]
                columns = [pa.array([x[i] for x in own], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(own), pa.list_(pa.int32())), lists(values[k : k + step])], names=[*keys, "at", "v"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for b in (batch.slice(k, 1024) for k in range(0, len(batch), 1024)):
                sums.add(list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)), matrix(b))
                if sums.total.size > HELD:
                    found, values = sums.take()
                    sums = Sums()
                    if ordered:  # the last key may go on
                        sums.add(found[-1:], values[-1:])
                        found, values = found[:-1], values[:-1]
                    yield from given(found, values)
        if sums.places:
            yield from given(*sums.take())

    return run


def summed(vectors: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c, at (null), v: element-wise sums of as_vectors over scans. Tasks add up what they have of a place first, then
    one vector of each place and task travels, and those of a place are added up in the order of the places."""
    keys = [*by, "r", "c"]
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "at array<int>, v array<double>"])
    parts = vectors.select(*keys, "at", "v").mapInArrow(_summing(keys, False), schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_summing(keys, True), schema)


def summed_arrays(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """keys and v: element-wise sums of arrays (keys, v) that are sums of tasks already: one array of each travels."""
    types = {f.name: f.dataType.simpleString() for f in arrays.schema.fields}
    rows = arrays.select(*keys, F.lit(None).cast("array<int>").alias("at"), "v").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_summing(keys, True), ", ".join([*(f"{k} {types[k]}" for k in keys), "at array<int>, v array<double>"])).drop("at")


def _row_sums(flatten: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, scan, block, sums = None, None, [], {}

        def close() -> None:
            """The scan's row is whole: its medians go, the rest is added to the night's."""
            if not block:
                return
            width = max(len(v) for _, v in block)
            x = np.stack([np.pad(v, (0, width - len(v)), constant_values=np.nan) for _, v in block])
            if flatten:
                some = ~np.isnan(x).all(0)
                x[:, some] -= np.nanmedian(x[:, some], axis=0)
            for (c, _), v in zip(block, x, strict=True):
                total = sums.get(c, np.full(0, np.nan))
                n = max(len(total), len(v))
                total, v = (np.pad(a, (0, n - len(a)), constant_values=np.nan) for a in (total, v))
                sums[c] = np.where(np.isnan(total), v, np.where(np.isnan(v), total, total + v))
            block.clear()

        def given() -> Iterator[pa.RecordBatch]:
            if sums:
                cs, width = sorted(sums), max(map(len, sums.values()))
                values = np.stack([np.pad(sums[c], (0, width - len(sums[c])), constant_values=np.nan) for c in cs])
                yield pa.RecordBatch.from_arrays([pa.array([line[0]] * len(cs), pa.string()), pa.array([line[1]] * len(cs), pa.int32()), pa.array(cs, pa.int32()), lists(values)], names=["night", "r", "c", "v"])

        for batch in batches:
            for b in (batch.slice(k, 1024) for k in range(0, len(batch), 1024)):
                for night, r, s, c, v in zip(*(b.column(k).to_pylist() for k in ("night", "r", "scan_id", "c")), matrix(b), strict=True):
                    if (line, scan) != ((night, r), s):
                        close()
                    if line != (night, r):
                        yield from given()
                        line, sums = (night, r), {}
                    scan = s
                    block.append((c, v))
        close()
        yield from given()

    return run


def flattened_sums(vectors: DataFrame, flatten: bool = True) -> DataFrame:
    """(night, r, c, v) from as_vectors with night and scan_id: nightly sums of each scan's vectors less, if flatten, the median along
    the scan's row of each channel. One row of a night's scans is in a task at a time, one scan's row of it whole."""
    rows = vectors.select(F.col("night").cast("string").alias("night"), F.col("r").cast("int").alias("r"), "scan_id", F.col("c").cast("int").alias("c"), "at", "v")
    return rows.repartition("night", "r").sortWithinPartitions("night", "r", "scan_id", "c").mapInArrow(_row_sums(flatten), "night string, r int, c int, v array<double>")
