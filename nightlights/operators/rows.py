"""Image rows as vectors: neighbours of pixels, and correlations of neighbours, in time linear in the pixels."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an image that a task has at a time; the row below them comes along.
BAND = 16


def row_vectors(pixels: DataFrame, image: list[str], frame: list[str], value: str) -> DataFrame:
    """image, band, frame, r, c array<int>, v array<double>: the pixels' rows, dealt by image and band of rows and sorted.

    pixels have (r, c, value), or an array of a whole row's values as value and no c; null values are left out. The first row
    of each band also stands under the band above, whose last row it is below.
    """
    keys = [*image, *frame, "r"]
    if isinstance(pixels.schema[value].dataType, T.ArrayType):
        rows = pixels.select(*keys, F.lit(None).cast("array<int>").alias("c"), F.col(value).cast("array<double>").alias("v"))
    else:
        cells = pixels.where(F.col(value).isNotNull()).select(*keys, F.struct(F.col("c").cast("int").alias("c"), F.col(value).cast("double").alias("v")).alias("x"))
        rows = cells.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x")).select(*keys, F.col("x.c").alias("c"), F.col("x.v").alias("v"))
    band = F.floor(F.col("r") / BAND).cast("int")
    banded = rows.withColumn("_band", F.explode(F.when(F.col("r") % BAND == 0, F.array(band, band - 1)).otherwise(F.array(band))))
    return banded.repartition(*image, "_band").sortWithinPartitions(*image, "_band", *frame, "r")


def _rows(batches: Iterator[pa.RecordBatch], image: list[str], frame: list[str]) -> Iterator[tuple]:
    """(image, band, frame, r, values from column 0 on with NaN where there is none) of each row."""
    for batch in batches:
        keys = [list(zip(*(batch.column(k).to_pylist() for k in names), strict=True)) if names else [()] * len(batch) for names in (image, frame)]
        bands, rs, values = batch.column("_band").to_pylist(), batch.column("r").to_pylist(), batch.column("v")
        flat, ends = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        columns = batch.column("c")
        places = columns.values.to_numpy(zero_copy_only=False) if columns.null_count < len(columns) else None
        for k in range(len(batch)):
            own = flat[ends[k] : ends[k + 1]]
            if places is not None:
                c = places[ends[k] : ends[k + 1]]
                own, given = np.full(c[-1] + 1 if len(c) else 0, np.nan), own
                own[c] = given
            yield keys[0][k], bands[k], keys[1][k], rs[k], own


def neighbours(pixels: DataFrame, keys: list[str], value: str = "lum") -> DataFrame:
    """keys, side ('right' or 'down'), r, c, x and y: each pixel's value with its right and its lower neighbour's; keys name a frame."""
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, before = None, (None, None, None)

        def pairs(key: tuple, side: str, r: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            c = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v] * len(c), t) for v, t in zip(key, arrow, strict=True)), pa.array([side] * len(c), pa.string()), pa.array(np.full(len(c), r, np.int32)), pa.array(c.astype(np.int32)), pa.array(x[c]), pa.array(y[c])],
                names=[*keys, "side", "r", "c", "x", "y"],
            )

        for batch in batches:
            arrow = [batch.schema.field(k).type for k in keys]
            for key, band, _, r, v in _rows([batch], keys, []):
                if r // BAND == band:
                    yield pairs(key, "right", r, v[:-1], v[1:])
                if before[0] == (key, band) and before[1] == r - 1:
                    n = min(len(v), len(before[2]))
                    yield pairs(key, "down", r - 1, before[2][:n], v[:n])
                before = ((key, band), r, v)

    return row_vectors(pixels, keys, [], value).mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "side string, r int, c int, x double, y double"]))


class Moments:
    """Sums over frames for one row and one side: how many pairs, their values, squares and products, by column."""

    def __init__(self):
        self.sums = np.zeros((6, 0))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        n = min(len(x), len(y))
        if n > self.sums.shape[1]:
            self.sums = np.pad(self.sums, ((0, 0), (0, n - self.sums.shape[1])))
        x, y = x[:n], y[:n]
        both = ~(np.isnan(x) | np.isnan(y))
        x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
        for total, now in zip(self.sums[:, :n], (both, x, y, x * x, y * y, x * y), strict=True):
            total += now

    def correlation(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns, pairs, population correlation, 0 unless both variances are over least)."""
        c = np.flatnonzero(self.sums[0])
        n, x, y, xx, yy, xy = self.sums[:, c]
        vx, vy = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
        spread = (vx > least) & (vy > least)
        with np.errstate(invalid="ignore", divide="ignore"):
            return c, n, np.where(spread, (xy / n - x * y / n**2) / np.sqrt(vx * vy), 0.0)


def correlated_rows(pixels: DataFrame, image: list[str], frame: list[str], value: str, least: float = 0.0) -> DataFrame:
    """image, r, side, c array, n array, corr array: over an image's frames, each pixel's correlation with its neighbours'.

    Each task sums whole rows: vectors times themselves shifted, and times the next row. Values are taken relative to the pixel's
    first one, so that what never changes has no variance at all. What a task holds are the sums of one band of rows.
    """
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held, sums, first, before = None, None, {}, {}, (None, None, None)

        def given() -> Iterator[pa.RecordBatch]:
            for (r, side), m in sorted(sums.items()):
                c, n, corr = m.correlation(least)
                lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((c, pa.int32()), (n.astype(np.int64), pa.int64()), (corr, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(held[0], arrow, strict=True)), pa.array([r], pa.int32()), pa.array([side]), *lists], names=[*image, "r", "side", "c", "n", "corr"])

        for batch in batches:
            arrow = [batch.schema.field(k).type for k in image]
            for key, band, shot, r, v in _rows([batch], image, frame):
                if held != (key, band):
                    yield from given()
                    held, sums, first, before = (key, band), defaultdict(Moments), {}, (None, None, None)
                base = first.get(r, np.zeros(0))
                if len(base) < len(v):
                    base = np.concatenate([base, np.full(len(v) - len(base), np.nan)])
                base[: len(v)] = np.where(np.isnan(base[: len(v)]), v, base[: len(v)])
                first[r] = base
                v = v - base[: len(v)]
                if r // BAND == band:
                    sums[r, "right"].add(v[:-1], v[1:])
                if before[0] == shot and before[1] == r - 1:
                    sums[r - 1, "down"].add(before[2], v)
                before = (shot, r, v)
        yield from given()

    schema = ", ".join([*(f"{k} {types[k]}" for k in image), "r int, side string, c array<int>, n array<bigint>, corr array<double>"])
    return row_vectors(pixels, image, frame, value).mapInArrow(run, schema)


def mean_rows(rows: DataFrame) -> DataFrame:
    """(r, c, side, corr): of correlated_rows of several images, the mean weighted by n. Vectors travel, one for each image's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = None, np.zeros(0), np.zeros(0)

        def given() -> Iterator[pa.RecordBatch]:
            c = np.flatnonzero(n)
            if len(c):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), key[0], np.int32)), pa.array(c.astype(np.int32)), pa.array([key[1]] * len(c)), pa.array(total[c] / n[c])], names=["r", "c", "side", "corr"])

        for batch in batches:
            for r, side, c, k, q in zip(*(batch.column(x).to_pylist() for x in ("r", "side", "c", "n", "corr")), strict=True):
                if key != (r, side):
                    yield from given()
                    key, n, total = (r, side), np.zeros(0), np.zeros(0)
                if c and c[-1] >= len(n):
                    n, total = (np.pad(x, (0, c[-1] + 1 - len(x))) for x in (n, total))
                n[c] += k
                total[c] += np.array(q) * k
        yield from given()

    return rows.select("r", "side", "c", "n", "corr").repartition("r", "side").sortWithinPartitions("r", "side").mapInArrow(run, "r int, c int, side string, corr double")


def median_rows(frames: DataFrame) -> DataFrame:
    """(r, c, lum): each pixel's median over frames of rows of bytes (r, lum array; null: no sample), half way between the middle two of
    an even number. A row of the image is in one task, with 256 counters for each pixel however many frames there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = None, np.zeros((0, 256), np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            n = counts.sum(1)
            c = np.flatnonzero(n)
            if len(c):
                upto = counts[c].cumsum(1)
                middle = [(upto > k[:, None]).argmax(1) for k in ((n[c] - 1) // 2, n[c] // 2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), held, np.int32)), pa.array(c.astype(np.int32)), pa.array((middle[0] + middle[1]) / 2)], names=["r", "c", "lum"])

        for batch in batches:
            lists = batch.column("lum")
            flat, ends = lists.values, lists.offsets.to_numpy()
            for k, r in enumerate(batch.column("r").to_pylist()):
                if r != held:
                    yield from given()
                    held, counts = r, np.zeros((0, 256), np.int64)
                own = flat.slice(ends[k], ends[k + 1] - ends[k])
                if len(own) > len(counts):
                    counts = np.pad(counts, ((0, len(own) - len(counts)), (0, 0)))
                seen = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
                counts[seen, own.drop_null().to_numpy().astype(np.int64)] += 1
        yield from given()

    return frames.select(F.col("r").cast("int").alias("r"), F.col("lum").cast("array<smallint>").alias("lum")).repartition("r").sortWithinPartitions("r").mapInArrow(run, "r int, c int, lum double")


def painted_rows(labels: DataFrame, curves: DataFrame, ncol: int) -> DataFrame:
    """(night, obs_idx, r, lum array<double> of ncol): the image rows of each frame that have a source with a curve there, each of
    whose pixels has its source's brightness; background, and what has none, is 0.

    A curve's sample meets the image rows of its source, not its pixels, and background meets nothing: a row then lays the few
    values that it was sent over its labels. Labels (r, c, label) outside the columns are left out.
    """
    inside = labels.where((F.col("c") >= 0) & (F.col("c") < ncol) & F.col("label").isNotNull()).select("r", F.col("c").cast("int").alias("c"), F.col("label").cast("long").alias("label"))
    image = inside.groupBy("r").agg(F.collect_list(F.struct("c", "label")).alias("x")).select("r", F.col("x.c").alias("c"), F.col("x.label").alias("label"))
    sent = curves.where("lum IS NOT NULL").select("night", "obs_idx", F.col("source").cast("long").alias("label"), F.col("lum").cast("double").alias("lum")).join(inside.select("r", "label").distinct(), "label")
    rows = sent.groupBy("night", "obs_idx", "r").agg(F.array_sort(F.collect_list(F.struct("label", "lum"))).alias("x")).select("night", "obs_idx", "r", F.col("x.label").alias("source"), F.col("x.lum").alias("v"))
    given = rows.join(image, "r").select("night", "obs_idx", "r", "source", "v", "c", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, len(b), 256)):
            part = {}
            for name in ("source", "v", "c", "label"):
                x = batch.column(name)
                ends = x.offsets.to_numpy()
                part[name] = np.split(x.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends[1:-1] - ends[0])
            out = np.zeros((len(batch), ncol))
            for k, (source, v, c, label) in enumerate(zip(*part.values(), strict=True)):
                at = np.minimum(np.searchsorted(source, label), len(source) - 1)
                out[k, c] = np.where(source[at] == label, v[at], 0.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * ncol), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("night", "obs_idx", "r")), lists], names=["night", "obs_idx", "r", "lum"])

    kinds = dict(given.dtypes)
    return given.mapInArrow(run, f"night {kinds['night']}, obs_idx {kinds['obs_idx']}, r {kinds['r']}, lum array<double>")
