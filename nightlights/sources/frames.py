"""Frames and scans from raw files, and nightly tables written by night."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightlights.sources.ranges import PIECE, opened, reachable, spread


def slice_frames(files: DataFrame, order: str, start: int, stop: int, step: int, by: list[str] | None = None) -> DataFrame:
    """files with obs_idx, their place within the night (or by) by order, kept where start <= obs_idx < stop in steps of step."""
    place = F.row_number().over(Window.partitionBy(*(by or ["night"])).orderBy(order)) - 1
    return files.withColumn("obs_idx", place.cast("int")).where((F.col("obs_idx") >= start) & (F.col("obs_idx") < stop) & ((F.col("obs_idx") - start) % step == 0))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, ts) of all files under path; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.date_trunc("second", "modificationTime").alias("ts"))


def list_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, night, ts) of raw files in folders month/night, without their content; night is month-night."""
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return list_files(spark, path).select("path", "length", F.concat_ws("-", part(-3), part(-2)).alias("night"), "ts")


def read_frames(spark: SparkSession, path: str, rows: int, cols: int, start: int = 0, stop: int = 2700, step: int = 1, bands: int = 1, reverse_bands: bool = False) -> DataFrame:
    """(night, obs_idx, ts, r, band, pixels array<short>): one row for each image row of the chosen raw 8-bit frames.

    Names are listed, chosen and dealt out; each task then opens the frames whose names it has, so that pixels are read once
    and never shuffled, and other frames aren't opened. In a store that only Spark's readers reach, these read the chosen
    frames, which are then joined by path. Bytes after the pixels are ignored. reverse_bands: the camera stored blue first.
    """
    chosen = slice_frames(list_frames(spark, path), "path", start, stop, step)
    size = rows * cols * bands
    if reachable(path):
        given = spread(chosen.select("night", "obs_idx", "ts", "path"), F.lit(size).cast("long"))
    else:
        content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([r.path for r in chosen.select("path").collect()] or path).select("path", "content")
        given = chosen.join(content, "path").select("night", "obs_idx", "ts", "path", "content")

    def pixels_of(batch: pa.RecordBatch, k: int) -> bytes:
        if "content" in batch.schema.names:
            return batch.column("content")[k].as_py()
        with opened(batch.column("path")[k].as_py()) as read:
            return read(0, size)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                cube = np.frombuffer(pixels_of(batch, k), np.uint8, size).reshape(rows, cols, bands)
                cube = cube[:, :, ::-1] if reverse_bands else cube
                one = batch.slice(k, 1).select(["night", "obs_idx", "ts"])
                for b in range(bands):
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([c] * rows) for c in one.columns] + [pa.array(np.arange(rows, dtype=np.int32)), pa.array(np.full(rows, b, np.int32)), _lists(cube[:, :, b].astype(np.int16))], names=[*one.schema.names, "r", "band", "pixels"])

    return given.mapInArrow(decode, "night string, obs_idx int, ts timestamp, r int, band int, pixels array<smallint>")


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list for each row of a table of numbers."""
    return pa.ListArray.from_arrays(pa.array(np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).reshape(-1)))


def explode_frames(frames: DataFrame) -> DataFrame:
    """(night, obs_idx, ts, r, c, lum) from rows of pixels."""
    return frames.select("night", "obs_idx", "ts", "r", F.posexplode("pixels").alias("c", "lum"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(scan, samples, lines, bands) from text headers of 'key = value' lines."""
    lines = spark.read.text(path).select(F.input_file_name().alias("scan"), F.split("value", "=").alias("kv")).where(F.size("kv") == 2)
    keys = lines.select("scan", F.lower(F.trim(F.col("kv")[0])).alias("k"), F.trim(F.col("kv")[1]).alias("v")).where(F.col("k").isin("samples", "lines", "bands"))
    return keys.groupBy("scan").pivot("k", ["samples", "lines", "bands"]).agg(F.first(F.col("v").cast("int")))


def read_wavelengths(spark: SparkSession, path: str) -> DataFrame:
    """(scan, channel, wavelength) of text headers: the first number of each line after the last that says Wavelength, for as
    many lines as there are bands. A header without such a list, or without bands, has none; a line without a number gives null."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("scan"), "value", F.split("value", "\r?\n").alias("lines"))
    bands = F.regexp_extract("value", r"(?im)^\s*bands\s*=\s*(\d+)", 1)
    start = F.array_max(F.transform("lines", lambda x, k: F.when(x.contains("Wavelength"), k)))
    found = text.select("scan", "lines", start.alias("start"), bands.try_cast("int").alias("bands")).where("start IS NOT NULL AND bands > 0")
    number = F.regexp_extract("line", r"^\s*([-+0-9.eE]+)", 1).try_cast("double")
    return found.select("scan", F.posexplode(F.slice("lines", F.col("start") + 2, F.col("bands"))).alias("channel", "line")).select("scan", "channel", number.alias("wavelength"))


#: A scan's or a header's name: the file's, without the extension.
FILE_NAME = r"([^/]+?)(\.[^./]*)?$"


def read_scans(spark: SparkSession, path: str, headers: DataFrame, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, name: str = FILE_NAME) -> DataFrame:
    """(scan, r, c, spectrum array<int>) of raw 16-bit scans stored by column, channel and descending row, or of a box of each.

    headers (scan, samples, lines, bands: rows, columns, channels) gives each scan its own shape; a raw file and its header
    belong together if the first group of name finds the same in their paths. A scan may have any size: of each, pieces of
    whole columns are dealt out to tasks, and columns outside the box, which ends where a scan does, aren't read. A scan
    without a header and a header without a scan drop out; a file that is shorter than its header says is an error, and bytes
    after the pixels are ignored. Tasks open the files themselves, so their store must be one that pyarrow knows.
    """
    called = lambda c: F.regexp_extract(c, name, 1)
    shapes = headers.select(called("scan").alias("scan"), "samples", "lines", "bands")
    found = list_files(spark, path).select(called("path").alias("scan"), "path").join(shapes, "scan")
    lo, hi = cols or (0, None)
    ends = found.withColumn("stop", F.col("lines") if hi is None else F.least("lines", F.lit(hi))).where(F.col("stop") > lo)
    column = F.col("samples").cast("long") * F.col("bands") * 2
    pieces = ends.withColumn("step", F.greatest(F.lit(1), F.floor(F.lit(PIECE) / column)).cast("int")).withColumn("first", F.explode(F.sequence(F.lit(lo), F.col("stop") - 1, "step")))
    pieces = pieces.withColumn("n", F.least("step", F.col("stop") - F.col("first")))
    top, bottom = rows or (0, None)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                size = p["samples"] * p["bands"] * 2
                with opened(p["path"]) as read:
                    cube = np.frombuffer(read(p["first"] * size, p["n"] * size), "<u2").reshape(p["n"], p["bands"], p["samples"])[:, :, ::-1][:, :, top:bottom]
                places = pa.array(np.arange(p["first"], p["first"] + p["n"], dtype=np.int32))
                for k in range(cube.shape[2]):
                    yield pa.RecordBatch.from_arrays([pa.array([p["path"]] * p["n"]), pa.array(np.full(p["n"], top + k, np.int32)), places, _lists(cube[:, :, k].astype(np.int32))], names=["scan", "r", "c", "spectrum"])

    given = spread(pieces.select("path", "samples", "bands", "first", "n"), F.col("n") * F.col("samples").cast("long") * F.col("bands") * 2)
    return given.mapInArrow(decode, "scan string, r int, c int, spectrum array<int>")


def write_nights(df: DataFrame, path: str, codec: str = "gzip") -> None:
    """A nightly table, in a folder for each night."""
    df.write.mode("overwrite").option("compression", codec).partitionBy("night").parquet(path)


def read_nights(spark: SparkSession, path: str, schema: str, nights: list[str] | None = None) -> DataFrame:
    """A nightly table, or some of its nights, of which alone the folders are read."""
    found = spark.read.schema(schema).parquet(path)
    return found.where(F.col("night").isin(nights)) if nights is not None else found


def write_cube(stack: DataFrame, path: str) -> None:
    """A stacked cube (night, r, c, channel, value), in a folder for each night: sorted by channel and place over as many tasks as
    it needs, so that readers skip channels by their bounds."""
    stack.repartitionByRange("night", "channel", "r").sortWithinPartitions("night", "channel", "r", "c").write.mode("overwrite").partitionBy("night").parquet(path)
