"""Hyperspectral scans: matching to states, stacking, source spectra, flattening. Long form (scan_id, night, r, c, channel, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightlights.functions.series import clipped, gaussian
from nightlights.operators.rows import correlated_rows
from nightlights.operators.vectors import as_cells, as_vectors, flattened_sums, summed


def scan_windows(scans: DataFrame, states: DataFrame, minutes: float = 5) -> DataFrame:
    """scans (scan_id, ts) joined with states whose ts lies strictly within minutes of it, by time buckets: a window of
    twice that width touches two buckets at most. Scans without a state drop out, being in daylight."""
    half = int(minutes * 60 * 1_000_000)
    t = F.unix_micros("scan_ts")
    bucket = lambda x: F.floor(x / (2 * half))
    left = scans.select("scan_id", F.col("ts").cast("timestamp").alias("scan_ts")).withColumn("b", F.explode(F.array_distinct(F.array(bucket(t - half), bucket(t + half)))))
    right = states.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("b", bucket(F.col("at")))
    return left.join(right, "b").where((F.col("at") > t - half) & (F.col("at") < t + half)).drop("b", "at")


def lit_in_window(matched: DataFrame) -> DataFrame:
    """(scan_id, source) of sources lit at any time in the scan's window, from scan_windows."""
    return matched.groupBy("scan_id", "source").agg(F.max("lit").alias("lit")).where("lit").select("scan_id", "source")


def lit_intervals(states: DataFrame, minutes: float) -> DataFrame:
    """(source, first, last, samples) in microseconds: runs of a source's lit samples that are less than a window of twice minutes apart.

    Samples are counted by cells of that width first, in each of which they are one run, so that a source's samples need no order
    and may be in many tasks.
    """
    gap = int(2 * minutes * 60 * 1_000_000)
    lit = states.where("lit").select("source", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    cells = lit.groupBy("source", F.floor(F.col("at") / gap).alias("cell")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("samples"))
    by = Window.partitionBy("source").orderBy("cell")
    new = cells.withColumn("new", F.coalesce(F.col("first") - F.lag("last").over(by) >= gap, F.lit(True)).cast("int"))
    return new.withColumn("k", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("source", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("samples").alias("samples")).drop("k")


#: Least seconds of the buckets by which windows meet intervals.
BUCKET_S = 6 * 3600


def lit_sources(scans: DataFrame, states: DataFrame, minutes: float = 5) -> DataFrame:
    """(scan_id, source) of sources with a lit sample strictly within minutes of the scan's ts.

    Scans meet intervals, not samples: within an interval samples are less than a window apart, so a window that an interval
    reaches into or covers has one. Both are put under the buckets of time that they touch.
    """
    half = int(minutes * 60 * 1_000_000)
    width = max(2 * half, BUCKET_S * 1_000_000)
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    windows = scans.select("scan_id", (t - half).alias("low"), (t + half).alias("high")).withColumn("b", buckets(F.col("low"), F.col("high")))
    spans = lit_intervals(states, minutes).withColumn("b", buckets(F.col("first"), F.col("last")))
    return windows.join(spans, "b").where("first < high AND last > low").select("scan_id", "source").distinct()


def lit_pixels(scans: DataFrame, labels: DataFrame, lit: DataFrame) -> DataFrame:
    """scans with value, or spectrum, 0 where the pixel's source isn't lit in the scan's window, or there is none.

    Places lit in a scan are made first, so that scans meet them at scan and place, where each has one at most: the background,
    most of any scan, meets nothing and is no key of its own.
    """
    places = labels.select("r", "c", F.col("label").alias("source")).join(lit, "source").select("scan_id", "r", "c", F.lit(True).alias("_lit"))
    marked = scans.join(places, ["scan_id", "r", "c"], "left")
    if "spectrum" in scans.columns:
        return marked.select("scan_id", "night", "r", "c", F.when(F.col("_lit"), F.col("spectrum")).otherwise(F.transform("spectrum", lambda x: F.when(x.isNotNull(), x * 0))).alias("spectrum"))
    return marked.select("scan_id", "night", "r", "c", "channel", F.when(F.col("_lit"), F.col("value")).otherwise(0).alias("value"))


def narrowest(scans: DataFrame, by: list[str]) -> DataFrame:
    """by and ncol: the fewest columns of any scan."""
    return scans.groupBy(*by, "scan_id").agg((F.max("c") + 1).alias("n")).groupBy(*by).agg(F.min("n").alias("ncol"))


def stack(scans: DataFrame, wrap: bool = False) -> DataFrame:
    """Sum of all scans for each place and channel, cut to the narrowest scan; wrap: modulo 65536, as 16 bits would.

    Here and in the other stacks scans may have a row for each channel (value) or an array for each pixel (spectrum); sums are
    taken of whole vectors either way, and channels become rows in the end.
    """
    inside = scans.crossJoin(narrowest(scans, [])).where("c < ncol")
    total = as_cells(summed(as_vectors(inside, ["scan_id"]), []), [])
    return total.withColumn("value", F.pmod("value", F.lit(65536))) if wrap else total


def stacked_spectra(scans: DataFrame, by: list[str], wrap: bool = False) -> DataFrame:
    """by, r, c, spectrum array<int>: stack for each of by, cut to its narrowest scan, pixels left as vectors, as raw cubes are
    written; channels without a value are 0. wrap: modulo 65536."""
    inside = scans.join(narrowest(scans, by), by).where("c < ncol")
    value = lambda x: F.coalesce(F.pmod(x, F.lit(65536.0)) if wrap else x, F.lit(0.0)).cast("int")
    return summed(as_vectors(inside, [*by, "scan_id"]), by).select(*by, "r", "c", F.transform("v", value).alias("spectrum"))


def mean_stack(scans: DataFrame) -> DataFrame:
    """stack over the number of scans, rounded down."""
    n = scans.agg(F.countDistinct("scan_id").alias("n"))
    return stack(scans).crossJoin(n).select("r", "c", "channel", F.floor(F.col("value") / F.col("n")).alias("value"))


def hourly_stacks(scans: DataFrame, hours: tuple[int, ...] = (21, 22, 23, 0, 1, 2, 3, 4)) -> DataFrame:
    """stack of scans (with ts) for each of the hours, each cut to its narrowest scan, with the hour's number of scans and first ts."""
    chosen = scans.withColumn("hour", F.hour("ts")).where(F.col("hour").isin(*hours))
    about = chosen.groupBy("hour").agg(F.countDistinct("scan_id").alias("n_scans"), F.min("ts").alias("first_ts")).join(narrowest(chosen, ["hour"]), "hour")
    inside = chosen.join(about.select("hour", "ncol"), "hour").where("c < ncol")
    return as_cells(summed(as_vectors(inside, ["hour", "scan_id"]), ["hour"]), ["hour"]).join(about.drop("ncol"), "hour")


def box_stack(scans: DataFrame, rows: tuple[int, int], cols: tuple[int, int], scale: float, step: int) -> DataFrame:
    """Sum over every step-th scan of the box's values over scale, cut to whole numbers."""
    every = scans.select("scan_id").distinct().select("scan_id", (F.row_number().over(Window.orderBy("scan_id")) - 1).alias("i")).where(F.col("i") % step == 0)
    box = scans.where((F.col("r") >= rows[0]) & (F.col("r") < rows[1]) & (F.col("c") >= cols[0]) & (F.col("c") < cols[1]))
    chosen = as_vectors(box.join(every, "scan_id", "left_semi"), ["scan_id"])
    return as_cells(summed(chosen.withColumn("v", F.transform("v", lambda x: F.floor(x / scale).cast("double"))), []), [])


def precision_stack(scans: DataFrame, labels: DataFrame, lit: DataFrame, flatten: bool = True) -> DataFrame:
    """Nightly sums of lit pixels, less the median along each scan's row and channel if flatten (zeros take part)."""
    return as_cells(flattened_sums(as_vectors(lit_pixels(scans, labels, lit), ["night", "scan_id"]), flatten), ["night"], "double")


def as_spectra(long: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key and spectrum array, by channel."""
    pairs = F.sort_array(F.collect_list(F.struct("channel", F.col(value).alias("v"))))
    return long.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias("spectrum"))


def source_spectra(scans: DataFrame, labels: DataFrame, total: bool = False) -> DataFrame:
    """Mean (or sum) spectrum of each source, background left out."""
    f = F.sum if total else F.avg
    return scans.join(labels, ["r", "c"]).groupBy(F.col("label").alias("source"), "channel").agg(f("value").alias("value"))


def component_spectra(scans: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean spectrum of each component and of the background (0), without the last row and column."""
    ends = scans.agg(F.max("r").alias("_r"), F.max("c").alias("_c"))
    inner = scans.crossJoin(ends).where("r < _r AND c < _c")
    return inner.join(labels, ["r", "c"], "left").groupBy(F.coalesce("label", F.lit(0)).alias("label"), "channel").agg(F.avg("value").alias("value"))


def spectral_mask(cube: DataFrame, split_row: int = 800, above: float = 0.6, below: float = 0.3, legacy: bool = False) -> DataFrame:
    """(r, c) whose spectrum correlates with the right or lower neighbour's; another threshold from split_row on.

    Only the upper or left pixel is marked. legacy: from split_row on both tests use the right neighbour.
    """
    rows = correlated_rows(cube, [], ["channel"], "value")
    corr = rows.select("r", "side", F.explode(F.arrays_zip("c", "corr")).alias("x")).select("r", F.col("x.c").alias("c"), "side", F.col("x.corr").alias("corr"))
    passed = corr.where(F.col("corr") > F.when(F.col("r") < split_row, above).otherwise(below))
    if legacy:
        passed = passed.where((F.col("r") < split_row) | (F.col("side") == "right"))
    return passed.select("r", "c").distinct()


def scale_spectra(spectra: DataFrame, sigma: float = 10.0) -> DataFrame:
    """source and spectrum: less its median, over its deviation, smoothed over channels."""

    def run(batches):
        for pdf in batches:
            out = []
            for x in pdf["spectrum"]:
                x = np.asarray(x, float)
                sd = x.std()
                out.append(gaussian((x - np.median(x)) / (sd if sd else 1.0), sigma))
            yield pd.DataFrame({"source": pdf["source"], "spectrum": out})

    return spectra.select("source", F.col("spectrum").cast("array<double>")).mapInPandas(run, "source int, spectrum array<double>")


def subtract_clipped_median(cube: DataFrame, line: list[str], k: float = 3.0, rounds: int = 10, centre: str = "median", upper_only: bool = False) -> DataFrame:
    """cube with each line's median, of what iterative clipping leaves, subtracted. A line travels as one array, so its length
    is bounded by an image's side."""
    rest = [c for c in cube.columns if c not in (*line, "value")]

    @F.pandas_udf("array<double>")
    def flat(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: x - np.median(x[clipped(x, k, rounds, centre, upper_only)]))

    rows = cube.groupBy(*line).agg(F.collect_list(F.struct(*rest, F.col("value").cast("double").alias("value"))).alias("rows"))
    rows = rows.select(*line, "rows", flat(F.transform("rows", lambda x: x["value"])).alias("value"))
    each = rows.select(*line, F.explode(F.arrays_zip("rows", "value")).alias("x"))
    return each.select(*[F.col(c) if c in line else F.col("x.value").alias(c) if c == "value" else F.col(f"x.rows.{c}").alias(c) for c in cube.columns])


def flatten_cube(cube: DataFrame, bands: tuple[int, ...] = (425, 800, 1170)) -> DataFrame:
    """cube less its clipped medians (upper clip only) along columns, then within bands of rows along rows."""
    first = subtract_clipped_median(cube, ["channel", "r"], upper_only=True)
    band = sum((F.when(F.col("r") >= b, 1).otherwise(0) for b in bands), F.lit(0))
    return subtract_clipped_median(first.withColumn("band", band), ["channel", "band", "c"], upper_only=True).drop("band")


def subsample(cube: DataFrame, factor: int) -> DataFrame:
    return cube.where((F.col("r") % factor == 0) & (F.col("c") % factor == 0))


def luminosity(cube: DataFrame) -> DataFrame:
    """Mean over channels."""
    return cube.groupBy("r", "c").agg(F.avg("value").alias("lum"))


def flatten_luminosity(image: DataFrame, split_row: int = 800) -> DataFrame:
    """Each row's mean is subtracted, then each column's median within the rows above and below split_row."""
    rows = image.join(image.groupBy("r").agg(F.avg("lum").alias("_m")), "r").select("r", "c", (F.col("lum") - F.col("_m")).alias("lum"), (F.col("r") >= split_row).alias("_b"))
    return rows.join(rows.groupBy("_b", "c").agg(F.median("lum").alias("_m")), ["_b", "c"]).select("r", "c", (F.col("lum") - F.col("_m")).alias("lum"))


def bin_channels(long: DataFrame, keys: list[str], size: int = 8, value: str = "value") -> DataFrame:
    """keys, bin and the mean of each size channels."""
    return long.groupBy(*keys, F.floor(F.col("channel") / size).cast("int").alias("bin")).agg(F.avg(value).alias(value))


def binned(spectrum: Column, size: int) -> Column:
    """Array form of bin_channels."""
    n = F.ceil(F.size(spectrum) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(F.slice(spectrum, b * size + 1, size), F.lit(0.0), lambda s, x: s + x) / F.size(F.slice(spectrum, b * size + 1, size)))


def temporal_features(scans: DataFrame, size: int = 8, places: tuple[int, ...] = (0, 14, 49)) -> DataFrame:
    """(r, c, features): binned spectra, cut to whole numbers, of the scans at places of each night, side by side."""
    place = scans.select("night", "scan_id").distinct().select("scan_id", (F.row_number().over(Window.partitionBy("night").orderBy("scan_id")) - 1).alias("i")).where(F.col("i").isin(*places))
    chosen = scans.join(place, "scan_id", "left_semi")
    rows = bin_channels(chosen.crossJoin(narrowest(chosen, [])).where("c < ncol"), ["scan_id", "r", "c"], size)
    ordered = F.sort_array(F.collect_list(F.struct("scan_id", "bin", F.floor("value").cast("int").alias("v"))))
    return rows.groupBy("r", "c").agg(F.transform(ordered, lambda x: x["v"]).alias("features"))
