"""Source masks from pixels: neighbour correlation, components, sizes, detection, selection; curves of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightlights.operators.components import label_components
from nightlights.operators.rows import correlated_rows, mean_rows, median_rows, painted_rows


def neighbour_correlation(pixels: DataFrame) -> DataFrame:
    """(r, c, side, corr): mean over all nights' frames of the product of z-scores within the night; a night's is its population
    correlation, 0 without spread, weighted by its frames. pixels are (night, obs_idx, r, c, lum), or rows with lum an array."""
    return mean_rows(correlated_rows(pixels, ["night"], ["obs_idx"], "lum", 1e-9))


def source_mask(correlation: DataFrame, thresh: float = 0.5) -> DataFrame:
    """(r, c) of both pixels of each pair beyond thresh."""
    down = (F.col("side") == "down").cast("int")
    other = F.struct((F.col("r") + down).alias("r"), (F.col("c") + 1 - down).alias("c"))
    return correlation.where(F.col("corr") > thresh).select(F.explode(F.array(F.struct("r", "c"), other)).alias("p")).select("p.r", "p.c").distinct()


def either(*masks: DataFrame) -> DataFrame:
    """(r, c) that any of the masks has."""
    out = masks[0].select("r", "c")
    for m in masks[1:]:
        out = out.union(m.select("r", "c"))
    return out.distinct()


def label_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def bright_sources(frames: DataFrame, ncol: int, k: float = 5.0, least: int = 25, most: int = 500) -> DataFrame:
    """(frame, label, size, r, c): centres of components over the frame's median + k deviations with least < size < most."""
    level = frames.groupBy("frame").agg((F.median("lum") + k * F.stddev_pop("lum")).alias("level"))
    bright = frames.join(level, "frame").where("lum > level").select("frame", "r", "c")
    labels = label_components(bright, ncol, ["frame"])
    return labels.groupBy("frame", "label").agg(F.count("*").alias("size"), F.avg("r").alias("r"), F.avg("c").alias("c")).where((F.col("size") > least) & (F.col("size") < most))


def box_centre(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], sig: float, by: list[str]) -> DataFrame:
    """by, r, c: mean place of the box's pixels over sig times the box's deviation, for each frame (by)."""
    box = crop(pixels, rows, cols)
    return box.join(box.groupBy(*by).agg((sig * F.stddev_pop("lum")).alias("level")), by).where("lum > level").groupBy(*by).agg(F.avg("r").alias("r"), F.avg("c").alias("c"))


def crop(df: DataFrame, rows: tuple[int, int] = (900, 1200), cols: tuple[int, int] = (1400, 2200)) -> DataFrame:
    return df.where((F.col("r") >= rows[0]) & (F.col("r") < rows[1]) & (F.col("c") >= cols[0]) & (F.col("c") < cols[1]))


def bayer_rgb(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, c at half resolution with red (even row, odd column), green (even, even) and blue (odd, even); (odd, odd) is dropped."""
    odd_r, odd_c = F.col("r") % 2 == 1, F.col("c") % 2 == 1
    pick = lambda cond: F.max(F.when(cond, F.col("lum")))
    half = [F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")]
    return pixels.where(~(odd_r & odd_c)).groupBy(*keys, *half).agg(pick(~odd_r & odd_c).alias("red"), pick(~odd_r & ~odd_c).alias("green"), pick(odd_r & ~odd_c).alias("blue"))


def gamma(value: Column, gam: float = 0.5, scale: float = 1.0) -> Column:
    return F.floor(F.greatest(F.least(F.pow(value / 255, F.lit(gam)) * 255 * scale, F.lit(255.0)), F.lit(0.0))).cast("int")


def stretch(pixels: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """pixels with lum clipped to [lo, hi], less the frame's least, scaled to 255 at its most; null where the frame is flat."""
    clip = pixels.withColumn("lum", F.greatest(F.least("lum", F.lit(hi)), F.lit(lo)))
    ends = clip.groupBy(*keys).agg(F.min("lum").alias("_lo"), F.max("lum").alias("_hi"))
    return clip.join(ends, keys).withColumn("lum", F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("lum") - F.col("_lo")) * 255 / (F.col("_hi") - F.col("_lo"))).cast("int"))).drop("_lo", "_hi")


def convert_frames(pixels: DataFrame, factor: int, gray: tuple[float, float, float]) -> DataFrame:
    """Frames for viewing: Bayer split, every factor-th pixel, gray-world division, gamma and stretch to 60..200, by band."""
    rgb = bayer_rgb(pixels, ["night", "obs_idx"]).where((F.col("r") % factor == 0) & (F.col("c") % factor == 0))
    long = rgb.select("night", "obs_idx", "r", "c", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), (F.col(b) / g).alias("lum")) for b, g in zip(("red", "green", "blue"), gray, strict=True)])).alias("v")).select("night", "obs_idx", "r", "c", "v.*")
    return stretch(long.where("lum IS NOT NULL").withColumn("lum", gamma(F.col("lum"), 0.5, 2.0)), ["night", "obs_idx"], 60, 200)


def middle_sized(labels: DataFrame, least: int = 20, k: float = 2.0) -> DataFrame:
    """label of the components of more than least and under mean + k deviations of all sizes."""
    sizes = label_sizes(labels)
    return sizes.crossJoin(sizes.agg((F.avg("size") + k * F.stddev_pop("size")).alias("most"))).where((F.col("size") > least) & (F.col("size") < F.col("most"))).select("label", "size")


def drop_small(labels: DataFrame, least: int = 20) -> DataFrame:
    """labels of components of at least so many pixels."""
    return labels.join(label_sizes(labels).where(F.col("size") >= least), "label", "left_semi").select("r", "c", "label")


def drop_bad_rows(mask: DataFrame, limit: int = 1000) -> DataFrame:
    """mask without the image rows in which it has limit pixels or more."""
    return mask.join(mask.groupBy("r").agg(F.count("*").alias("n")).where(F.col("n") < limit), "r", "left_semi")


def dark_slice(pixels: DataFrame, step: int) -> DataFrame:
    """(night, start, stop): from each step-th frame's mean, the first and last dark frame; dark is below the median + 0.5."""
    means = pixels.where(F.col("obs_idx") % step == 0).groupBy("night", "obs_idx").agg(F.avg("lum").alias("m"))
    level = means.groupBy("night").agg((F.median("m") + 0.5).alias("level"))
    return means.join(level, "night").where("m < level").groupBy("night").agg((F.min("obs_idx") + step).alias("start"), F.max("obs_idx").alias("stop"))


def keep_labels(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """labels with 0 for all that aren't wanted (label)."""
    flag = wanted.select("label").distinct().withColumn("_on", F.lit(True))
    return labels.join(flag, "label", "left").select("r", "c", F.when(F.col("_on"), F.col("label")).otherwise(0).alias("label"))


def light_curves(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """(night, obs_idx, source, lum): mean over each source's pixels in each frame. Background goes before the shuffle
    where Spark broadcasts labels, which it does if they are small."""
    return pixels.join(labels, ["r", "c"]).groupBy("night", "obs_idx", F.col("label").alias("source")).agg(F.avg("lum").alias("lum"))


def paint_curves(labels: DataFrame, curves: DataFrame, nrow: int, ncol: int) -> DataFrame:
    """(night, obs_idx, r, c, lum): every pixel of the grid with its source's brightness in each frame, background 0. Whole image
    rows are painted by painted_rows; rows without light, and pixels, are only filled in here."""
    frames = curves.select("night", "obs_idx").distinct()
    rows = frames.crossJoin(labels.sparkSession.range(nrow).select(F.col("id").cast("int").alias("r")))
    lum = F.coalesce("lum", F.array_repeat(F.lit(0.0), ncol))
    return rows.join(painted_rows(labels, curves, ncol), ["night", "obs_idx", "r"], "left").select("night", "obs_idx", "r", F.posexplode(lum).alias("c", "lum"))


def mask_box(mask: DataFrame) -> DataFrame:
    return mask.agg(F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"))


#: Where a pixel's label may go, by rising priority number: (rows up, columns left) of the target, and the cell in between that must be on the grid.
_GROW = [(1, 0), (0, 1), (1, 1)]


def grow_labels(labels: DataFrame, nrow: int, ncol: int, least: int = 3, right: bool = False) -> DataFrame:
    """(r, c, label): components of more than least pixels, and background pixels that take the first label of: above,
    left, above left, then the same seen from the pixel below; with right, then all of those seen from the pixel to the right."""
    big = labels.join(label_sizes(labels).where(F.col("size") > least), "label", "left_semi")
    moves = [(0, 0), *_GROW]
    targets = []
    for across in (0, 1) if right else (0,):
        for up in (0, 1):
            for dr, dc in moves:
                targets.append((dr - up, dc - across, up, across))
    found = [
        F.struct(F.lit(p).alias("p"), (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), (F.col("r") + dr + up).alias("mr"), (F.col("c") + dc + across).alias("mc"))
        for p, (dr, dc, up, across) in enumerate(targets)
    ]
    spread = big.select("label", F.explode(F.array(*found)).alias("t")).select("label", "t.*")
    inside = spread.where((F.col("r") >= 0) & (F.col("r") < nrow) & (F.col("c") >= 0) & (F.col("c") < ncol) & (F.col("mr") < nrow) & (F.col("mc") < ncol))
    return inside.groupBy("r", "c").agg(F.min_by("label", "p").alias("label"))


def colour_fractions(pixels: DataFrame, labels: DataFrame, stop: int = 1700, step: int = 30) -> DataFrame:
    """(source, r, g, b): mean colour fractions over a source's half-resolution pixels, from each pixel's median frame.

    pixels have (r, c, lum), or rows of bytes as lum, whose medians come from counts of the 256 values. The label of a half-resolution pixel is that at its even row and odd column.
    """
    chosen = pixels.where((F.col("obs_idx") < stop) & (F.col("obs_idx") % step == 0))
    if isinstance(pixels.schema["lum"].dataType, T.ArrayType):
        frame = median_rows(chosen).withColumn("lum", F.floor("lum"))
    else:
        frame = chosen.groupBy("r", "c").agg(F.floor(F.median("lum")).alias("lum"))
    rgb = bayer_rgb(frame, []).fillna(0, ["red", "green", "blue"])
    total = F.col("red") + F.col("green") + F.col("blue")
    part = lambda x: F.when(total > 0, F.col(x) / total).otherwise(0.0)
    at = labels.where("r % 2 = 0 AND c % 2 = 1").select(F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c"), F.col("label").alias("source"))
    return rgb.join(at, ["r", "c"]).groupBy("source").agg(F.avg(part("red")).alias("red"), F.avg(part("green")).alias("green"), F.avg(part("blue")).alias("blue"))
