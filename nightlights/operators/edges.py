"""On and off transitions of brightness series (night, source; obs_idx from 0 without gaps)."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightlights.functions.series import clip_stats, gaussian

SERIES = ["night", "source"]


def _by():
    return Window.partitionBy(*SERIES).orderBy("obs_idx")


def smooth(curves: DataFrame, sigma: float = 30) -> DataFrame:
    """night, source, obs_idx, smooth and seen: the mask-normalised Gaussian along time. A sample is seen if none is null within
    the kernel's reach; others are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_idx")
        sm, seen = _smooth(pdf["lum"].to_numpy(float), sigma)
        return pd.DataFrame({"night": pdf["night"], "source": pdf["source"], "obs_idx": pdf["obs_idx"], "smooth": sm, "seen": seen})

    return curves.select(*SERIES, "obs_idx", "lum").groupBy(*SERIES).applyInPandas(run, "night string, source int, obs_idx int, smooth double, seen boolean")


def _smooth(x: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    seen = gaussian(np.isfinite(x).astype(float), sigma) > 0.9999
    weight = gaussian(seen.astype(float), sigma)
    return gaussian(np.where(seen, np.nan_to_num(x), 0.0), sigma) / np.where(weight == 0, 1.0, weight), seen


def difference(smoothed: DataFrame) -> DataFrame:
    """smoothed, gd, the next smoothed sample less the one before, and usable: both of these are seen. At both ends gd is 0 and usable."""
    gd = F.coalesce(F.lead("smooth").over(_by()) - F.lag("smooth").over(_by()), F.lit(0.0))
    before, after = F.lag("seen").over(_by()), F.lead("seen").over(_by())
    return smoothed.withColumns({"gd": gd, "usable": before.isNull() | after.isNull() | (before & after)})


def clip_levels(differences: DataFrame, k: float = 2.0, rounds: int = 10) -> DataFrame:
    """(night, source, mean, sd) of usable gd after iterative clipping."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_idx")
        mean, sd = clip_stats(pdf["gd"].to_numpy(), k, rounds, pdf["usable"].to_numpy(bool))
        return pd.DataFrame({"night": [pdf["night"].iat[0]], "source": [pdf["source"].iat[0]], "mean": [mean], "sd": [sd]})

    return differences.select(*SERIES, "obs_idx", "gd", "usable").groupBy(*SERIES).applyInPandas(run, "night string, source int, mean double, sd double")


def tags(differences: DataFrame, levels: DataFrame, s: float = 0.0) -> DataFrame:
    """differences with tag_on and tag_off: usable strict local extremes of gd beyond s deviations from its clipped mean."""
    before, after = F.lag("gd").over(_by()), F.lead("gd").over(_by())
    d = F.col("gd") - F.col("mean")
    on = F.col("usable") & (d > s * F.col("sd")) & (F.col("gd") > before) & (F.col("gd") > after)
    off = F.col("usable") & (d < -s * F.col("sd")) & (F.col("gd") < before) & (F.col("gd") < after)
    return differences.join(levels, SERIES).select(*SERIES, "obs_idx", "gd", F.coalesce(on, F.lit(False)).alias("tag_on"), F.coalesce(off, F.lit(False)).alias("tag_off"))


def cross_check(curves: DataFrame, w: int = 30, k: float = 2.0) -> DataFrame:
    """night, source, obs_idx and good: the means of the w samples before and from here on differ by more than k times the
    larger of their deviations. Series are mirrored at both ends; every sample is repeated at the places it mirrors to. False
    where a sample is null among these."""
    n = F.count("*").over(Window.partitionBy(*SERIES))
    at = F.col("obs_idx")
    turns = F.ceil(F.lit(float(w)) / (2 * F.col("n"))).cast("int")
    copies = F.flatten(F.transform(F.sequence(-turns, turns), lambda t: F.array(at + t * 2 * F.col("n"), -1 - at + t * 2 * F.col("n"))))
    rows = curves.select(*SERIES, "obs_idx", "lum").withColumn("n", n.cast("int"))
    wide = rows.select(*SERIES, "n", "lum", F.explode(copies).alias("at")).where((F.col("at") >= -w) & (F.col("at") < F.col("n") + w))
    by = Window.partitionBy(*SERIES).orderBy("at")
    left, right = by.rowsBetween(-w, -1), by.rowsBetween(0, w - 1)
    gap = F.abs(F.avg("lum").over(right) - F.avg("lum").over(left))
    most = F.greatest(F.stddev_pop("lum").over(left), F.stddev_pop("lum").over(right))
    whole = (F.count("lum").over(left) == w) & (F.count("lum").over(right) == w)
    checked = wide.select(*SERIES, "n", "at", (whole & (gap > k * most)).alias("good"))
    return checked.where((F.col("at") >= 0) & (F.col("at") < F.col("n"))).select(*SERIES, F.col("at").alias("obs_idx"), F.coalesce("good", F.lit(False)).alias("good"))


def detect(curves: DataFrame, w: int = 30, s: float = 0.0, clip: float = 2.0, k: float = 2.0, sigma: float | None = None) -> DataFrame:
    """(night, source, obs_idx, lum, gd, is_on, is_off): the whole detector in one shuffle, a series at a time.

    Every step works on one series of one night, so a group is as long as a night has frames.
    """
    width = w if sigma is None else sigma

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_idx")
        x = pdf["lum"].to_numpy(float)
        sm, seen = _smooth(x, width)
        gd, usable = np.zeros(len(x)), np.ones(len(x), bool)
        gd[1:-1], usable[1:-1] = sm[2:] - sm[:-2], seen[2:] & seen[:-2]
        mean, sd = clip_stats(gd, clip, usable=usable)
        on, off = np.zeros(len(x), bool), np.zeros(len(x), bool)
        mid, up, down = gd[1:-1], gd[2:], gd[:-2]
        on[1:-1] = (mid - mean > s * sd) & (mid > up) & (mid > down)
        off[1:-1] = (mid - mean < -s * sd) & (mid < up) & (mid < down)
        good = _robust(x, w, k) & usable
        return pd.DataFrame({"night": pdf["night"], "source": pdf["source"], "obs_idx": pdf["obs_idx"], "lum": x, "gd": gd, "is_on": on & good, "is_off": off & good})

    return curves.select(*SERIES, "obs_idx", "lum").groupBy(*SERIES).applyInPandas(run, "night string, source int, obs_idx int, lum double, gd double, is_on boolean, is_off boolean")


def _robust(x: np.ndarray, w: int, k: float) -> np.ndarray:
    from nightlights.functions.series import reflected

    wide = x[reflected(np.arange(-w, len(x) + w), len(x))]
    windows = np.lib.stride_tricks.sliding_window_view(wide, w)
    left, right = windows[: len(x)], windows[w : w + len(x)]
    return np.abs(right.mean(1) - left.mean(1)) > k * np.maximum(left.std(1), right.std(1))


def detrend(pixels: DataFrame, sigma: float) -> DataFrame:
    """pixels (night, obs_idx, r, c, lum) less their Gaussian along time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_idx")
        return pdf.assign(lum=pdf["lum"] - gaussian(pdf["lum"].to_numpy(), sigma))

    return pixels.select("night", "obs_idx", "r", "c", "lum").groupBy("night", "r", "c").applyInPandas(run, "night string, obs_idx int, r int, c int, lum double")


