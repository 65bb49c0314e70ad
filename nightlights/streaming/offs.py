"""Off counts of arriving edges, as a stream: the batch form counts by frames, this one by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def off_counts_stream(edges: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(night, start, n_off) for each window of width; edges later than late are dropped, and a window is final once the
    watermark has passed it, so state is bounded by the windows still open."""
    offs = edges.where("is_off").withWatermark("ts", late)
    return offs.groupBy("night", F.window("ts", width).alias("w")).agg(F.count("*").alias("n_off")).select("night", F.col("w.start").alias("start"), "n_off")
