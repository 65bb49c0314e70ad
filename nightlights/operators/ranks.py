"""Places in an order over a whole table, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightlights.runtime import materialize


def numbered(df: DataFrame, bucket: Column, order: list[Column], name: str, keys: list[str] | None = None) -> DataFrame:
    """df with name: each row's place from 0 within keys in the order of bucket, then of order.

    Rows are counted by bucket, the few counts are summed up in order, and rows are numbered within buckets, so that tasks
    hold a bucket each. bucket must not decrease along the order, and have many values.
    """
    keys = keys or []
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_count"))
    before = F.coalesce(F.sum("_count").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "_bucket", before.alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_within", within).join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_bucket", "_within", "_start")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """df with sums: for each row the sum of a column up to it, itself included, within keys in the order of order, which no two rows
    of a key share.

    Rows are dealt out by ranges of key and order, so that a key of any size lies in several tasks; the ranges' totals, a few
    rows, are summed up in order, and each range goes on from the total before it.
    """
    keys = keys or []
    dealt = df.withColumns({f"_s{k}": c for k, c in enumerate(sums.values())})
    dealt = materialize(dealt.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    named = [f"_s{k}" for k in range(len(sums))]
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in named])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in named])
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumns({f"_within{c}": F.sum(c).over(within) for c in named}).join(starts, [*keys, "_range"])
    return found.withColumns({name: F.col(f"_before{c}") + F.col(f"_within{c}") for name, c in zip(sums, named, strict=True)}).select(*df.columns, *sums)
