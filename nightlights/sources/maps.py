"""Tables of the city model: survey points, tiles, lots and height rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightlights.operators.vectors import lists

SCHEMAS = {
    "points": "tile int, x double, y double, z double",
    "tiles": "tile int, xmin double, xmax double, ymin double, ymax double",
    "lots": "bbl bigint, x double, y double",
}


def write_map(df: DataFrame, path: str, kind: str, fmt: str = "parquet") -> None:
    """A table of a kind of SCHEMAS, as Parquet or as CSV with a header."""
    cols = [f.split()[0] for f in SCHEMAS[kind].split(", ")]
    df.select(*cols).write.mode("overwrite").options(header=True).format(fmt).save(path)


def read_map(spark: SparkSession, path: str, kind: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).options(header=True).format(fmt).load(path)


def write_raster(grid: DataFrame, path: str) -> None:
    """A raster (row, col, z): one file row for each raster row with its heights from the first column on, and beside it the
    header: least row and column, numbers of both. Cells without a height are null, as those of null or NaN are. Each row's cells are put in
    their places of one vector."""
    ends = grid.agg(F.min("row").alias("row0"), F.min("col").alias("col0"), (F.max("row") - F.min("row") + 1).alias("nrow"), (F.max("col") - F.min("col") + 1).alias("ncol"))
    ends.write.mode("overwrite").option("header", True).csv(f"{path}/header")
    cells = grid.groupBy("row").agg(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("z").cast("double").alias("z"))).alias("at"))
    rows = cells.join(F.broadcast(ends)).select("row", F.col("col0").cast("int").alias("col0"), F.col("ncol").cast("int").alias("ncol"), F.col("at.col").alias("col"), F.col("at.z").alias("z"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            col, z = batch.column("col"), batch.column("z")
            owner = np.repeat(np.arange(len(batch)), np.diff(col.offsets.to_numpy()))
            out = np.full((len(batch), batch.column("ncol")[0].as_py()), np.nan)
            out[owner, col.flatten().to_numpy(zero_copy_only=False) - batch.column("col0")[0].as_py()] = z.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists(out)], names=["row", "z"])

    found = rows.mapInArrow(dense, f"row {grid.schema['row'].dataType.simpleString()}, z array<double>")
    found.repartitionByRange("row").sortWithinPartitions("row").write.mode("overwrite").parquet(f"{path}/rows")


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, z) of a written raster, cells without a height left out."""
    head = spark.read.schema("row0 int, col0 int, nrow int, ncol int").option("header", True).csv(f"{path}/header")
    rows = spark.read.schema("row int, z array<double>").parquet(f"{path}/rows")
    cells = rows.select("row", F.posexplode("z").alias("at", "z")).where("z IS NOT NULL")
    return cells.join(F.broadcast(head)).select("row", (F.col("col0") + F.col("at")).cast("int").alias("col"), "z")
