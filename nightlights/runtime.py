"""What jobs need from the session: the shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share. Where it is unset, a temporary one if Spark runs in
    this process; elsewhere executors would each write to their own disk, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_nightlights_shared", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark._nightlights_shared = "file://" + tempfile.mkdtemp(prefix="nightlights-")
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage ends at files that survive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    spark._nightlights_written = [*getattr(spark, "_nightlights_written", []), path]
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this session has written between steps. Results still read them, so write these first."""
    for path in getattr(spark, "_nightlights_written", []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark._nightlights_written = []
