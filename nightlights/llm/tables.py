"""Reading the given tables, and what several operators' queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


def quoted(name: str) -> str:
    """A column's name as col() takes it whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column in taken has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def row_key(docs: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of all columns; columns that hold maps, which Spark doesn't hash, count by their JSON."""
    cols = [F.to_json(F.struct(F.col(quoted(c.name)).alias("x"))) if '"map"' in c.dataType.json() else F.col(quoted(c.name)) for c in docs.schema.fields]
    return [F.xxhash64(*cols), F.xxhash64(F.lit("check"), *cols)]
