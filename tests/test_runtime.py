"""The shared folder and the tables written there."""

from __future__ import annotations

import pytest
from nightlights import runtime


def test_tables_are_written_read_back_and_cleared(spark):
    held, spark._nightlights_written = getattr(spark, "_nightlights_written", []), []
    df = runtime.materialize(spark.range(5), "some")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    runtime.clear(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        spark.read.schema(df.schema).parquet(df.inputFiles()[0]).collect()
    spark._nightlights_written = held


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())
