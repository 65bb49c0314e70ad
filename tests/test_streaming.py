from __future__ import annotations

from nightlights.streaming.offs import off_counts_stream


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("n", f"2017-06-25 {h:02d}:{m:02d}:00", off) for h, m, off in ((20, 5, True), (20, 20, True), (20, 40, True), (21, 0, False), (23, 30, True))]
    df = spark.createDataFrame(rows, "night string, ts string, is_off boolean").selectExpr("night", "CAST(ts AS timestamp) AS ts", "is_off")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = off_counts_stream(stream).writeStream.format("memory").queryName("offs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.start), r.n_off) for r in spark.table("offs").collect()}
    assert got == {("2017-06-25 20:00:00", 2), ("2017-06-25 20:30:00", 1)}
