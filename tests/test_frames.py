"""Raw frames, scans and headers from files, chosen by place."""

from __future__ import annotations

import numpy as np
import pytest
from nightlights.operators import stacks
from nightlights.sources import frames, maps, ranges


def test_frames(spark, tmp_path):
    night = tmp_path / "07" / "01"
    night.mkdir(parents=True)
    cubes = []
    for k in range(6):
        cubes.append(np.arange(24, dtype=np.uint8).reshape(4, 3, 2) + k)
        (night / f"f{k}.raw").write_bytes(cubes[-1].tobytes())
    got = frames.read_frames(spark, str(tmp_path), 4, 3, 1, 6, 2, bands=2, reverse_bands=True)
    rows = {(r.obs_idx, r.r, r.band): r.pixels for r in got.collect()}
    assert {k[0] for k in rows} == {1, 3, 5}
    for (k, r, b), pixels in rows.items():
        assert pixels == cubes[k][r, :, 1 - b].tolist()
    long = frames.explode_frames(got.where("band = 0"))
    assert long.count() == 3 * 12


def test_pixels_are_not_shuffled(spark, tmp_path):
    """A frame that isn't chosen isn't opened, and no exchange has more than names in it."""
    night = tmp_path / "07" / "01"
    night.mkdir(parents=True)
    for k in range(4):
        (night / f"f{k}.raw").write_bytes(bytes(12) if k == 2 else bytes(5))  # too short for a frame
    got = frames.read_frames(spark, str(tmp_path), 4, 3, 2, 3, 1)
    assert got.count() == 4 and "content" not in got._jdf.queryExecution().executedPlan().toString()


def test_stores_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    night = tmp_path / "07" / "01"
    night.mkdir(parents=True)
    for k in range(4):
        (night / f"f{k}.raw").write_bytes(bytes(range(k, k + 12)))
    want = sorted(frames.read_frames(spark, str(tmp_path), 4, 3, 1, 4, 2).collect())
    monkeypatch.setattr(frames, "reachable", lambda path: False)
    assert sorted(frames.read_frames(spark, str(tmp_path), 4, 3, 1, 4, 2).collect()) == want
    assert not ranges.reachable("viewfs://store/x") and ranges.reachable("file:///tmp/x") and ranges.reachable("/tmp/x")


def scan(tmp_path, name, rows, channels, cols, after=b""):
    cube = np.random.default_rng(cols).integers(0, 65535, (rows, channels, cols)).astype("<u2")
    (tmp_path / f"{name}.raw").write_bytes(cube.transpose(2, 1, 0)[:, :, ::-1].tobytes() + after)
    (tmp_path / f"{name}.hdr").write_text(f"ENVI\nsamples = {rows}\nlines = {cols}\nbands = {channels}\n")
    return cube


def test_scans_of_their_own_widths(spark, tmp_path):
    cubes = {"a": scan(tmp_path, "a", 3, 4, 5), "b.c": scan(tmp_path, "b.c", 3, 4, 9, b"\n"), "d": scan(tmp_path, "d", 6, 2, 1, b"more than that")}
    (tmp_path / "no_header.raw").write_bytes(b"x")
    heads = frames.read_header(spark, f"{tmp_path}/*.hdr")
    got = {(r.scan.rpartition("/")[2][:-4], r.r, r.c): r.spectrum for r in frames.read_scans(spark, f"{tmp_path}/*.raw", heads).collect()}
    assert got == {(k, r, c): x[r, :, c].tolist() for k, x in cubes.items() for r in range(x.shape[0]) for c in range(x.shape[2])}
    box = {(r.scan.rpartition("/")[2][:-4], r.r, r.c): r.spectrum for r in frames.read_scans(spark, f"{tmp_path}/*.raw", heads, (1, 4), (3, 7)).collect()}
    assert box == {k: v for k, v in got.items() if 1 <= k[1] < 4 and 3 <= k[2] < 7}


def test_scan_of_over_two_gibibytes(spark, tmp_path):
    """A sparse file of 3.2 GB: the box's pieces are read, whole scans are dealt out in many tasks."""
    rows, channels, cols = 1600, 848, 1200
    size = rows * channels * 2
    last = np.arange(rows * channels, dtype="<u2").reshape(channels, rows)
    with open(tmp_path / "big.raw", "wb") as f:
        f.truncate(size * cols)
        f.seek(size * (cols - 1))
        f.write(last.tobytes())
    (tmp_path / "big.hdr").write_text(f"samples = {rows}\nlines = {cols}\nbands = {channels}\n")
    heads = frames.read_header(spark, f"{tmp_path}/*.hdr")
    got = {(r.r, r.c): r.spectrum for r in frames.read_scans(spark, f"{tmp_path}/*.raw", heads, (10, 12), (cols - 2, cols + 50)).collect()}
    assert set(got) == {(r, c) for r in (10, 11) for c in (cols - 2, cols - 1)} and not any(got[10, cols - 2])
    assert got[11, cols - 1] == last[:, rows - 1 - 11].tolist()
    assert frames.read_scans(spark, f"{tmp_path}/*.raw", heads).rdd.getNumPartitions() == -(-size * cols // ranges.SHARE)


def test_cut_scan_is_an_error(spark, tmp_path):
    scan(tmp_path, "a", 3, 4, 5)
    (tmp_path / "a.raw").write_bytes((tmp_path / "a.raw").read_bytes()[:-1])
    with pytest.raises(Exception, match="ends before byte"):
        frames.read_scans(spark, f"{tmp_path}/*.raw", frames.read_header(spark, f"{tmp_path}/*.hdr")).count()


def test_header(spark, tmp_path):
    (tmp_path / "a.hdr").write_text("ENVI\nsamples = 1600\nlines = 3194\nbands = 848\n")
    r = frames.read_header(spark, str(tmp_path)).first()
    assert (r.samples, r.lines, r.bands) == (1600, 3194, 848)


def test_nights_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "night string, x int")
    frames.write_nights(df, str(tmp_path / "t"))
    assert sorted(spark.read.parquet(str(tmp_path / "t")).select("night", "x").collect()) == sorted(df.collect())


def test_stack_wraps(spark):
    rows = spark.createDataFrame([(s, "n", 0, 0, 0, 40000) for s in range(2)], "scan_id int, night string, r int, c int, channel int, value int")
    assert stacks.stack(rows, wrap=True).first().value == 80000 - 65536
    assert stacks.stack(rows).first().value == 80000


def test_raster_rows_of_thousands_of_columns(spark, tmp_path):
    rng = np.random.default_rng(7)
    cells = {(int(r), int(c)): float(z) for r, c, z in zip(rng.integers(-3, 40, 4000), rng.integers(5, 5000, 4000), rng.random(4000), strict=True)}
    df = spark.createDataFrame([(r, c, z) for (r, c), z in cells.items()] + [(0, 5001, None)], "row int, col int, z double").repartition(3)
    maps.write_raster(df, str(tmp_path / "raster"))
    assert {(x.row, x.col): x.z for x in maps.read_raster(spark, str(tmp_path / "raster")).collect()} == cells
