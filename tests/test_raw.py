"""Raw cubes: bytes of the layout, commits, aborts, and what is refused."""

from __future__ import annotations

import numpy as np
import pytest
from nightlights.operators import stacks
from nightlights.sources import frames, raw
from pyspark.sql import functions as F

SCHEMA = "scan string, r int, c int, spectrum array<int>"


def pixels(spark, cubes):
    """cubes (rows, channels, columns) by name, as shuffled rows."""
    rows = [(k, r, c, x[r, :, c].tolist()) for k, x in cubes.items() for r in range(x.shape[0]) for c in range(x.shape[2])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5, F.rand(3))


def some(seed, cols, rows=6, channels=4):
    return np.random.default_rng(seed).integers(0, 65536, (rows, channels, cols))


def layout(cube):
    return cube.astype("<u2").transpose(2, 1, 0)[:, :, ::-1].tobytes()


def files(path):
    return sorted(x.name for x in path.iterdir()) if path.exists() else []


def test_bytes_and_round_trip(spark, tmp_path):
    cubes = {"a": some(1, 9), "b.c": some(2, 3), "one": some(3, 1)}
    raw.write_raw_cubes(pixels(spark, cubes), f"file://{tmp_path}/out", 6, 4, waves=[400.5, 1e3, 7, 8.25])
    out = tmp_path / "out"
    assert files(out) == sorted(f"{k}.{x}" for k in cubes for x in ("raw", "hdr"))
    for k, x in cubes.items():
        assert (out / f"{k}.raw").read_bytes() == layout(x)
    heads = frames.read_header(spark, f"{out}/*.hdr")
    got = {(r.scan.rpartition("/")[2][:-4], r.r, r.c): r.spectrum for r in frames.read_scans(spark, f"{out}/*.raw", heads).collect()}
    assert got == {(k, r, c): x[r, :, c].tolist() for k, x in cubes.items() for r in range(6) for c in range(x.shape[2])}
    waves = frames.read_wavelengths(spark, f"{out}/*.hdr").where(F.col("scan").endswith("one.hdr")).orderBy("channel").collect()
    assert [(w.channel, w.wavelength) for w in waves] == [(0, 400.5), (1, 1000.0), (2, 7.0), (3, 8.25)]


def test_gaps_are_zero(spark, tmp_path):
    rows = [("s", 2, 3, [5, None, 7]), ("s", 0, 1, None), ("s", 1, 3, []), ("s", 0, 3, [9])]
    raw.write_raw_cubes(spark.createDataFrame(rows, SCHEMA), str(tmp_path), 3, 3, lines=6)
    want = np.zeros((3, 3, 6), int)
    want[2, :, 3], want[0, 0, 3] = (5, 0, 7), 9
    assert (tmp_path / "s.raw").read_bytes() == layout(want)


def test_empty_table_writes_nothing(spark, tmp_path):
    raw.write_raw_cubes(spark.createDataFrame([], SCHEMA), str(tmp_path), 3, 3)
    assert files(tmp_path) == []


@pytest.mark.parametrize(
    "bad",
    [
        ("s", 0, 0, [65536]), ("s", 0, 0, [-1]), ("s", 0, 0, [1] * 5), ("s", 6, 0, [1]), ("s", -1, 0, [1]), ("s", None, 0, [1]), ("s", 0, None, [1]), ("s", 0, -1, [1]), ("s", 0, 9, [1]),
        (None, 0, 0, [1]), ("", 0, 0, [1]), ("../s", 0, 0, [1]), (".s", 0, 0, [1]), ("good", 0, 0, [1]),
    ],
)
def test_one_bad_row_leaves_nothing(spark, tmp_path, bad):
    """Columns written by other tasks before are taken back too; the last case gives a pixel twice."""
    every = pixels(spark, {"good": some(1, 9)}).union(spark.createDataFrame([bad], SCHEMA))
    with pytest.raises(Exception, match="column|can't name a file"):
        raw.write_raw_cubes(every, str(tmp_path), 6, 4, lines=9)
    assert files(tmp_path) == []


def test_what_is_there_stays_until_the_commit(spark, tmp_path):
    old, new, other = some(1, 9), some(2, 5), some(3, 2)
    raw.write_raw_cubes(pixels(spark, {"a": old, "z": other}), str(tmp_path), 6, 4)
    with pytest.raises(Exception, match="has a scan a"):
        raw.write_raw_cubes(pixels(spark, {"a": new, "b": new}), str(tmp_path), 6, 4)
    with pytest.raises(Exception, match="twice"):
        raw.write_raw_cubes(pixels(spark, {"a": new}).union(pixels(spark, {"a": new})), str(tmp_path), 6, 4, overwrite=True)
    assert (tmp_path / "a.raw").read_bytes() == layout(old) and files(tmp_path) == ["a.hdr", "a.raw", "z.hdr", "z.raw"]
    raw.write_raw_cubes(pixels(spark, {"a": new}), str(tmp_path), 6, 4, overwrite=True)
    assert (tmp_path / "a.raw").read_bytes() == layout(new) and (tmp_path / "z.raw").read_bytes() == layout(other)
    assert frames.read_header(spark, f"{tmp_path}/a.hdr").first().lines == 5


def test_tasks_that_run_again(tmp_path):
    """The second attempt of a task, whose first was lost halfway, gives the same file; a column in two tasks' messages is refused."""
    import pyarrow as pa

    cube = some(5, 4)
    w = raw.CubeWriter({"path": str(tmp_path), "samples": "6", "bands": "4"}, False)
    types = pa.schema([("scan", pa.string()), ("r", pa.int32()), ("c", pa.int32()), ("spectrum", pa.list_(pa.int32()))])

    def task(cs):
        rows = [{"scan": "s", "r": r, "c": c, "spectrum": cube[r, :, c].tolist()} for c in cs for r in range(6)]
        return [pa.RecordBatch.from_pylist(rows[k : k + 7], types) for k in range(0, len(rows), 7)]

    def lost(batches):
        yield from batches[:2]
        raise OSError("lost")

    with pytest.raises(OSError):
        w.write(lost(task([1, 3])))
    first, second = w.write(iter(task([1, 3]))), w.write(iter(task([0, 2])))
    with pytest.raises(ValueError, match="several tasks"):
        w.commit([first, second, w.write(iter(task([2])))])
    w.commit([first, second, None])
    assert (tmp_path / "s.raw").read_bytes() == layout(cube) and files(tmp_path) == ["s.hdr", "s.raw"]


def test_stores_without_places(spark):
    with pytest.raises(ValueError, match="at a place"):
        raw.write_raw_cubes(spark.createDataFrame([], SCHEMA), "s3a://bucket/x", 3, 3)


def test_wavelengths_of_odd_headers(spark, tmp_path):
    (tmp_path / "a.hdr").write_text("ENVI\nbands = 2\nWavelength Units = nm\nWavelength = {\n 400.25 , x\r\n5e2}\n600,\n}\n")
    (tmp_path / "no_list.hdr").write_text("bands = 2\n")
    (tmp_path / "no_bands.hdr").write_text("Wavelength = {\n1\n")
    (tmp_path / "short.hdr").write_text("Bands=3\nWavelength\n1\nx")
    (tmp_path / "empty.hdr").write_text("")
    got = sorted((r.scan.rpartition("/")[2], r.channel, r.wavelength) for r in frames.read_wavelengths(spark, f"{tmp_path}/*.hdr").collect())
    assert got == [("a.hdr", 0, 400.25), ("a.hdr", 1, 500.0), ("short.hdr", 0, 1.0), ("short.hdr", 1, None)]


def test_stacks_by_night(spark):
    rows = [(1, "n", 0, 0, [40000, 1]), (2, "n", 0, 0, [40000]), (1, "n", 0, 1, [5, 6]), (3, "m", 0, 1, [3, None])]
    df = spark.createDataFrame(rows, "scan_id int, night string, r int, c int, spectrum array<int>")
    got = {(r.night, r.r, r.c): r.spectrum for r in stacks.stacked_spectra(df, ["night"], wrap=True).collect()}
    assert got == {("n", 0, 0): [80000 - 65536, 1], ("m", 0, 1): [3, 0]}
