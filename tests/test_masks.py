"""Components, growth and detection by hand."""

from __future__ import annotations

import time

import numpy as np
from nightlights.operators import masks as op
from nightlights.operators import rows as vectors
from pyspark.sql import functions as F


def cells(spark, text):
    rows = [(r, c) for r, line in enumerate(text.split()) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(rows, "r int, c int")


def test_components_of_a_u_and_a_diagonal(spark):
    got = {(r.r, r.c): r.label for r in op.label_components(cells(spark, "#.#.. #.#.. ###.. ...#. ....#"), 5).collect()}
    assert {got[0, 0], got[2, 1], got[0, 2]} == {1}
    assert (got[3, 3], got[4, 4]) == (2, 3)


def test_components_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(int(r), int(c)) for r, c in np.argwhere(rng.random((20, 20)) < 0.55)]
    m = spark.createDataFrame(rows, "r int, c int")
    assert sorted(op.label_components(m.coalesce(1), 20).collect()) == sorted(op.label_components(m.repartition(5), 20).collect())


def grow(grid, least):
    """The same growth, shift by shift."""
    sizes = {k: (grid == k).sum() for k in np.unique(grid) if k}
    keep = np.where(np.isin(grid, [k for k, n in sizes.items() if n > least]), grid, 0)
    h, w = grid.shape
    at = lambda r, c: keep[r, c] if 0 <= r < h and 0 <= c < w else 0
    left = np.zeros_like(keep)
    for r in range(h):
        for c in range(w):
            left[r, c] = at(r, c) or at(r - 1, c) or at(r, c - 1) or (at(r - 1, c - 1) if c else 0)
    out = left.copy()
    for r in range(h - 1):
        for c in range(w):
            if not left[r, c]:
                out[r, c] = left[r + 1, c]
    return out


def test_growth(spark):
    rng = np.random.default_rng(4)
    grid = np.where(rng.random((12, 12)) < 0.3, rng.integers(1, 5, (12, 12)), 0)
    rows = [(int(r), int(c), int(grid[r, c])) for r, c in np.argwhere(grid)]
    got = np.zeros_like(grid)
    for r in op.grow_labels(spark.createDataFrame(rows, "r int, c int, label int"), 12, 12, 3).collect():
        got[r.r, r.c] = r.label
    assert (got == grow(grid, 3)).all()


def test_identical_pixels_correlate(spark):
    rows = [("n", t, 0, c, float(t % 3)) for t in range(9) for c in range(2)]
    got = op.neighbour_correlation(spark.createDataFrame(rows, "night string, obs_idx int, r int, c int, lum double")).collect()
    assert len(got) == 1 and abs(got[0]["corr"] - 1) < 1e-9


def frames_of(rng, nights, times, rows, cols, gaps=0.1):
    return [(n, t, r, c, float(rng.integers(0, 200))) for n in nights for t in range(times) for r in range(rows) for c in range(cols) if rng.random() > gaps]


def pairs_of(pixels):
    at = {p[:4]: p[4] for p in pixels}
    return [(n, t, side, r, c, x, at[n, t, r + dr, c + dc]) for (n, t, r, c), x in at.items() for side, dr, dc in (("right", 0, 1), ("down", 1, 0)) if (n, t, r + dr, c + dc) in at]


SCHEMA = "night string, obs_idx int, r int, c int, lum double"


def test_neighbours_across_bands_and_batches(spark):
    pixels = frames_of(np.random.default_rng(1), ["a", "b"], 2, 2 * vectors.BAND + 3, 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = vectors.neighbours(spark.createDataFrame(pixels, SCHEMA).repartition(7), ["night", "obs_idx"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted(pairs_of(pixels))


def test_correlations_by_rows(spark):
    """Cells and whole rows give what pairs of pixels give; a pixel that never changes correlates with none."""
    rng = np.random.default_rng(3)
    pixels = [(*p[:4], 7.3 if p[2:4] == (1, 1) else p[4]) for p in frames_of(rng, ["a", "b"], 6, vectors.BAND + 2, 5, 0.2)]
    series = {}
    for n, _, side, r, c, x, y in pairs_of(pixels):
        series.setdefault((r, c, side), {}).setdefault(n, []).append((x, y))
    want = {}
    for k, nights in series.items():
        q = [(len(v), np.corrcoef(np.array(v).T)[0, 1] if min(np.std(v, axis=0)) > 1e-6 else 0.0) for v in nights.values()]
        want[k] = sum(n * x for n, x in q) / sum(n for n, _ in q)
    df = spark.createDataFrame(pixels, SCHEMA)
    whole = df.groupBy("night", "obs_idx", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "lum"))).alias("m")).select("night", "obs_idx", "r", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.try_element_at("m", c)).alias("lum"))
    for given in (df, whole, df.withColumn("night", F.when(F.lit(True), F.col("night")))):
        got = {(x.r, x.c, x.side): x["corr"] for x in op.neighbour_correlation(given).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert want[1, 1, "right"] == want[0, 1, "down"] == 0


def test_time_is_linear_in_the_columns(spark):
    """No step compares the pixels of a row with each other: rows of 4,096 pixels cost what their pixels do."""
    wide = spark.range(4096 * 40).select(F.lit("n").alias("night"), (F.col("id") % 2).cast("int").alias("obs_idx"), (F.floor(F.col("id") / 2) % 20).cast("int").alias("r"), F.floor(F.col("id") / 40).cast("int").alias("c"), F.rand(1).alias("lum"))
    began = time.time()
    assert op.neighbour_correlation(wide).count() == 20 * 4095 + 19 * 4096
    assert time.time() - began < 60


def test_medians_by_counts(spark):
    """Rows of bytes with gaps, odd and even numbers of frames, widths of their own."""
    rng = np.random.default_rng(8)
    frames = [(t, r, [None if rng.random() < 0.2 else int(x) for x in rng.integers(0, 256, 9 + r % 3)]) for t in range(7) for r in range(5)]
    got = {(x.r, x.c): x.lum for x in vectors.median_rows(spark.createDataFrame(frames, "obs_idx int, r int, lum array<smallint>").repartition(4)).collect()}
    seen = {}
    for _, r, row in frames:
        for c, x in enumerate(row):
            if x is not None:
                seen.setdefault((r, c), []).append(x)
    assert got == {k: float(np.median(v)) for k, v in seen.items()}


def test_colour_fractions_of_rows_and_cells(spark):
    rng = np.random.default_rng(9)
    frames = [("n", t, r, [int(x) for x in rng.integers(0, 256, 8)]) for t in range(6) for r in range(6)]
    rows = spark.createDataFrame(frames, "night string, obs_idx int, r int, lum array<smallint>")
    labels = spark.createDataFrame([(r, c, 1 + (r + c) % 3) for r in range(6) for c in range(8)], "r int, c int, label int")
    cells = rows.select("night", "obs_idx", "r", F.posexplode("lum").alias("c", "lum"))
    whole = lambda df: sorted((x.source, round(x.red, 9), round(x.green, 9), round(x.blue, 9)) for x in op.colour_fractions(df, labels, 5, 2).collect())
    assert whole(rows) == whole(cells)


def test_painted_rows_and_pixels(spark):
    """Against pixels painted one by one; a source without a curve, a frame without some, labels beside the grid and a wide source."""
    rng = np.random.default_rng(4)
    nrow, ncol = 12, 300
    labels = {(int(r), int(c)): int(x) for r, c, x in zip(rng.integers(0, 9, 900), rng.integers(0, ncol, 900), rng.integers(1, 30, 900), strict=True)} | {(9, c): 77 for c in range(ncol)}
    curves = {(n, t, s): float(rng.random()) for n in "ab" for t in range(4) for s in (*range(1, 25), 77, 99) if (s + t) % 5}
    image = spark.createDataFrame([(r, c, x) for (r, c), x in labels.items()] + [(3, ncol, 1), (3, -1, 2), (4, 2 * ncol, None)], "r int, c int, label int").repartition(3)
    light = spark.createDataFrame([(*k, v) for k, v in curves.items()] + [("a", 0, 26, None)], "night string, obs_idx int, source int, lum double").repartition(3)
    got = op.paint_curves(image, light, nrow, ncol).collect()
    want = {(n, t, r, c): curves.get((n, t, labels.get((r, c))), 0.0) for n in "ab" for t in range(4) for r in range(nrow) for c in range(ncol)}
    assert len(got) == len(want) and {(x.night, x.obs_idx, x.r, x.c): x.lum for x in got} == want
    rows = {(x.night, x.obs_idx, x.r) for x in vectors.painted_rows(image, light, ncol).collect()}
    assert rows == {(n, t, r) for (n, t, s) in curves for (r, _), x in labels.items() if x == s}
    assert op.paint_curves(image, light.where("false"), nrow, ncol).count() == 0
    assert not any(x.lum for x in op.paint_curves(image.where("false"), light, 2, 3).collect())
