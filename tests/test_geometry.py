"""Inverses undo projections; fits recover known transforms."""

from __future__ import annotations

import math
import random
import re

import pytest
from nightlights.functions import camera as cam
from nightlights.operators import learning, registration, world
from pyspark.sql import functions as F

CAMERA = cam.Camera(0.4, -0.3, 0.0, 5.0, 6.0, 40.0, 80.0)


def test_rays_meet_the_points_they_show(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a in (-7, 2, 9) for b in (-8, -3, 4)], "a double, b double")
    x, y = cam.at_height(CAMERA, F.col("a"), F.col("b"), F.lit(3.0))
    p = df.withColumns({"x": x, "y": y})
    across, up = cam.project(CAMERA, F.col("x"), F.col("y"), F.lit(3.0))
    for r in p.select("a", "b", across.alias("across"), up.alias("up")).collect():
        assert math.isclose(r.a, r.across, abs_tol=1e-6) and math.isclose(r.b, r.up, abs_tol=1e-6)


def test_similarity_recovers_a_transform(spark):
    a, b, dr, dc = 1.1 * math.cos(0.2), 1.1 * math.sin(0.2), 3.0, -4.0
    rows = [("f", k, float(r), float(c), a * r - b * c + dr, b * r + a * c + dc) for k, (r, c) in enumerate([(0, 0), (5, 1), (2, 9), (7, 7)])]
    got = registration.similarity(spark.createDataFrame(rows, "frame string, id int, r0 double, c0 double, r1 double, c1 double")).first()
    assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in ((got.a, a), (got.b, b), (got.dr, dr), (got.dc, dc), (got.theta, math.degrees(0.2))))


def test_last_pixel_wins(spark):
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 3)], "r int, c int, label int")
    got = {(r.r, r.c): r.label for r in registration.scatter_labels(labels, 0, 0, 0, 4, 4, factor=4.0).collect()}
    assert got == {(0, 0): 3}


def test_points_in_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 2), (0, 4))])
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.5, 3.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(world.contains(ring, F.col("x"), F.col("y"))).collect()] == [True, False, True, False]


def test_boundary_tiles(spark):
    tiles = spark.createDataFrame([("in", 1.0, 2.0, 1.0, 2.0), ("cut", 3.0, 6.0, 1.0, 2.0), ("around", -1.0, 9.0, -1.0, 9.0), ("out", 7.0, 8.0, 7.0, 8.0)], "t string, xmin double, xmax double, ymin double, ymax double")
    assert {r.t for r in world.tiles_on_boundary(tiles, [(0, 0), (5, 0), (5, 5), (0, 5)]).collect()} == {"in", "cut", "around"}


def test_mixture_prefers_two_groups(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, (60, 2)), rng.normal(3, 0.2, (60, 2))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "source int, spectrum array<double>")
    two, one, full = learning.mixture_bics(rows, [(2, "spherical"), (1, "spherical"), (2, "full")], 8)
    assert two < one and two < full  # the simpler covariance suffices
    s = x.std(0).mean()
    mean, var = x.mean(0), x.var(0).mean() + 1e-6
    want = -2 * sum(-0.5 * ((v - mean) ** 2).sum() / var - np.log(2 * np.pi * var) for v in x) + 3 * np.log(len(x))
    assert s > 1 and abs(one - want) < 1e-3 * abs(want)
    best = learning.choose_mixture(rows, (1, 2), ("spherical", "full"), 8).where("best").first()
    assert (best.k, best.covariance) == (2, "spherical")


def test_clusters_of_groups_far_apart(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in (0, 5, 10)])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "source int, spectrum array<double>")
    for found in (learning.kmeans(rows, 3), learning.gaussian_mixture(rows, 3), learning.dbscan(rows, 1.0, 4)):
        by = {}
        for r in found.collect():
            by.setdefault(r.cluster, set()).add(r.source // 40)
        assert sorted(map(sorted, by.values())) == [[0], [1], [2]]


def test_close_pairs_by_cells_and_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for x, eps in ((rng.uniform(0, 3, (150, 2)), 0.4), (np.repeat(rng.integers(0, 4, (20, 3)), 3, 0).astype(float), 1.0), (np.zeros((5, 4)), 0.1), (rng.normal(size=(1, 3)), 1.0)):
        rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "source int, spectrum array<double>").repartition(3)
        got = sorted((r.a, r.b) for r in learning.close_pairs(rows, eps, block=8).collect())
        assert got == sorted((i, j) for i in range(len(x)) for j in range(len(x)) if ((x[i] - x[j]) ** 2).sum() <= eps**2)
    assert learning.close_pairs(rows.where("false"), 1.0).count() == 0


def test_index_in_many_dimensions(spark):
    """Groups of spectra in 64 dimensions whose every axis overlaps: pivots leave a small share of the pairs to be compared."""
    import numpy as np

    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(0, 1, (30, 64)), 20, 0) + rng.normal(0, 0.01, (600, 64))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "source int, spectrum array<double>").repartition(3)
    r = learning.compared(rows, 0.3).first()
    assert r.pairs == 600 * 601 // 2 and r.compared < 0.15 * r.pairs
    got = sorted((r.a, r.b) for r in learning.close_pairs(rows, 0.3).collect())
    assert got == [(i, j) for i in range(600) for j in range(600) if i // 20 == j // 20]


def test_forest_learns_a_threshold(spark):
    import numpy as np

    x = np.random.default_rng(6).uniform(0, 1, (400, 2))
    rows = spark.createDataFrame([(k, v.tolist(), int(v[0] > 0.5)) for k, v in enumerate(x)], "id int, features array<double>, label int")
    parts = learning.split(rows)
    assert parts.where("train").count() == 300
    scores = learning.accuracy_f1(learning.classify(learning.train_forest(parts.where("train")), parts.where("NOT train"))).first()
    assert scores.accuracy > 0.9 and scores.f1 > 0.9


def test_frames_are_registered_to_a_catalogue(spark):
    """Blobs at the catalogue's places, moved as a whole, and one stray blob."""
    import numpy as np
    from nightlights.operators import registration

    places = [(20, 90), (40, 10), (75, 30), (30, 60), (60, 75), (85, 85), (50, 45)]
    catalog = spark.createDataFrame([(k, float(r), float(c)) for k, (r, c) in enumerate(places)], "k int, r double, c double")
    rows = []
    for frame, (dr, dc) in {"a": (3, -2), "b": (-4, 5)}.items():
        image = np.zeros((110, 110))
        for r, c in [*places, (100, 5)]:
            image[r + dr - 1 : r + dr + 2, c + dc - 1 : c + dc + 2] = 200
        rows += [(frame, int(r), int(c), float(image[r, c])) for r in range(110) for c in range(110)]
    frames = spark.createDataFrame(rows, "frame string, r int, c int, lum double")
    got = {r.frame: (round(r.dr, 3), round(r.dc, 3), round(r.theta, 3)) for r in registration.register_images(frames, 110, catalog, 5, 4, 30, buff=2, least_apart=50).collect()}
    assert got == {"a": (-3.0, 2.0, 0.0), "b": (4.0, -5.0, 0.0)}


def test_a_level_camera_looks_along_its_heading(spark):
    """Without tilt: across is to the left, up is height, both over the way ahead; kappa turns the heading."""
    at = lambda c, x, y, z: spark.range(1).select(*cam.project(c, F.lit(x), F.lit(y), F.lit(z))).first()
    got = at(cam.Camera(0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 80.0), 11.0, 4.0, 6.0)
    assert math.isclose(got[0], -80 * 2 / 10) and math.isclose(got[1], 80 * 3 / 10)
    k = 0.3
    ahead = at(cam.Camera(k, 0.0, 0.0, 1.0, 2.0, 3.0, 80.0), 1 + 10 * math.cos(k), 2 + 10 * math.sin(k), 6.0)
    assert math.isclose(ahead[0], 0.0, abs_tol=1e-9) and math.isclose(ahead[1], 24.0)


def test_state_plane_is_true_along_its_parallels(spark):
    """The origin has its false easting; along both standard parallels small steps east and north have their length on the ellipsoid."""
    plane, e2 = cam.StatePlane(), 0.0066943800229
    at = lambda lat, lon: spark.range(1).select(*plane.forward(F.lit(lat), F.lit(lon))).first()
    x, y = at(40 + 10 / 60, -74.0)
    assert math.isclose(x, 984250.0, abs_tol=1e-3) and math.isclose(y, 0.0, abs_tol=1e-3)
    h = 1e-4
    for lat in (40 + 40 / 60, 41 + 2 / 60):
        s = math.sin(math.radians(lat))
        prime = 6378137.0 / math.sqrt(1 - e2 * s * s)
        meridian = 6378137.0 * (1 - e2) / (1 - e2 * s * s) ** 1.5
        here, east, north = at(lat, -73.5), at(lat, -73.5 + h), at(lat + h, -73.5)
        foot = 1200 / 3937
        assert math.isclose(math.hypot(east[0] - here[0], east[1] - here[1]) * foot, prime * math.cos(math.radians(lat)) * math.radians(h), rel_tol=1e-6)
        assert math.isclose(math.hypot(north[0] - here[0], north[1] - here[1]) * foot, meridian * math.radians(h), rel_tol=1e-4)


def test_rays_skip_what_they_pass_above(spark, monkeypatch):
    """Towers on a plain, seen in tiles and squares of them, against every step of every ray."""
    import numpy as np
    from nightlights.functions.camera import Camera
    from nightlights.operators import world

    rng = np.random.default_rng(11)
    ground = np.where(rng.random((60, 50)) < 0.02, rng.uniform(5, 60, (60, 50)), rng.random((60, 50)))
    ground[40:, 30:] = np.nan  # no raster there
    camera = Camera(0.6, -0.35, 0.02, -20.0, -10.0, 40.0, 60.0)
    raster = spark.createDataFrame([(int(r), int(c), float(ground[r, c])) for r, c in np.argwhere(~np.isnan(ground))], "r int, c int, z double")
    pixels = spark.createDataFrame([(r, c) for r in range(20) for c in range(18)], "r int, c int")
    monkeypatch.setattr(world, "LEVEL", 3)
    got = {(x.r, x.c): (x.x, x.y, x.dist) for x in world.line_of_sight(pixels, raster, camera, 20, 18, (0.0, 0.0), 5, 150, 60, tile=7, stretch=4, share=50).collect()}
    slopes = pixels.select("r", "c", *[e.alias(n) for e, n in zip(world.ray_slopes(camera, world.F.col("c") - 9 + 1e-3, 10 - world.F.col("r") + 1e-3), ("ex", "ey"), strict=True)])
    hits = 0
    for p in slopes.collect():
        want = (0.0, 0.0, 0.0)
        for d in range(5, 150):
            dz = -d / np.sqrt(1 + p.ex**2 + p.ey**2)
            x, y = p.ex * dz + camera.x, p.ey * dz + camera.y
            r, c = int(np.rint(y)), int(np.rint(x))
            if 0 <= r < 60 and 0 <= c < 50 and ground[r, c] > dz + camera.z:
                want, hits = (x, y, np.hypot(x - camera.x, y - camera.y)), hits + 1
                break
        assert np.allclose(got[p.r, p.c], want)
    assert 0 < hits < 360


PAIRS = "frame string, id int, r0 double, c0 double, r1 double, c1 double"


def by_pairs(rows, ratio, every):
    """Mean ratio by frame, pair by pair."""
    out = {}
    for f in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == f]
        found = [ratio(math.hypot(a[2] - b[2], a[3] - b[3]), math.hypot(a[4] - b[4], a[5] - b[5])) for a in own for b in own if every or (None not in (a[1], b[1]) and a[1] < b[1])]
        found = [x for x in found if x is not None]
        if found:
            out[f] = sum(found) / len(found)
    return out


@pytest.mark.parametrize("tile", [2, 4096])
def test_ratios_of_all_pairs(spark, monkeypatch, tile):
    """In tiles, with equal points, repeated and null ids, and a frame of one point; pairs of equal target points have no scale factor
    that is a number, and no distance ratio."""
    monkeypatch.setattr(registration, "TILE", tile)
    monkeypatch.setattr(registration, "STEP", 16)
    rng = random.Random(6)
    rows = [("ab"[k % 2], k, *[float(rng.randint(0, 50)) for _ in range(4)]) for k in range(40)]
    rows += [("a", 4, 1.0, 1.0, 60.0, 61.0), ("a", 4, 2.0, 1.0, 60.0, 61.0), ("a", None, 9.0, 9.0, 70.0, 70.0), ("lone", 1, 0.0, 0.0, 0.0, 0.0)]
    rows += [("c", k, float(k // 2), 0.0, float(k // 2), 1.0) for k in range(8)] + [("d", k, float(k), 0.0, float(k // 2), 1.0) for k in range(8)]
    df = spark.createDataFrame(rows, PAIRS)
    scale = {r.frame: r.factor for r in registration.scale_factor(df).collect()}
    by_hand = by_pairs([x for x in rows if x[0] in "ab"], lambda ref, target: ref / target if target else math.inf if ref else math.nan, False)
    assert set(scale) == {"a", "b", "c", "d"} and math.isnan(scale["c"]) and scale["d"] == math.inf
    assert {f: scale[f] for f in "ab"} == pytest.approx(by_hand, nan_ok=True)
    aspects = spark.createDataFrame([(f, 2.0) for f in ("a", "b", "c", "d", "lone")], "frame string, aspect double")
    ratio = {r.frame: r.ratio for r in registration.distance_ratio(df, aspects).collect()}
    wide = [(f, i, r0, c0 / 2, r1, c1) for f, i, r0, c0, r1, c1 in rows]
    assert ratio == pytest.approx(by_pairs(wide, lambda ref, target: target / ref if target > 0 and ref else None, True) | {"lone": None})
    assert not re.search("BroadcastNestedLoopJoin|CartesianProduct", registration.distance_ratio(df, aspects)._jdf.queryExecution().toString())


def test_places_stand_for_equal_points(spark):
    """Copies of a frame's points make no more pairs."""
    rows = [("a", k, float(k % 5), float(k % 3), 2.0 * (k % 5), 3.0 * (k % 3)) for k in range(15)]
    once = spark.createDataFrame(rows, PAIRS)
    many = once.crossJoin(spark.range(20_000).toDF("copy")).withColumn("id", (F.col("copy") * 15 + F.col("id")).cast("int")).select(*once.columns)
    aspects = spark.createDataFrame([("a", 1.0)], "frame string, aspect double")
    want, got = (registration.distance_ratio(x, aspects).first().ratio for x in (once, many))
    assert got == pytest.approx(want)
