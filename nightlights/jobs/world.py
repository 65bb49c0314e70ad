"""Queries on world geometry and neighbourhood statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightlights.functions import camera as cam
from nightlights.jobs.stacks import STACK
from nightlights.operators import stacks
from nightlights.operators import world as op
from nightlights.registry import query

CAMERA = cam.Camera(0.6, -0.35, 0.02, -20.0, -10.0, 40.0, 60.0)
H, Wd, D = CAMERA.rows()


def slopes_sql(across: str, up: str) -> tuple[str, str]:
    p = [f"({d!r}::DOUBLE * ({across})::DOUBLE + {CAMERA.f * w!r}::DOUBLE)" for d, w in zip(D, Wd, strict=True)]
    q = [f"({d!r}::DOUBLE * ({up})::DOUBLE - {CAMERA.f * h!r}::DOUBLE)" for d, h in zip(D, H, strict=True)]
    det = f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"
    return f"(({p[1]} * {q[2]} - {p[2]} * {q[1]}) / {det})", f"(({p[2]} * {q[0]} - {p[0]} * {q[2]}) / {det})"


RASTER = "low AS (SELECT min(x) lx, min(y) ly FROM points), raster AS (SELECT round_even(y - ly, 0)::INT r, round_even(x - lx, 0)::INT c, avg(z) z FROM points, low GROUP BY 1, 2)"
BOUNDS = "bounds AS (SELECT tile, min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, min(z) zmin, max(z) zmax, avg(z) zmean, median(z) zmedian FROM points GROUP BY tile)"


def raster(v):
    return op.rasterise(v.points)


def lots(v):
    x, y = F.col("x"), F.col("y")
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((3.0, 0.0), (0.0, 3.0), (-3.0, 0.0), (0.0, -3.0))])
    return v.lots.select("bbl", F.col("bbl").alias("ord"), "x", "y", ring.alias("ring"))


@query("a27_tile_bounds", "points", f"{BOUNDS} --- SELECT * FROM bounds", "xmin xmax ymin ymax zmin zmax zmean zmedian")
def _(v):
    return op.tile_bounds(v.points)


@query("a28_extrema", "points", f"{BOUNDS} --- SELECT min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax, max(xmin) xorigin_max, max(ymin) yorigin_max FROM bounds", "xmin ymin xmax ymax xorigin_max yorigin_max")
def _(v):
    return op.extrema(op.tile_bounds(v.points))


@query("a29_rasterise", "points", f"{RASTER} --- SELECT * FROM raster", "z")
def _(v):
    return raster(v)


@query(
    "a30_mosaic", "points",
    "cells AS (SELECT tile, floor(y / 4)::INT r, floor(x / 8)::INT c, avg(z) z FROM points GROUP BY 1, 2, 3), o AS (SELECT DISTINCT tile, tile * 3.5 x0, (tile * 5) % 9 * 1.25 y0 FROM points), low AS (SELECT min(x0) lx, min(y0) ly FROM o) --- SELECT (r + 40 - 16 - floor(y0 - ly))::INT r, (c + floor(x0 - lx))::INT c, greatest(max(z), 0) z FROM cells JOIN o USING (tile), low GROUP BY 1, 2", "z",
)
def _(v):
    cells = v.points.groupBy("tile", F.floor(F.col("y") / 4).cast("int").alias("r"), F.floor(F.col("x") / 8).cast("int").alias("c")).agg(F.avg("z").alias("z"))
    origins = v.points.select("tile").distinct().select("tile", (F.col("tile") * 3.5).alias("x0"), ((F.col("tile") * 5) % 9 * 1.25).alias("y0"))
    return op.mosaic(cells, origins, 40, 16)


@query("a34_ring_bounds", "lots", "SELECT bbl AS id, x - 3 xmin, x + 3 xmax, y - 3 ymin, y + 3 ymax, x xcen, y ycen FROM lots", "xmin xmax ymin ymax xcen ycen")
def _(v):
    return op.ring_bounds(lots(v).select(F.col("bbl").alias("id"), "ring"))


@query("j5_tiles_inside", "points", f"{BOUNDS} --- SELECT tile FROM bounds WHERE xmin >= 0.9 AND xmax < 104.98 AND ymin >= 1 AND ymax < 50.5")
def _(v):
    return op.tiles_inside(op.tile_bounds(v.points), 0.9, 104.98, 1, 50.5).select("tile")


#: A triangle; it and a box are convex, so they are apart only if they are along a side's normal of one of them.
RING = [(0.0, 25.0), (120.0, 30.0), (60.0, 48.0)]
AXES = [(1.0, 0.0), (0.0, 1.0)] + [(q[1] - p[1], p[0] - q[0]) for p, q in zip(RING, RING[1:] + RING[:1], strict=True)]


def small_tiles(v):
    """Boxes of the points by parts of tiles."""
    part = F.concat_ws("-", "tile", F.floor(F.col("x") / 20).cast("int"), F.floor(F.col("y") / 10).cast("int"))
    return op.tile_bounds(v.points.withColumn("tile", part))


@query(
    "j5_tiles_on_boundary", "points",
    f"""box AS (SELECT tile || '-' || floor(x / 20)::INT || '-' || floor(y / 10)::INT tile, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM points GROUP BY 1), axis(nx, ny) AS (VALUES {", ".join(map(str, AXES))}),
    side AS (SELECT nx, ny, min(nx * x + ny * y) lo, max(nx * x + ny * y) hi FROM axis, (VALUES {", ".join(map(str, RING))}) v(x, y) GROUP BY nx, ny),
    apart AS (SELECT DISTINCT tile FROM box, side WHERE greatest(nx * x0, nx * x1) + greatest(ny * y0, ny * y1) < lo OR least(nx * x0, nx * x1) + least(ny * y0, ny * y1) > hi)
    --- SELECT tile FROM box WHERE tile NOT IN (SELECT tile FROM apart)""",
)
def _(v):
    return op.tiles_on_boundary(small_tiles(v), RING).select("tile")


@query("j6_lots_of_places", "points places lots", "SELECT p.x, p.y, coalesce(max(bbl), 0) bbl FROM places p LEFT JOIN lots l ON abs(p.x - l.x) + abs(p.y - l.y) < 3 GROUP BY p.x, p.y", "x y")
def _(v):
    return op.lots_of_places(v.places, lots(v), 6)


_EX, _EY = slopes_sql("c - n // 2 + 0.001", "12 // 2 - r + 0.001")


@query(
    "j10_line_of_sight", "points lots",
    f"""{RASTER}, px AS (SELECT a r, bbl - 1 c, (SELECT count(*) FROM lots) n FROM range(12) x(a), lots), ray AS (SELECT r, c, {_EX} ex, {_EY} ey FROM px), far AS (SELECT r, c, d, ex, ey, -d / sqrt(1 + ex * ex + ey * ey) dz FROM ray, range(10, 110) t(d)),
    pt AS (SELECT r, c, ex * dz + {CAMERA.x} x, ey * dz + {CAMERA.y} y, dz + {CAMERA.z} z FROM far), hit AS (SELECT pt.r, pt.c, x, y, sqrt((x - {CAMERA.x}) ** 2 + (y - {CAMERA.y}) ** 2) dist FROM pt, low JOIN raster g ON g.r = round_even(y - ly, 0)::INT AND g.c = round_even(x - lx, 0)::INT WHERE g.z > pt.z)
    --- SELECT px.r::INT r, px.c::INT c, coalesce(arg_min(x, dist), 0) x, coalesce(arg_min(y, dist), 0) y, coalesce(min(dist), 0) dist FROM px LEFT JOIN hit ON hit.r = px.r AND hit.c = px.c GROUP BY px.r, px.c""", "x y dist",
)
def _(v):
    """An image with a column for each lot."""
    pixels = v.lots.select((F.col("bbl") - 1).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("r")).select("r", "c")
    low = v.points.agg(F.min("x"), F.min("y")).first()
    return op.line_of_sight(pixels, raster(v), CAMERA, 12, v.lots.count(), (low[0], low[1]), 10, 110, 40, tile=16, stretch=8, share=50)


def _linear(row: tuple[float, float, float]) -> str:
    return f"({row[0]!r} * (x - {CAMERA.x}) + {row[1]!r} * (y - {CAMERA.y}) + {row[2]!r} * (z - {CAMERA.z}))"


@query("g2_project", "places", f"p AS (SELECT x, y, (x + y) % 7 z FROM places) --- SELECT x, y, -{CAMERA.f} * {_linear(Wd)} / {_linear(D)} across, {CAMERA.f} * {_linear(H)} / {_linear(D)} up FROM p", "x y across up", 4)
def _(v):
    across, up = cam.project(CAMERA, F.col("x"), F.col("y"), (F.col("x") + F.col("y")) % 7)
    return v.places.select("x", "y", across.alias("across"), up.alias("up"))


_GX, _GY = slopes_sql("c - 8", "8 - r")


@query("g3_at_height", "labels", f"SELECT r, c, {_GX} * (2.5 - {CAMERA.z}) + {CAMERA.x} x, {_GY} * (2.5 - {CAMERA.z}) + {CAMERA.y} y FROM labels", "x y")
def _(v):
    x, y = cam.at_height(CAMERA, F.col("c") - 8, 8 - F.col("r"), F.lit(2.5))
    return v.labels.select("r", "c", x.alias("x"), y.alias("y"))


_RX, _RY = slopes_sql("c - 8 + 0.001", "8 - r + 0.001")


@query("g3_at_distance", "labels", f"s AS (SELECT r, c, {_RX} ex, {_RY} ey FROM labels), d AS (SELECT *, -30 / sqrt(1 + ex * ex + ey * ey) dz FROM s) --- SELECT r, c, ex * dz + {CAMERA.x} x, ey * dz + {CAMERA.y} y, dz + {CAMERA.z} z FROM d", "x y z")
def _(v):
    x, y, z = cam.at_distance(CAMERA, F.col("c") - 8, 8 - F.col("r"), F.lit(30.0))
    return v.labels.select("r", "c", x.alias("x"), y.alias("y"), z.alias("z"))


@query("g4_spherical", "labels", "SELECT r, c, (label - 0.5) * sin(pi() / 2 - (c / 10.0 - 0.2)) * cos(r / 5.0) x, (label - 0.5) * sin(pi() / 2 - (c / 10.0 - 0.2)) * sin(r / 5.0) y, (label - 0.5) * cos(pi() / 2 - (c / 10.0 - 0.2)) z FROM labels", "x y z")
def _(v):
    x, y, z = cam.spherical(F.col("label"), F.col("r") / 5.0, F.col("c") / 10.0, 0.5, 0.0, 0.2)
    return v.labels.select("r", "c", x.alias("x"), y.alias("y"), z.alias("z"))


@query("g5_centre_points", "labels", "SELECT r, c, c - 7 AS x, 8 - r AS y FROM labels")
def _(v):
    x, y = cam.centre_points(F.col("c"), F.col("r"), 15, 16)
    return v.labels.select("r", "c", x.alias("x"), y.alias("y"))


PLANE = cam.StatePlane()
_S = f"({PLANE.e!r} * sin(radians(lat)))"
LCC = f"q AS (SELECT x AS px, y AS py, 40.5 + y / 100 lat, -74.2 + x / 200 lon FROM places), rho AS (SELECT *, {PLANE.scale!r} * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_S}) / (1 + {_S}), {PLANE.e / 2!r}), {PLANE.n!r}) rho, {PLANE.n!r} * radians(lon + 74) turn FROM q)"


@query("g6_state_plane", "places", f"{LCC} --- SELECT px, py, (300000 + rho * sin(turn)) / {PLANE.FOOT!r} x, ({PLANE.rho0!r} - rho * cos(turn)) / {PLANE.FOOT!r} y FROM rho", "px py x y", 3)
def _(v):
    x, y = PLANE.forward(40.5 + F.col("y") / 100, -74.2 + F.col("x") / 200)
    return v.places.select(F.col("x").alias("px"), F.col("y").alias("py"), x.alias("x"), y.alias("y"))


@query("g6_back", "places", "SELECT x AS px, y AS py, 40.5 + y / 100 lat, -74.2 + x / 200 lon FROM places", "px py lat lon", 5)
def _(v):
    x, y = PLANE.forward(40.5 + F.col("y") / 100, -74.2 + F.col("x") / 200)
    lat, lon = PLANE.inverse(x, y)
    return v.places.select(F.col("x").alias("px"), F.col("y").alias("py"), lat.alias("lat"), lon.alias("lon"))


def lisa_sql(grid: str, name: str, reach: int = 3) -> str:
    """Common tables of the index on a grid (k, r, c, v)."""
    return f"""{name}z AS (SELECT k, r, c, v - avg(v) OVER (PARTITION BY k) z, var_pop(v) OVER (PARTITION BY k) m2 FROM {grid}),
    {name} AS (SELECT a.k, a.r, a.c, a.z / any_value(a.m2) * sum((1 - ((b.r - a.r) ** 2 + (b.c - a.c) ** 2) / {2.0 * reach * reach}) ** 2 * b.z) lisa FROM {name}z a JOIN {name}z b ON b.k = a.k AND abs(b.r - a.r) < {reach} AND abs(b.c - a.c) < {reach} AND NOT (a.r = b.r AND a.c = b.c) GROUP BY a.k, a.r, a.c, a.z)"""


def shuffle_sql(grid: str, name: str, seed: str) -> str:
    return f"""{name}i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, c) i, row_number() OVER (PARTITION BY k ORDER BY md5('{seed}/' || r || '/' || c)) j FROM {grid}),
    {name} AS (SELECT a.k, a.r, a.c, b.v FROM {name}i a JOIN {name}i b ON a.k = b.k AND a.j = b.i)"""


GRID = STACK + ", grid AS (SELECT 0 k, r, c, avg(value) v FROM stack GROUP BY r, c)"
SIGN = "sg AS (SELECT k, avg(lisa) m, stddev_pop(lisa) s FROM lp GROUP BY k), sig AS (SELECT k, r, c, lisa, (lisa - m) / s zscore, NOT ((lisa - m) / s < 0.96012 AND (lisa - m) / s > -0.96012) significant FROM l JOIN sg USING (k))"


def luminosity(v):
    return stacks.luminosity(stacks.stack(v.scans)).withColumnRenamed("lum", "v")


@query("l1_lisa", "scans", f"{GRID}, {lisa_sql('grid', 'l')} --- SELECT r, c, lisa FROM l", "lisa")
def _(v):
    return op.lisa(luminosity(v), reach=3)


@query("l1_channel_lisa", "scans", f"{STACK}, grid AS (SELECT channel k, r, c, value v FROM stack), {lisa_sql('grid', 'l')} --- SELECT k AS channel, r, c, lisa FROM l", "lisa")
def _(v):
    return op.lisa(stacks.stack(v.scans), ["channel"], "value", 3, tile=6)


@query("l2_significance", "scans", f"{GRID}, {lisa_sql('grid', 'l')}, {shuffle_sql('grid', 'pg', '0')}, {lisa_sql('pg', 'lp')}, {SIGN} --- SELECT r, c, lisa, zscore, significant FROM sig", "lisa zscore")
def _(v):
    return op.lisa_significance(luminosity(v), reach=3)


@query("l3_spectral_lisa", "scans", f"{STACK}, grid AS (SELECT channel k, r, c, value v FROM stack), {lisa_sql('grid', 'l')}, {shuffle_sql('grid', 'pg', '0')}, {lisa_sql('pg', 'lp')}, {SIGN} --- SELECT r, c, avg(CASE WHEN significant THEN lisa ELSE 0 END) lisa FROM sig GROUP BY r, c", "lisa")
def _(v):
    return op.spectral_lisa(stacks.stack(v.scans), 3)
