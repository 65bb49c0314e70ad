"""Points, rasters, lots and lines of sight in world coordinates; neighbourhood statistics on grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightlights.functions.camera import Camera, ray_slopes
from nightlights.operators.ranks import numbered
from nightlights.runtime import materialize


def tile_bounds(points: DataFrame) -> DataFrame:
    ends = [f(a).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy("tile").agg(*ends, F.avg("z").alias("zmean"), F.median("z").alias("zmedian"))


def extrema(bounds: DataFrame) -> DataFrame:
    """Footprint of all tiles, and least and largest origin."""
    return bounds.agg(*[F.min(f"{a}min").alias(f"{a}min") for a in "xy"], *[F.max(f"{a}max").alias(f"{a}max") for a in "xy"], *[F.max(f"{a}min").alias(f"{a}origin_max") for a in "xy"])


def rasterise(points: DataFrame) -> DataFrame:
    """(r, c, z): mean height of the points of each cell of unit size, cells rounded half to even from the least x and y.
    Cells without points are absent; the mean combines before the shuffle, so dense cells don't matter."""
    low = points.agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    return points.crossJoin(low).groupBy(F.bround(F.col("y") - F.col("_y")).cast("int").alias("r"), F.bround(F.col("x") - F.col("_x")).cast("int").alias("c")).agg(F.avg("z").alias("z"))


def mosaic(cells: DataFrame, origins: DataFrame, nrow: int, size: int = 2048) -> DataFrame:
    """(r, c, z): tiles (tile, r, c, z) placed by their origins (tile, x0, y0), the highest where they overlap, 0 at least."""
    low = origins.agg(F.min("x0").alias("_x"), F.min("y0").alias("_y"))
    at = origins.crossJoin(low).select("tile", (nrow - size - F.floor(F.col("y0") - F.col("_y"))).cast("int").alias("dr"), F.floor(F.col("x0") - F.col("_x")).cast("int").alias("dc"))
    return cells.join(at, "tile").groupBy((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).agg(F.greatest(F.max("z"), F.lit(0.0)).alias("z"))


def ring_bounds(rings: DataFrame) -> DataFrame:
    """id, box and area centroid of each ring of (x, y), closed or not, by shoelace sums over its edges."""
    edges = F.transform("ring", lambda p, i: F.struct(p.alias("p"), F.element_at("ring", (i + 1) % F.size("ring") + 1).alias("q")))
    e = rings.select("id", F.explode(edges).alias("e")).select("id", "e.p", "e.q").withColumn("w", F.col("p.x") * F.col("q.y") - F.col("q.x") * F.col("p.y"))
    area = F.sum("w") * 3
    return e.groupBy("id").agg(F.min("p.x").alias("xmin"), F.max("p.x").alias("xmax"), F.min("p.y").alias("ymin"), F.max("p.y").alias("ymax"), F.try_divide(F.sum((F.col("p.x") + F.col("q.x")) * F.col("w")), area).alias("xcen"), F.try_divide(F.sum((F.col("p.y") + F.col("q.y")) * F.col("w")), area).alias("ycen"))


def tiles_inside(tiles: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Tiles wholly in the region, its upper ends excluded."""
    return tiles.where((F.col("xmin") >= xmin) & (F.col("xmax") < xmax) & (F.col("ymin") >= ymin) & (F.col("ymax") < ymax))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring of (x, y) contains the point: an odd number of its edges crosses the ray to the right."""

    def crossing(i: Column) -> Column:
        p, q = F.element_at(ring, i + 1), F.element_at(ring, (i + 1) % F.size(ring) + 1)
        spans = (p["y"] > y) != (q["y"] > y)
        return F.when(spans, (x < (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0), lambda n, i: n + crossing(i)) % 2 == 1


def tiles_on_boundary(tiles: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Tiles whose box meets the polygon: a corner of the box inside, a vertex in the box, or an edge across it."""
    poly = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    box = [F.col(c).cast("double") for c in ("xmin", "xmax", "ymin", "ymax")]
    corner = contains(poly, box[0], box[2]) | contains(poly, box[1], box[2]) | contains(poly, box[0], box[3]) | contains(poly, box[1], box[3])
    vertex = F.exists(poly, lambda p: (p["x"] >= box[0]) & (p["x"] <= box[1]) & (p["y"] >= box[2]) & (p["y"] <= box[3]))
    side = lambda ax, ay, bx, by, px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)

    def cuts(i: Column) -> Column:
        p, q = F.element_at(poly, i + 1), F.element_at(poly, (i + 1) % len(ring) + 1)
        out = F.lit(False)
        for a, b in (((0, 2), (1, 2)), ((1, 2), (1, 3)), ((1, 3), (0, 3)), ((0, 3), (0, 2))):
            ax, ay, bx, by = box[a[0]], box[a[1]], box[b[0]], box[b[1]]
            out = out | ((side(ax, ay, bx, by, p["x"], p["y"]) * side(ax, ay, bx, by, q["x"], q["y"]) <= 0) & (side(p["x"], p["y"], q["x"], q["y"], ax, ay) * side(p["x"], p["y"], q["x"], q["y"], bx, by) <= 0))
        return out

    return tiles.where(corner | vertex | F.exists(F.sequence(F.lit(0), F.lit(len(ring) - 1)), cuts))


def lots_of_places(places: DataFrame, lots: DataFrame, reach: float = 500, cell: float | None = None) -> DataFrame:
    """(x, y, bbl): the lot that contains each place, the last in the order of ord if several do, 0 if none.

    lots: (bbl, ord, x, y, ring), x and y the centre. Only lots within reach are tried. A lot lies under the cells of a grid, a
    quarter of reach wide unless cell says otherwise, that the box of its ring covers as far as reach goes; a place under its own.
    A ring's edges are walked only where its box has the place.
    """
    size = cell or reach / 4
    at = lambda c: F.floor(c / size)
    ends = [f(F.transform("ring", (lambda c: lambda p: p[c])(c))).alias(f"{c}{n}") for c in "xy" for f, n in ((F.array_min, "0"), (F.array_max, "1"))]
    boxed = lots.select("bbl", "ord", F.col("x").alias("lx"), F.col("y").alias("ly"), "ring", *ends)
    span = lambda c: F.sequence(at(F.greatest(f"{c}0", F.col(f"l{c}") - reach)), at(F.least(f"{c}1", F.col(f"l{c}") + reach)))
    met = boxed.where((F.abs(F.greatest("x0", F.least("x1", "lx")) - F.col("lx")) < reach) & (F.abs(F.greatest("y0", F.least("y1", "ly")) - F.col("ly")) < reach))
    wide = met.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
    own = places.select("x", "y").distinct().withColumns({"gx": at(F.col("x")), "gy": at(F.col("y"))})
    hit = own.join(wide, ["gx", "gy"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").where((F.col("x") - F.col("lx")) ** 2 + (F.col("y") - F.col("ly")) ** 2 < reach**2).where(contains(F.col("ring"), F.col("x"), F.col("y")))
    best = hit.groupBy("x", "y").agg(F.max_by("bbl", "ord").alias("bbl"))
    return places.join(best, ["x", "y"], "left").select("x", "y", F.coalesce("bbl", F.lit(0)).cast("long").alias("bbl"))


#: Tiles along the side of a square of the next level.
LEVEL = 8


def line_of_sight(pixels: DataFrame, raster: DataFrame, camera: Camera, nrow: int, ncol: int, corner: tuple[float, float], near: int, far: int, chunk: int = 4096, tile: int = 256, stretch: int = 64, share: int = 100_000) -> DataFrame:
    """(r, c, x, y, dist): where each pixel's ray first runs below the raster, by horizontal distance; 0 where it never does.

    Distances go up by one, in chunks, nearest first; a hit ray leaves, since horizontal distance grows along a ray. What
    travels is a row for each stretch of a ray and square tile of the raster that it crosses; steps are taken inside the
    tile in NumPy. A tile that more than share stretches cross, as near the camera, is copied for each share of them. Rays
    in flight are written down between chunks, so the plan doesn't grow. Of the raster there are maxima of tiles and of squares of
    LEVEL x LEVEL tiles: long stretches that pass above a square aren't cut up, and short ones that pass above a tile don't travel.
    """
    ex, ey = ray_slopes(camera, F.col("c") - ncol // 2 + 1e-3, nrow // 2 - F.col("r") + 1e-3)
    rays = pixels.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).withColumns({"ex": ex, "ey": ey}).withColumn("norm", F.sqrt(1 + F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")))
    at = lambda d: (F.col("ex") * (-d / F.col("norm")) + camera.x, F.col("ey") * (-d / F.col("norm")) + camera.y)
    heights = raster.select("r", "c", F.col("z").cast("double").alias("z"), F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"))
    x0, y0 = corner
    cx, cy, cz = camera.x, camera.y, camera.z
    tops = materialize(heights.groupBy("tr", "tc").agg(F.max("z").alias("top")), "tops")
    up = lambda c: F.floor(F.col(c) / LEVEL).cast("int")
    squares = materialize(tops.groupBy(up("tr").alias("wr"), up("tc").alias("wc")).agg(F.max("top").alias("top")), "tops")

    def crossed(rays: DataFrame, first: Column, last: Column, side: int, names: tuple[str, str]) -> DataFrame:
        """A row for each stretch of a ray and each square of a side that it may cross."""
        cut = rays.withColumn("first", first).withColumn("last", last)
        (xa, ya), (xb, yb) = at(F.col("first")), at(F.col("last"))
        spread = lambda u, v, o: F.explode(F.sequence(F.floor(F.bround(F.least(u, v) - o) / side).cast("int"), F.floor(F.bround(F.greatest(u, v) - o) / side).cast("int")))
        return cut.withColumn(names[0], spread(ya, yb, y0)).withColumn(names[1], spread(xa, xb, x0))

    def under(pieces: DataFrame, tops: DataFrame, on: list[str]) -> DataFrame:
        """Those that are lower at their end, where a ray is lowest, than what they cross is at its highest."""
        return pieces.join(tops, on).where(F.col("top") > cz - F.col("last") / F.col("norm")).drop("top")

    def walk(key: tuple, rays: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        ground = np.full((tile, tile), -np.inf)
        ground[cells["r"] - key[0] * tile, cells["c"] - key[1] * tile] = cells["z"]
        out = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for k in range(0, len(rays), 4096):
            part = rays.iloc[k : k + 4096]
            ex, ey, norm, first, last = (part[c].to_numpy()[:, None] for c in ("ex", "ey", "norm", "first", "last"))
            d = first + np.arange(stretch)
            dz = -d / norm
            rr = np.rint(ey * dz + cy - y0).astype(np.int64) - key[0] * tile
            cc = np.rint(ex * dz + cx - x0).astype(np.int64) - key[1] * tile
            inside = (d <= last) & (rr >= 0) & (rr < tile) & (cc >= 0) & (cc < tile)
            below = inside & (ground[np.where(inside, rr, 0), np.where(inside, cc, 0)] > dz + cz)
            hit = np.flatnonzero(below.any(1))
            out.append((part["r"].to_numpy()[hit], part["c"].to_numpy()[hit], d[hit, below[hit].argmax(1)].astype(np.int32)))
        return pd.DataFrame(dict(zip(("r", "c", "d"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = None
    for low in range(near, far, chunk):
        high = min(low + chunk, far)
        long = crossed(rays, F.explode(F.sequence(F.lit(low), F.lit(high - 1), F.lit(stretch * LEVEL))), F.least(F.col("first") + stretch * LEVEL, F.lit(high)) - 1, tile * LEVEL, ("wr", "wc"))
        long = under(long, squares, ["wr", "wc"]).withColumnsRenamed({"first": "from", "last": "to"})
        short = crossed(long, F.explode(F.sequence("from", "to", F.lit(stretch))), F.least(F.col("first") + stretch - 1, "to"), tile, ("tr", "tc"))
        pieces = under(short.where((up("tr") == F.col("wr")) & (up("tc") == F.col("wc"))).drop("from", "to", "wr", "wc"), tops, ["tr", "tc"])
        shares = materialize(pieces.groupBy("tr", "tc").agg(F.ceil(F.count("*") / share).cast("int").alias("n")), "shares")
        pieces = pieces.join(shares.toDF("tr", "tc", "n"), ["tr", "tc"]).withColumn("s", F.pmod(F.xxhash64("r", "c"), F.col("n")).cast("int"))
        ground = heights.join(shares.toDF("tr", "tc", "m"), ["tr", "tc"]).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        hits = pieces.groupBy("tr", "tc", "s").cogroup(ground.groupBy("tr", "tc", "s")).applyInPandas(walk, "r int, c int, d int")
        (x, y) = at(F.col("d"))
        first = hits.groupBy("r", "c").agg(F.min("d").alias("d")).join(rays, ["r", "c"]).select("r", "c", x.alias("x"), y.alias("y"))
        first = materialize(first.withColumn("dist", F.hypot(F.col("x") - cx, F.col("y") - cy)), "hits")
        found = first if found is None else found.unionByName(first)
        if high < far:
            rays = materialize(rays.join(first, ["r", "c"], "left_anti"), "rays")
    return pixels.select("r", "c").join(found, ["r", "c"], "left").fillna(0.0, ["x", "y", "dist"])


def lisa(grid: DataFrame, keys: list[str] | None = None, value: str = "v", reach: int = 5, tile: int = 256) -> DataFrame:
    """keys, r, c, lisa: Moran's local index with weights that fall off with distance inside reach, cut at the edges.

    Square tiles with a margin of reach - 1 are shifted against themselves in NumPy: one shuffle in all, in which only
    pixels near a tile's border go out more than once.
    """
    keys = keys or []
    stats = grid.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    z = (grid.join(stats, keys) if keys else grid.crossJoin(stats)).select(*keys, "r", "c", (F.col(value) - F.col("_m")).alias("z"), "_v")
    m = reach - 1
    spread = lambda c: F.sequence(F.floor((F.col(c) - m) / tile), F.floor((F.col(c) + m) / tile))
    dealt = z.withColumn("_tr", F.explode(spread("r"))).withColumn("_tc", F.explode(spread("c")))
    kinds = "".join(f"{k} {z.schema[k].dataType.simpleString()}, " for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iat[0]) * tile - m, int(pdf["_tc"].iat[0]) * tile - m
        full = np.zeros((tile + 2 * m, tile + 2 * m))
        full[pdf["r"] - r0, pdf["c"] - c0] = pdf["z"]
        total = np.zeros((tile, tile))
        for i in range(-m, m + 1):
            for j in range(-m, m + 1):
                if i or j:
                    total += (1 - (i * i + j * j) / (2 * reach * reach)) ** 2 * full[m + i : m + i + tile, m + j : m + j + tile]
        own = pdf[(pdf["r"] // tile == pdf["_tr"]) & (pdf["c"] // tile == pdf["_tc"])]
        return own[[*keys, "r", "c"]].assign(lisa=own["z"] / own["_v"] * total[own["r"] - r0 - m, own["c"] - c0 - m])

    return dealt.groupBy(*keys, "_tr", "_tc").applyInPandas(run, f"{kinds}r int, c int, lisa double")


def permuted(grid: DataFrame, keys: list[str] | None = None, value: str = "v", seed: str = "0") -> DataFrame:
    """grid with its values dealt to other places, within keys: the place of rank k by a hash of seed and place gets the
    value of rank k in row order. Ranks are numbered by image rows and by beginnings of the hash, never in one task."""
    keys = keys or []
    name = F.md5(F.concat_ws("/", F.lit(seed), F.col("r").cast("string"), F.col("c").cast("string")))
    places = numbered(grid.select(*keys, "r", "c", name.alias("_h")), F.substring("_h", 1, 3), [F.col("_h")], "_k", keys).drop("_h")
    values = numbered(grid.select(*keys, "r", "c", value), F.col("r"), [F.col("c")], "_k", keys).select(*keys, "_k", value)
    return places.join(values, [*keys, "_k"]).select(*keys, "r", "c", value)


def lisa_significance(grid: DataFrame, keys: list[str] | None = None, value: str = "v", reach: int = 5, cut: float = 0.96012, seed: str = "0") -> DataFrame:
    """keys, r, c, lisa, zscore and significant: against the spread of the index over one permutation of the grid."""
    keys = keys or []
    chance = lisa(permuted(grid, keys, value, seed), keys, value, reach).groupBy(*keys).agg(F.avg("lisa").alias("_m"), F.stddev_pop("lisa").alias("_s"))
    own = lisa(grid, keys, value, reach)
    z = (F.col("lisa") - F.col("_m")) / F.col("_s")
    return (own.join(chance, keys) if keys else own.crossJoin(chance)).select(*keys, "r", "c", "lisa", z.alias("zscore"), (~((z < cut) & (z > -cut))).alias("significant"))


def spectral_lisa(cube: DataFrame, reach: int = 5, cut: float = 0.96012, seed: str = "0") -> DataFrame:
    """(r, c, lisa): mean over channels of the significant indices, others counting as 0."""
    found = lisa_significance(cube, ["channel"], "value", reach, cut, seed)
    return found.groupBy("r", "c").agg(F.avg(F.when(F.col("significant"), F.col("lisa")).otherwise(0.0)).alias("lisa"))
