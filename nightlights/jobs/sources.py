"""Queries that write the given tables as the library's files and read these back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightlights.jobs.stacks import STACK
from nightlights.jobs.states import STATES
from nightlights.jobs.world import raster
from nightlights.operators import stacks
from nightlights.operators import templates as lamps
from nightlights.operators.masks import colour_fractions
from nightlights.operators.states import lit_states, rank_by_colour
from nightlights.registry import query
from nightlights.runtime import shared_dir
from nightlights.sources import frames, maps, raw

SIDE = 16


def folder(v, name: str) -> str:
    return f"{shared_dir(v.spark)}/{name}-{uuid4().hex}"


def cells(value: Column, place: Column) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(place.alias("at"), value.cast("int").alias("value"))))


def byte(column: str, place: Column) -> Column:
    """The byte at a place, 0 where there is none. Values are below 128, so Spark's text writer keeps them as they are."""
    return F.char(F.coalesce(F.try_element_at(column, place.cast("int")), F.lit(0)))


def raw_frames(v) -> str:
    """A raw frame of one file for each night and obs_idx, rows ending in a byte of their own; nights are the years."""
    path = folder(v, "frames")
    each = v.pixels.groupBy("night", "obs_idx").agg(cells(F.floor("lum"), F.col("r") * SIDE + F.col("c")).alias("at"))
    row = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda c: byte("at", r * SIDE + c)), "")
    text = each.select(F.lit("y").alias("month"), "night", "obs_idx", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), row), "\n").alias("value"))
    text.repartition("night").sortWithinPartitions("night", "obs_idx").select("month", "night", "value").write.option("maxRecordsPerFile", 1).partitionBy("month", "night").text(path)
    return path


FRAMES = f"""f AS (SELECT night, obs_idx, row_number() OVER (PARTITION BY night ORDER BY obs_idx) - 1 i FROM (SELECT DISTINCT night, obs_idx FROM pixels)), g AS (SELECT a::INT r, b::INT c FROM range({SIDE}) x(a), range({SIDE}) y(b)),
full_frames AS (SELECT 'month=y-night=' || f.night night, i::INT obs_idx, g.r, g.c, coalesce(floor(lum), 0)::INT lum FROM f CROSS JOIN g LEFT JOIN pixels p ON p.night = f.night AND p.obs_idx = f.obs_idx AND p.r = g.r AND p.c = g.c)"""


def pixels_of(found: DataFrame) -> DataFrame:
    return frames.explode_frames(found).where(F.col("c") < SIDE).select("night", "obs_idx", "r", "c", F.col("lum").cast("int").alias("lum"))


@query("s1_raw_frames", "pixels", f"{FRAMES} --- SELECT * FROM full_frames")
def _(v):
    return pixels_of(frames.read_frames(v.spark, raw_frames(v), SIDE, SIDE + 1))


@query("s2_chosen_frames", "pixels", f"{FRAMES} --- SELECT * FROM full_frames WHERE obs_idx >= 2 AND obs_idx < 10 AND (obs_idx - 2) % 3 = 0")
def _(v):
    return pixels_of(frames.read_frames(v.spark, raw_frames(v), SIDE, SIDE + 1, 2, 10, 3))


@query(
    "s3_scans", "scans",
    f"""g AS (SELECT a::INT r, b::INT c, k::INT channel FROM range({SIDE}) x(a), range({SIDE}) y(b), range(7) z(k)), n AS (SELECT DISTINCT scan_id FROM scans)
    --- SELECT n.scan_id, g.r, g.c, g.channel, coalesce(value % 128 + 256 * (value // 128), 0)::INT AS value, {SIDE} samples, {SIDE} AS "lines", 7 bands FROM n CROSS JOIN g LEFT JOIN scans s ON s.scan_id = n.scan_id AND s.r = g.r AND s.c = g.c AND s.channel = g.channel""",
)
def _(v):
    """Values take seven bits of each of their two bytes."""
    path = folder(v, "scans")
    at = (F.col("c") * 7 + F.col("channel")) * SIDE + SIDE - 1 - F.col("r")
    given = v.scans.select("scan_id", at.cast("int").alias("at"), "value")
    every = v.scans.select("scan_id").distinct().select("scan_id", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE * 7 - 1))).alias("at"))
    full = every.join(given, ["scan_id", "at"], "left").select("scan_id", "at", F.coalesce("value", F.lit(0)).alias("value"))
    two = F.concat(F.char((F.col("value") % 128).cast("int")), F.char(F.floor(F.col("value") / 128).cast("int")))
    each = full.select("scan_id", F.struct("at", two.alias("text")).alias("x")).groupBy("scan_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    each.select("scan_id", F.array_join(F.transform("xs", lambda x: x["text"]), "").alias("value")).write.partitionBy("scan_id").text(f"{path}/raw")
    lines = F.explode(F.array(*[F.lit(x) for x in (f"samples = {SIDE}", f"Lines = {SIDE}", "bands = 7", "other = 1, 2")]))
    each.select("scan_id", lines.alias("value")).write.partitionBy("scan_id").text(f"{path}/headers")
    name = r"scan_id=(\d+)"
    number = F.regexp_extract("scan", name, 1).cast("int").alias("scan_id")
    heads = frames.read_header(v.spark, f"{path}/headers")
    cubes = frames.read_scans(v.spark, f"{path}/raw", heads, name=name).select(number, "r", "c", F.posexplode("spectrum").alias("channel", "value"))
    return cubes.join(heads.select(number, "samples", "lines", "bands"), "scan_id").select("scan_id", "r", "c", "channel", "value", "samples", "lines", "bands")


WAVES = "SELECT scan_id, channel, 400 + 10 * channel + max(value) / 8.0 AS wavelength FROM scans GROUP BY scan_id, channel"


@query("s3_wavelengths", "scans", f"SELECT scan_id, (row_number() OVER (PARTITION BY scan_id ORDER BY channel) - 1)::INT channel, wavelength::DOUBLE wavelength FROM ({WAVES})", "wavelength")
def _(v):
    """A header for each scan, whose list has a line for each channel that the scan has."""
    path = folder(v, "wavelengths")
    wave = (400 + 10 * F.col("channel") + F.max("value") / 8.0).cast("double")
    each = v.scans.groupBy("scan_id", "channel").agg(wave.alias("wavelength")).groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("channel", "wavelength"))).alias("xs"))
    lines = F.concat(F.array(F.concat(F.lit("bands = "), F.size("xs")), F.lit("Wavelength = {")), F.transform("xs", lambda x: F.concat(x["wavelength"].cast("string"), F.lit(", nm"))), F.array(F.lit("}")))
    each.select("scan_id", F.array_join(lines, "\n").alias("value")).write.partitionBy("scan_id").text(path)
    found = frames.read_wavelengths(v.spark, f"{path}/*")
    return found.select(F.regexp_extract("scan", r"scan_id=(\d+)", 1).cast("int").alias("scan_id"), "channel", "wavelength")


CLIP = "SELECT source FROM source_class WHERE score >= 0.35"


@query("s4_clipped_edges", "edges source_class", f"SELECT night, obs_idx, source, is_on, is_off FROM edges WHERE source IN ({CLIP})")
def _(v):
    return v.edges.select("night", "obs_idx", "source", "is_on", "is_off").join(v.source_class.where("score >= 0.35"), "source", "left_semi").select("night", "obs_idx", "source", "is_on", "is_off")


@query("s4_clipped_states", "edges source_class", f"{STATES} --- SELECT night, obs_idx, source, lit FROM states WHERE source IN ({CLIP})")
def _(v):
    return lit_states(v.edges).join(v.source_class.where("score >= 0.35"), "source", "left_semi").select("night", "obs_idx", "source", "lit")


@query("s5_nightly_tables", "curves", "SELECT night, obs_idx, source, lum FROM curves", "lum")
def _(v):
    path = folder(v, "curves")
    frames.write_nights(v.curves.select("night", "obs_idx", "source", "lum"), path, "zstd")
    return frames.read_nights(v.spark, path, "obs_idx int, source int, lum double, night string").select("night", "obs_idx", "source", "lum")


@query("s6_template_files", "spectra", "SELECT CASE WHEN lamp_class = 0 THEN 'Quartz' ELSE 'LED_' || lamp_class END AS lamp_type, source AS example, (generate_subscripts(spectrum, 1) - 1)::INT channel, unnest([CASE WHEN x < 0 THEN 0 ELSE x END FOR x IN spectrum])::DOUBLE intensity FROM spectra", "intensity")
def _(v):
    """A file of templates for each lamp type, named after it; readings below 0 are written as gaps."""
    path = folder(v, "lamps")
    name = F.concat(F.when(F.col("lamp_class") == 0, "Quart").otherwise(F.concat(F.lit("LED_"), F.col("lamp_class"))), F.lit("_lamp_2011"))
    long = v.spectra.select(name.alias("name"), F.col("source").alias("example"), F.posexplode("spectrum").alias("channel", "x"))
    long.select("name", "example", "channel", F.when(F.col("x") >= 0, F.col("x")).cast("double").alias("intensity")).write.option("header", True).partitionBy("name").csv(path)
    return lamps.read_templates(v.spark, path)


@query("s7_cube", "scans", f"{STACK} --- SELECT 'all' AS night, r, c, channel, value FROM stack")
def _(v):
    path = folder(v, "cube")
    frames.write_cube(stacks.stack(v.scans).withColumn("night", F.lit("all")), path)
    return frames.read_nights(v.spark, path, "r int, c int, channel int, value bigint, night string").select("night", "r", "c", "channel", "value")


@query(
    "s7_raw_cubes", "scans",
    f"""nar AS (SELECT night, min(n) ncol FROM (SELECT night, scan_id, max(c) + 1 n FROM scans GROUP BY night, scan_id) GROUP BY night), stack AS (SELECT s.night, r, c, channel, sum(value) % 65536 AS value FROM scans s JOIN nar n ON n.night = s.night WHERE c < ncol GROUP BY s.night, r, c, channel),
    width AS (SELECT night, max(c) + 1 n FROM stack GROUP BY night), g AS (SELECT a::INT r, k::INT channel FROM range({SIDE}) x(a), range(7) z(k)), cells AS (SELECT night, n, b::INT c, g.r, g.channel FROM width, range({SIDE}) y(b), g WHERE b < n)
    --- SELECT x.night, x.r, x.c, x.channel, coalesce(value, 0)::INT AS value, n::INT AS "lines", (400 + 10.0 * x.channel)::DOUBLE AS wavelength FROM cells x LEFT JOIN stack s ON s.night = x.night AND s.r = x.r AND s.c = x.c AND s.channel = x.channel""",
    "wavelength",
)
def _(v):
    """A raw cube and header for each night's stack, read back whole."""
    path = folder(v, "cubes")
    cubes = stacks.stacked_spectra(v.scans, ["night"], wrap=True).withColumnRenamed("night", "scan")
    raw.write_raw_cubes(cubes, path, SIDE, 7, waves=[400 + 10.0 * k for k in range(7)])
    heads = frames.read_header(v.spark, f"{path}/*.hdr")
    night = F.regexp_extract("scan", frames.FILE_NAME, 1).alias("night")
    found = frames.read_scans(v.spark, f"{path}/*.raw", heads).select(night, "r", "c", F.posexplode("spectrum").alias("channel", "value"))
    waves = frames.read_wavelengths(v.spark, f"{path}/*.hdr").select(night, "channel", "wavelength")
    return found.join(heads.select(night, "lines"), "night").join(waves, ["night", "channel"]).select("night", "r", "c", "channel", "value", "lines", "wavelength")


@query("s8_compressed_frames", "pixels", f"{FRAMES} --- SELECT night, obs_idx, r, list(lum ORDER BY c)::VARCHAR lums FROM full_frames GROUP BY night, obs_idx, r")
def _(v):
    path = folder(v, "compressed")
    frames.write_nights(frames.read_frames(v.spark, raw_frames(v), SIDE, SIDE + 1), path, "gzip")
    back = frames.read_nights(v.spark, path, "obs_idx int, ts timestamp, r int, band int, pixels array<smallint>, night string")
    return back.select("night", "obs_idx", "r", F.concat(F.lit("["), F.array_join(F.slice("pixels", 1, SIDE).cast("array<string>"), ", "), F.lit("]")).alias("lums"))


@query("s9_points", "points", "SELECT tile, x::DOUBLE x, y::DOUBLE y, z::DOUBLE z FROM points", "x y z")
def _(v):
    path = folder(v, "points")
    maps.write_map(v.points.select("tile", *[F.col(c).cast("double").alias(c) for c in "xyz"]), path, "points")
    return maps.read_map(v.spark, path, "points")


@query("s9_tiles", "points", "SELECT tile, min(x)::DOUBLE xmin, max(x)::DOUBLE xmax, min(y)::DOUBLE ymin, max(y)::DOUBLE ymax FROM points GROUP BY tile", "xmin xmax ymin ymax")
def _(v):
    path = folder(v, "tiles")
    ends = [f(c).cast("double").alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))]
    maps.write_map(v.points.groupBy("tile").agg(*ends), path, "tiles", "csv")
    return maps.read_map(v.spark, path, "tiles", "csv")


@query("s9_lots", "lots", "SELECT * FROM lots", "x y")
def _(v):
    path = folder(v, "lots")
    maps.write_map(v.lots, path, "lots", "csv")
    return maps.read_map(v.spark, path, "lots", "csv")


@query("s9_raster", "points", "low AS (SELECT min(x) x0, min(y) y0 FROM points) --- SELECT round_even(y - y0, 0)::INT AS row, round_even(x - x0, 0)::INT AS col, avg(z) z FROM points, low GROUP BY 1, 2", "z")
def _(v):
    path = folder(v, "raster")
    maps.write_raster(raster(v).select(F.col("r").alias("row"), F.col("c").alias("col"), F.col("z").cast("double").alias("z")), path)
    return maps.read_raster(v.spark, path)


@query(
    "w11_colour_ranks", "pixels labels",
    """f AS (SELECT r, c, floor(median(lum)) lum FROM pixels WHERE obs_idx < 9 AND obs_idx % 2 = 0 GROUP BY r, c),
    h AS (SELECT r // 2 hr, c // 2 hc, coalesce(max(lum) FILTER (r % 2 = 0 AND c % 2 = 1), 0) x, coalesce(max(lum) FILTER (r % 2 = 0 AND c % 2 = 0), 0) y, coalesce(max(lum) FILTER (r % 2 = 1 AND c % 2 = 0), 0) z FROM f WHERE NOT (r % 2 = 1 AND c % 2 = 1) GROUP BY 1, 2),
    q AS (SELECT label AS source, avg(CASE WHEN x + y + z > 0 THEN x / (x + y + z) ELSE 0 END) red, avg(CASE WHEN x + y + z > 0 THEN y / (x + y + z) ELSE 0 END) green, avg(CASE WHEN x + y + z > 0 THEN z / (x + y + z) ELSE 0 END) blue
    FROM h JOIN labels l ON hr = l.r // 2 AND hc = l.c // 2 WHERE l.r % 2 = 0 AND l.c % 2 = 1 GROUP BY label),
    v AS (SELECT source, unnest(['red', 'green', 'blue', 'r-b', 'b-r', 'b-g', 'r-g']) AS "by", round(unnest([red, green, blue, red - blue, blue - red, blue - green, red - green]), 9) x FROM q)
    --- SELECT "by", source, row_number() OVER (PARTITION BY "by" ORDER BY x DESC, source)::INT AS rank FROM v""",
)
def _(v):
    return rank_by_colour(colour_fractions(v.pixels, v.labels, 9, 2))
