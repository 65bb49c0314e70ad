"""Queries on pixels: correlation masks, components, detection, selections, frame conversion and light curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightlights.operators import masks as op
from nightlights.operators import rows
from nightlights.registry import query

PAIRS = """pairs AS (SELECT a.night, a.obs_idx, a.r, a.c, s.side, a.lum x, b.lum y FROM pixels a JOIN (VALUES ('right', 0, 1), ('down', 1, 0)) s(side, dr, dc) ON true
  JOIN pixels b ON b.night = a.night AND b.obs_idx = a.obs_idx AND b.r = a.r + dr AND b.c = a.c + dc)"""
CORR = PAIRS + """, nightly AS (SELECT night, r, c, side, count(*) n, CASE WHEN var_pop(x) > 1e-9 AND var_pop(y) > 1e-9 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) ELSE 0 END q FROM pairs GROUP BY night, r, c, side),
correlation AS (SELECT r, c, side, sum(q * n) / sum(n) corr FROM nightly GROUP BY r, c, side)"""
MASK = CORR + """, mask AS (SELECT DISTINCT unnest([r, CASE side WHEN 'down' THEN r + 1 ELSE r END]) r, unnest([c, CASE side WHEN 'right' THEN c + 1 ELSE c END]) c FROM correlation WHERE corr > 0.12)"""


def components(mask: str, key: str = "0") -> str:
    """Recursive common tables that label a mask (r, c) by frames."""
    return f"""cell AS (SELECT {key} k, r, c, r * 16 + c id FROM {mask}),
reach AS (SELECT k, id, id m FROM cell UNION SELECT n.k, n.id, reach.m FROM reach JOIN cell o ON o.k = reach.k AND o.id = reach.id
  JOIN cell n ON n.k = o.k AND ((n.r = o.r AND abs(n.c - o.c) = 1) OR (n.c = o.c AND abs(n.r - o.r) = 1)) WHERE reach.m < n.id),
root AS (SELECT k, id, min(m) m FROM reach GROUP BY k, id),
labelled AS (SELECT k, r, c, dense_rank() OVER (PARTITION BY k ORDER BY m)::INT AS label FROM cell JOIN root USING (k, id))"""


def mask(v):
    return op.source_mask(op.neighbour_correlation(v.pixels), 0.12)


@query("j2_neighbours", "pixels", f"{PAIRS} --- SELECT * FROM pairs", "x y")
def _(v):
    return rows.neighbours(v.pixels, ["night", "obs_idx"])


@query("a3_neighbour_correlation", "pixels", f"{CORR} --- SELECT * FROM correlation", "corr")
def _(v):
    return op.neighbour_correlation(v.pixels)


@query("a4_source_mask", "pixels", f"{MASK} --- SELECT r, c FROM mask")
def _(v):
    return mask(v)


@query("a6_components", "pixels", f"{MASK}, {components('mask')} --- SELECT r, c, label FROM labelled")
def _(v):
    return op.label_components(mask(v), 16)


@query("a7_sizes", "labels", "SELECT label, count(*) size FROM labels GROUP BY label")
def _(v):
    return op.label_sizes(v.labels)


@query(
    "a8_bright_sources", "pixels",
    f"""fr AS (SELECT night || '-' || obs_idx frame, r, c, lum FROM pixels), lev AS (SELECT frame, median(lum) + 1.2 * stddev_pop(lum) level FROM fr GROUP BY frame),
    bright AS (SELECT frame, r, c FROM fr JOIN lev USING (frame) WHERE lum > level), {components("bright", "frame")}
    --- SELECT k AS frame, label, count(*) AS size, avg(r) r, avg(c) c FROM labelled GROUP BY k, label HAVING count(*) > 1 AND count(*) < 40""", "r c",
)
def _(v):
    frames = v.pixels.select(F.concat_ws("-", "night", "obs_idx").alias("frame"), "r", "c", "lum")
    return op.bright_sources(frames, 16, 1.2, 1, 40)


@query(
    "a9_box_centre", "pixels",
    "b AS (SELECT * FROM pixels WHERE r >= 2 AND r < 14 AND c >= 3 AND c < 13), l AS (SELECT night, obs_idx, 3 * stddev_pop(lum) level FROM b GROUP BY night, obs_idx) --- SELECT night, obs_idx, avg(r) r, avg(c) c FROM b JOIN l USING (night, obs_idx) WHERE lum > level GROUP BY night, obs_idx", "r c",
)
def _(v):
    return op.box_centre(v.pixels, (2, 14), (3, 13), 3, ["night", "obs_idx"])


@query("a31_mask_box", "pixels", f"{MASK} --- SELECT min(r) r_min, max(r) r_max, min(c) c_min, max(c) c_max FROM mask")
def _(v):
    return op.mask_box(mask(v))


@query(
    "p1_bayer", "pixels",
    """SELECT night, obs_idx, (r // 2)::INT r, (c // 2)::INT c, max(lum) FILTER (r % 2 = 0 AND c % 2 = 1) red, max(lum) FILTER (r % 2 = 0 AND c % 2 = 0) green, max(lum) FILTER (r % 2 = 1 AND c % 2 = 0) blue
    FROM pixels WHERE NOT (r % 2 = 1 AND c % 2 = 1) GROUP BY 1, 2, 3, 4""", "red green blue",
)
def _(v):
    return op.bayer_rgb(v.pixels, ["night", "obs_idx"])


@query("p2_gamma", "pixels", "SELECT night, obs_idx, r, c, floor(greatest(least(pow(lum / 255, 0.5) * 255 * 1.5, 255.0), 0.0))::INT g FROM pixels")
def _(v):
    return v.pixels.select("night", "obs_idx", "r", "c", op.gamma(F.col("lum"), 0.5, 1.5).alias("g"))


@query(
    "p3_stretch", "pixels",
    "k AS (SELECT night, obs_idx, r, c, greatest(least(lum, 40), 10) lum FROM pixels), e AS (SELECT night, obs_idx, min(lum) lo, max(lum) hi FROM k GROUP BY night, obs_idx) --- SELECT night, obs_idx, r, c, CASE WHEN hi > lo THEN floor((lum - lo) * 255 / (hi - lo))::INT END lum FROM k JOIN e USING (night, obs_idx)",
)
def _(v):
    return op.stretch(v.pixels, ["night", "obs_idx"], 10.0, 40.0)


@query(
    "p4_convert", "pixels",
    """h AS (SELECT night, obs_idx, r // 2 hr, c // 2 hc, CASE WHEN r % 2 = 0 AND c % 2 = 1 THEN 'red' WHEN r % 2 = 0 THEN 'green' ELSE 'blue' END band, lum FROM pixels WHERE NOT (r % 2 = 1 AND c % 2 = 1)),
    s AS (SELECT night, obs_idx, hr r, hc c, band, lum / CASE band WHEN 'red' THEN 1.1 WHEN 'green' THEN 1.0 ELSE 0.9 END lum FROM h WHERE hr % 2 = 0 AND hc % 2 = 0),
    g AS (SELECT night, obs_idx, r, c, band, greatest(least(floor(greatest(least(pow(lum / 255, 0.5) * 255 * 2, 255.0), 0.0))::INT, 200), 60) lum FROM s), e AS (SELECT night, obs_idx, min(lum) lo, max(lum) hi FROM g GROUP BY 1, 2)
    --- SELECT night, obs_idx, r::INT r, c::INT c, band, CASE WHEN hi > lo THEN floor((lum - lo) * 255 / (hi - lo))::INT END lum FROM g JOIN e USING (night, obs_idx)""",
)
def _(v):
    return op.convert_frames(v.pixels, 2, (1.1, 1.0, 0.9))


@query("p5_crop", "pixels", "SELECT * FROM pixels WHERE r >= 3 AND r < 9 AND c >= 2 AND c < 11", "lum")
def _(v):
    return op.crop(v.pixels, (3, 9), (2, 11))


@query("p6_middle_sized", "pixels", f"{MASK}, {components('mask')}, s AS (SELECT label, count(*) AS size FROM labelled GROUP BY label) --- SELECT * FROM s WHERE size > 2 AND size < (SELECT avg(size) + 2 * stddev_pop(size) FROM s)")
def _(v):
    return op.middle_sized(op.label_components(mask(v), 16), 2)


@query("p6_box_labels", "labels", "SELECT DISTINCT label FROM labels WHERE r >= 3 AND r < 9 AND c >= 2 AND c < 11")
def _(v):
    return op.crop(v.labels, (3, 9), (2, 11)).select("label").distinct()


@query("p6_classified", "source_class", "SELECT source FROM source_class WHERE score >= 0.35 AND lamp_class <> 'MACHINERY'")
def _(v):
    return v.source_class.where("score >= 0.35 AND lamp_class <> 'MACHINERY'").select("source")


@query("p7_drop_small", "labels", "SELECT r, c, label FROM labels WHERE label IN (SELECT label FROM labels GROUP BY label HAVING count(*) >= 13)")
def _(v):
    return op.drop_small(v.labels, 13)


@query("p8_bad_rows", "pixels", f"{MASK} --- SELECT r, c FROM mask WHERE r IN (SELECT r FROM mask GROUP BY r HAVING count(*) < 12)")
def _(v):
    return op.drop_bad_rows(mask(v), 12).select("r", "c")


@query(
    "p10_dark_slice", "pixels",
    "m AS (SELECT night, obs_idx, avg(lum) m FROM pixels WHERE obs_idx % 2 = 0 GROUP BY 1, 2), l AS (SELECT night, median(m) + 0.5 lev FROM m GROUP BY night) --- SELECT night, min(obs_idx) + 2 AS start, max(obs_idx) AS stop FROM m JOIN l USING (night) WHERE m < lev GROUP BY night",
)
def _(v):
    return op.dark_slice(v.pixels, 2)


@query("p11_keep_labels", "labels", "SELECT r, c, CASE WHEN label IN (1, 6, 11) THEN label ELSE 0 END AS label FROM labels")
def _(v):
    return op.keep_labels(v.labels, v.labels.where("label IN (1, 6, 11)"))


LIGHT = "light AS (SELECT night, obs_idx, label source, avg(lum) lum FROM pixels JOIN labels USING (r, c) GROUP BY ALL)"


@query("j1_labelled_pixels", "pixels labels", "SELECT night, obs_idx, r, c, lum, label FROM pixels JOIN labels USING (r, c)", "lum")
def _(v):
    return v.pixels.join(v.labels, ["r", "c"]).select("night", "obs_idx", "r", "c", "lum", "label")


@query("a1_light_curves", "pixels labels", f"{LIGHT} --- SELECT night, source, count(*) n, min(lum) least, max(lum) most FROM light GROUP BY night, source", "least most")
def _(v):
    return op.light_curves(v.pixels, v.labels).groupBy("night", "source").agg(F.count("*").alias("n"), F.min("lum").alias("least"), F.max("lum").alias("most"))


@query("a2_all_nights", "pixels labels", f"{LIGHT} --- SELECT * FROM light", "lum")
def _(v):
    return op.light_curves(v.pixels, v.labels)


@query(
    "j13_painted_curves", "pixels labels",
    f"{LIGHT}, f AS (SELECT DISTINCT night, obs_idx FROM light), g AS (SELECT a::INT r, b::INT c FROM range(16) x(a), range(16) y(b)) --- SELECT f.night, f.obs_idx, g.r, g.c, coalesce(lum, 0) lum FROM g CROSS JOIN f LEFT JOIN labels ON g.r = labels.r AND g.c = labels.c LEFT JOIN light ON light.night = f.night AND light.obs_idx = f.obs_idx AND light.source = label", "lum",
)
def _(v):
    return op.paint_curves(v.labels, op.light_curves(v.pixels, v.labels), 16, 16)


def _grow(right: bool) -> str:
    moves = [(0, 0), (1, 0), (0, 1), (1, 1)]
    values = [f"({p}, {dr}, {dc}, {up}, {across})" for p, (across, up, dr, dc) in enumerate((a, u, r, c) for a in ((0, 1) if right else (0,)) for u in (0, 1) for r, c in moves)]
    return f"""big AS (SELECT * FROM labels WHERE label IN (SELECT label FROM labels GROUP BY label HAVING count(*) > 3)), mv(p, dr, dc, up, ac) AS (VALUES {", ".join(values)}),
    t AS (SELECT label, p, r + dr - up r, c + dc - ac c, r + dr mr, c + dc mc FROM big, mv)
    --- SELECT r, c, arg_min(label, p) AS label FROM t WHERE r >= 0 AND r < 16 AND c >= 0 AND c < 16 AND mr < 16 AND mc < 16 GROUP BY r, c"""


@query("g1_grow", "labels", _grow(False))
def _(v):
    return op.grow_labels(v.labels, 16, 16)


@query("g1_grow_right", "labels", _grow(True))
def _(v):
    return op.grow_labels(v.labels, 16, 16, right=True)


@query(
    "a24_colour_fractions", "pixels labels",
    """f AS (SELECT r, c, floor(median(lum)) lum FROM pixels WHERE obs_idx < 9 AND obs_idx % 2 = 0 GROUP BY r, c),
    h AS (SELECT r // 2 hr, c // 2 hc, coalesce(max(lum) FILTER (r % 2 = 0 AND c % 2 = 1), 0) x, coalesce(max(lum) FILTER (r % 2 = 0 AND c % 2 = 0), 0) y, coalesce(max(lum) FILTER (r % 2 = 1 AND c % 2 = 0), 0) z FROM f WHERE NOT (r % 2 = 1 AND c % 2 = 1) GROUP BY 1, 2)
    --- SELECT label AS source, avg(CASE WHEN x + y + z > 0 THEN x / (x + y + z) ELSE 0 END) red, avg(CASE WHEN x + y + z > 0 THEN y / (x + y + z) ELSE 0 END) green, avg(CASE WHEN x + y + z > 0 THEN z / (x + y + z) ELSE 0 END) blue
    FROM h JOIN labels l ON hr = l.r // 2 AND hc = l.c // 2 WHERE l.r % 2 = 0 AND l.c % 2 = 1 GROUP BY label""", "red green blue",
)
def _(v):
    return op.colour_fractions(v.pixels, v.labels, 9, 2)
