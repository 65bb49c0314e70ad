"""Queries of the transition detector, step by step and whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightlights.operators import edges as op
from nightlights.registry import query

W = 5
_REFLECT = "CASE WHEN (({i}) % (2 * n) + 2 * n) % (2 * n) < n THEN (({i}) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - (({i}) % (2 * n) + 2 * n) % (2 * n) END"
SMOOTH = f"""sized AS (SELECT night, source, obs_idx, lum, count(*) OVER (PARTITION BY night, source) n FROM curves),
kernel AS (SELECT k, exp(-0.5 * (k / {W}.0) ** 2) / sum(exp(-0.5 * (k / {W}.0) ** 2)) OVER () w FROM range(-{4 * W}, {4 * W} + 1) t(k)),
smooth AS (SELECT s.night, s.source, s.obs_idx, sum(w * o.lum) smooth FROM (SELECT *, {_REFLECT.format(i="obs_idx + k")} j FROM sized, kernel) s
  JOIN sized o ON o.night = s.night AND o.source = s.source AND o.obs_idx = s.j GROUP BY ALL)"""
DIFF = SMOOTH + ", diff AS (SELECT *, coalesce(lead(smooth) OVER w - lag(smooth) OVER w, 0) gd FROM smooth WINDOW w AS (PARTITION BY night, source ORDER BY obs_idx))"


def _rounds(n: int) -> str:
    out = ["keep0 AS (SELECT night, source, obs_idx, gd FROM diff)"]
    for k in range(n):
        out.append(f"lev{k} AS (SELECT night, source, avg(gd) m, stddev_pop(gd) s FROM keep{k} GROUP BY night, source)")
        out.append(f"keep{k + 1} AS (SELECT night, source, obs_idx, gd FROM keep{k} JOIN lev{k} USING (night, source) WHERE abs(gd - m) <= 2 * s)")
    return ", ".join([*out, f"levels AS (SELECT night, source, avg(gd) AS mean, stddev_pop(gd) sd FROM keep{n} GROUP BY night, source)"])


LEVELS = DIFF + ", " + _rounds(10)
TAGS = (
    LEVELS
    + """, tags AS (SELECT night, source, obs_idx, gd, coalesce(gd - mean > 0 AND gd > lag(gd) OVER w AND gd > lead(gd) OVER w, false) tag_on,
  coalesce(gd - mean < 0 AND gd < lag(gd) OVER w AND gd < lead(gd) OVER w, false) tag_off FROM diff JOIN levels USING (night, source) WINDOW w AS (PARTITION BY night, source ORDER BY obs_idx))"""
)
CHECK = f"""xs AS (SELECT night, source, obs_idx, lum, count(*) OVER (PARTITION BY night, source) n FROM curves),
xg AS (SELECT DISTINCT night, source, n FROM xs),
xi AS (SELECT night, source, n, i, {_REFLECT.format(i="i")} j FROM (SELECT night, source, n, unnest(range(-{W}, n + {W})) i FROM xg)),
xw AS (SELECT xi.night, xi.source, xi.n, i, lum FROM xi JOIN xs ON xs.night = xi.night AND xs.source = xi.source AND xs.obs_idx = j),
xc AS (SELECT night, source, n, i, abs(avg(lum) OVER r - avg(lum) OVER l) > 2 * greatest(stddev_pop(lum) OVER l, stddev_pop(lum) OVER r) good FROM xw
  WINDOW l AS (PARTITION BY night, source ORDER BY i ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING), r AS (PARTITION BY night, source ORDER BY i ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)),
checked AS (SELECT night, source, i::INT obs_idx, coalesce(good, false) good FROM xc WHERE i >= 0 AND i < n)"""


#: The same with missing samples: a Gaussian of 1, within whose reach of 4 nothing may be missing.
GAPS = f"""sized AS (SELECT night, source, obs_idx, lum, count(*) OVER (PARTITION BY night, source) n FROM gappy),
kernel AS (SELECT k, exp(-0.5 * k ** 2) / sum(exp(-0.5 * k ** 2)) OVER () w FROM range(-4, 5) t(k)),
placed AS (SELECT *, {_REFLECT.format(i="obs_idx + k")} j FROM sized, kernel),
seen AS (SELECT p.night, p.source, p.obs_idx, p.n, any_value(p.lum) lum, sum(p.w * (o.lum IS NOT NULL)::INT) > 0.9999 seen FROM placed p JOIN sized o ON o.night = p.night AND o.source = p.source AND o.obs_idx = p.j GROUP BY ALL),
smooth AS (SELECT p.night, p.source, p.obs_idx, sum(p.w * o.lum) FILTER (o.seen) / CASE WHEN sum(p.w * o.seen::INT) = 0 THEN 1 ELSE sum(p.w * o.seen::INT) END part FROM placed p JOIN seen o ON o.night = p.night AND o.source = p.source AND o.obs_idx = p.j GROUP BY ALL),
diff AS (SELECT night, source, obs_idx, coalesce(part, 0) smooth, coalesce(lead(coalesce(part, 0)) OVER w - lag(coalesce(part, 0)) OVER w, 0) gd, lead(seen) OVER w IS NULL OR lag(seen) OVER w IS NULL OR (lead(seen) OVER w AND lag(seen) OVER w) usable
  FROM smooth JOIN seen USING (night, source, obs_idx) WINDOW w AS (PARTITION BY night, source ORDER BY obs_idx))"""
GAP_TAGS = (
    GAPS
    + ", "
    + _rounds(10).replace("gd FROM diff)", "gd FROM diff WHERE usable)", 1)
    + """, tags AS (SELECT night, source, obs_idx, gd, usable, coalesce(usable AND gd - mean > 0 AND gd > lag(gd) OVER w AND gd > lead(gd) OVER w, false) tag_on,
  coalesce(usable AND gd - mean < 0 AND gd < lag(gd) OVER w AND gd < lead(gd) OVER w, false) tag_off FROM diff LEFT JOIN levels USING (night, source) WINDOW w AS (PARTITION BY night, source ORDER BY obs_idx))"""
)
GAP_CHECK = CHECK.replace("FROM curves", "FROM gappy").replace(") good FROM xw", f") AND count(lum) OVER l = {W} AND count(lum) OVER r = {W} good FROM xw")


@query("w1_smooth", "curves", f"{SMOOTH} --- SELECT * FROM smooth", "smooth")
def _(v):
    return op.smooth(v.curves, W).drop("seen")


@query("w2_masked_difference", "gappy", f"{GAPS} --- SELECT night, source, obs_idx, gd, usable FROM diff", "gd")
def _(v):
    return op.difference(op.smooth(v.gappy, 1)).select("night", "source", "obs_idx", "gd", "usable")


@query("w4_masked_tags", "gappy", f"{GAP_TAGS} --- SELECT night, source, obs_idx, tag_on, tag_off FROM tags")
def _(v):
    d = op.difference(op.smooth(v.gappy, 1))
    return op.tags(d, op.clip_levels(d)).select("night", "source", "obs_idx", "tag_on", "tag_off")


@query("w5_masked_cross_check", "gappy", f"{GAP_CHECK} --- SELECT * FROM checked")
def _(v):
    return op.cross_check(v.gappy, W)


@query("w6_masked_detect", "gappy", f"{GAP_TAGS}, {GAP_CHECK} --- SELECT night, source, obs_idx, gd, tag_on AND good is_on, tag_off AND good is_off FROM tags JOIN checked USING (night, source, obs_idx)", "gd")
def _(v):
    return op.detect(v.gappy, W, sigma=1).select("night", "source", "obs_idx", "gd", "is_on", "is_off")


@query("w2_difference", "curves", f"{DIFF} --- SELECT night, source, obs_idx, gd FROM diff", "gd")
def _(v):
    return op.difference(op.smooth(v.curves, W)).select("night", "source", "obs_idx", "gd")


@query("w3_clip_levels", "curves", f"{LEVELS} --- SELECT night, source, mean, sd FROM levels", "mean sd")
def _(v):
    return op.clip_levels(op.difference(op.smooth(v.curves, W)))


@query("w4_tags", "curves", f"{TAGS} --- SELECT night, source, obs_idx, tag_on, tag_off FROM tags")
def _(v):
    d = op.difference(op.smooth(v.curves, W))
    return op.tags(d, op.clip_levels(d)).select("night", "source", "obs_idx", "tag_on", "tag_off")


@query("w5_cross_check", "curves", f"{CHECK} --- SELECT * FROM checked")
def _(v):
    return op.cross_check(v.curves, W)


@query("w6_detect", "curves", f"{TAGS}, {CHECK} --- SELECT night, source, obs_idx, gd, tag_on AND good is_on, tag_off AND good is_off FROM tags JOIN checked USING (night, source, obs_idx)", "gd")
def _(v):
    return op.detect(v.curves, W).select("night", "source", "obs_idx", "gd", "is_on", "is_off")


@query(
    "a5_detrend", "pixels",
    """p AS (SELECT night, r, c, obs_idx, lum, row_number() OVER (PARTITION BY night, r, c ORDER BY obs_idx) - 1 i, count(*) OVER (PARTITION BY night, r, c) n FROM pixels),
    k AS (SELECT k, exp(-0.5 * (k / 2.0) ** 2) / sum(exp(-0.5 * (k / 2.0) ** 2)) OVER () w FROM range(-8, 9) t(k))
    --- SELECT s.night, s.r, s.c, s.obs_idx, any_value(s.lum) - sum(w * o.lum) lum FROM (SELECT *, """ + _REFLECT.format(i="i + k") + """ j FROM p, k) s JOIN p o ON o.night = s.night AND o.r = s.r AND o.c = s.c AND o.i = s.j GROUP BY s.night, s.r, s.c, s.obs_idx""", "lum",
)
def _(v):
    return op.detrend(v.pixels, 2.0).select("night", "r", "c", "obs_idx", F.col("lum"))
