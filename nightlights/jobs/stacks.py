"""Queries on scans and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightlights.jobs.states import STATES
from nightlights.operators import stacks as op
from nightlights.operators.states import lit_states
from nightlights.registry import query

MATCHED = STATES + ", matched AS (SELECT t.scan_id, s.night, s.source, s.obs_idx, s.lit FROM scan_times t JOIN states s ON s.ts > t.ts - INTERVAL 60 MINUTE AND s.ts < t.ts + INTERVAL 60 MINUTE)"
STACK = "nar AS (SELECT min(n) ncol FROM (SELECT scan_id, max(c) + 1 n FROM scans GROUP BY scan_id)), stack AS (SELECT r, c, channel, sum(value)::BIGINT AS value FROM scans, nar WHERE c < ncol GROUP BY r, c, channel)"
#: Half a scan's window, in minutes, in which its sources' states are looked up.
HALF = 720
LIT = STATES + f", lit AS (SELECT DISTINCT scan_id, source FROM scan_clock t JOIN states s ON s.ts > t.ts - INTERVAL {HALF} MINUTE AND s.ts < t.ts + INTERVAL {HALF} MINUTE WHERE s.lit), pix AS (SELECT s.scan_id, night, s.r, s.c, channel, CASE WHEN lit.source IS NOT NULL THEN value ELSE 0 END AS value FROM scans s LEFT JOIN labels l ON l.r = s.r AND l.c = s.c LEFT JOIN lit ON lit.scan_id = s.scan_id AND lit.source = l.label)"


def lit(v):
    """Sources lit in each scan's window."""
    return op.lit_sources(v.scan_clock, lit_states(v.edges), HALF)


def clip_sql(source: str, line: str, name: str, k: float, upper: bool, rounds: int = 10) -> str:
    """Common tables that subtract clipped medians along lines of source (r, c, channel, value and line)."""
    out = [f"{name}0 AS (SELECT * FROM {source})"]
    for i in range(rounds):
        test = f"value - m <= {k} * s" if upper else f"abs(value - m) <= {k} * s"
        out.append(f"{name}{i + 1} AS (SELECT * EXCLUDE (m, s) FROM (SELECT *, median(value) OVER (PARTITION BY {line}) m, stddev_pop(value) OVER (PARTITION BY {line}) s FROM {name}{i}) WHERE {test})")
    return ", ".join([*out, f"{name}m AS (SELECT {line}, median(value) med FROM {name}{rounds} GROUP BY {line})", f"{name} AS (SELECT * EXCLUDE (med, value), value - med AS value FROM {source} JOIN {name}m USING ({line}))"])


@query("j3_scan_windows", "edges scan_times", f"{MATCHED} --- SELECT scan_id, night, source, obs_idx FROM matched")
def _(v):
    return op.scan_windows(v.scan_times, lit_states(v.edges), 60).select("scan_id", "night", "source", "obs_idx")


@query("j4_lit_in_window", "edges scan_times", f"{MATCHED} --- SELECT DISTINCT scan_id, source FROM matched WHERE lit")
def _(v):
    return op.lit_sources(v.scan_times, lit_states(v.edges), 60)


@query("a10_stack", "scans", f"{STACK} --- SELECT r, c, channel, value % 65536 AS value FROM stack")
def _(v):
    return op.stack(v.scans, wrap=True)


@query("a11_mean_stack", "scans", f"{STACK} --- SELECT r, c, channel, floor(value / (SELECT count(DISTINCT scan_id) FROM scans))::BIGINT AS value FROM stack")
def _(v):
    return op.mean_stack(v.scans)


@query(
    "a12_hourly_stacks", "scans scan_clock",
    """h AS (SELECT s.*, ts, hour(ts) hh FROM scans s JOIN scan_clock USING (scan_id) WHERE hour(ts) IN (21, 22, 23, 0, 1, 2, 3, 4)), n AS (SELECT hh, min(n) ncol FROM (SELECT hh, scan_id, max(c) + 1 n FROM h GROUP BY hh, scan_id) GROUP BY hh),
    a AS (SELECT hh, count(DISTINCT scan_id) n_scans, min(ts) first_ts FROM h GROUP BY hh)
    --- SELECT hh::INT AS hour, r, c, channel, sum(value)::BIGINT AS value, any_value(n_scans) n_scans, any_value(first_ts)::VARCHAR first_ts FROM h JOIN n USING (hh) JOIN a USING (hh) WHERE c < ncol GROUP BY hh, r, c, channel""",
)
def _(v):
    return op.hourly_stacks(v.scans.join(v.scan_clock, "scan_id")).withColumn("first_ts", F.col("first_ts").cast("string"))


@query(
    "a13_box_stack", "scans",
    "e AS (SELECT scan_id FROM (SELECT scan_id, row_number() OVER (ORDER BY scan_id) - 1 i FROM (SELECT DISTINCT scan_id FROM scans)) WHERE i % 3 = 0) --- SELECT r, c, channel, sum(floor(value / 7.5))::BIGINT AS value FROM scans WHERE scan_id IN (SELECT scan_id FROM e) AND r >= 2 AND r < 10 AND c >= 4 AND c < 12 GROUP BY r, c, channel",
)
def _(v):
    return op.box_stack(v.scans, (2, 10), (4, 12), 7.5, 3)


@query("j4_lit_pixels", "scans labels edges scan_clock", f"{LIT} --- SELECT * FROM pix")
def _(v):
    return op.lit_pixels(v.scans, v.labels, lit(v))


@query("a14_precision_stack", "scans labels edges scan_clock", f"{LIT}, m AS (SELECT scan_id, channel, r, median(value) m FROM pix GROUP BY scan_id, channel, r) --- SELECT night, r, c, channel, sum(value - m) AS value FROM pix JOIN m USING (scan_id, channel, r) GROUP BY night, r, c, channel", "value")
def _(v):
    return op.precision_stack(v.scans, v.labels, lit(v))


@query("a15_source_spectra", "scans labels", "SELECT label AS source, channel, avg(value) AS value FROM scans JOIN labels USING (r, c) GROUP BY label, channel", "value")
def _(v):
    return op.source_spectra(v.scans, v.labels)


@query("a16_component_spectra", "scans labels", "SELECT coalesce(label, 0) AS label, channel, avg(value) AS value FROM scans s LEFT JOIN labels l ON l.r = s.r AND l.c = s.c WHERE s.r < (SELECT max(r) FROM scans) AND s.c < (SELECT max(c) FROM scans) GROUP BY 1, 2", "value")
def _(v):
    return op.component_spectra(v.scans, v.labels)


@query(
    "a17_spectral_mask", "scans",
    STACK
    + """, p AS (SELECT a.r, a.c, side, a.value x, b.value y FROM stack a JOIN (VALUES ('right', 0, 1), ('down', 1, 0)) s(side, dr, dc) ON true JOIN stack b ON b.channel = a.channel AND b.r = a.r + dr AND b.c = a.c + dc)
    --- SELECT DISTINCT r, c FROM (SELECT r, c, side, coalesce(covar_pop(x, y) / (nullif(stddev_pop(x), 0) * nullif(stddev_pop(y), 0)), 0) q FROM p GROUP BY r, c, side) WHERE q > CASE WHEN r < 8 THEN 0.6 ELSE 0.3 END""",
)
def _(v):
    return op.spectral_mask(op.stack(v.scans), 8)


@query(
    "w13_scaled_spectra", "spectra",
    """x AS (SELECT source, unnest(spectrum)::DOUBLE v, generate_subscripts(spectrum, 1) - 1 i FROM spectra), m AS (SELECT source, median(v) med, stddev_pop(v) sd, count(*) n FROM x GROUP BY source),
    k AS (SELECT k, exp(-0.5 * (k / 3.0) ** 2) / sum(exp(-0.5 * (k / 3.0) ** 2)) OVER () w FROM range(-12, 13) t(k)),
    z AS (SELECT source, i, n, (v - med) / sd v FROM x JOIN m USING (source)),
    s AS (SELECT z.source, z.i, k.w, CASE WHEN z.i + k < 0 THEN -1 - z.i - k WHEN z.i + k >= n THEN 2 * n - 1 - z.i - k ELSE z.i + k END j FROM z, k)
    --- SELECT s.source, s.i::INT channel, sum(w * z.v) v FROM s JOIN z ON z.source = s.source AND z.i = s.j GROUP BY s.source, s.i""", "v",
)
def _(v):
    return op.scale_spectra(v.spectra, 3.0).select("source", F.posexplode("spectrum").alias("channel", "v"))


@query("w14_sigma_clip", "scans", f"s AS (SELECT scan_id, r, c, channel, value::DOUBLE AS value FROM scans), {clip_sql('s', 'scan_id, channel, r', 'k', 1.5, False)} --- SELECT scan_id, r, c, channel, value FROM k", "value")
def _(v):
    return op.subtract_clipped_median(v.scans.select("scan_id", "r", "c", "channel", "value"), ["scan_id", "channel", "r"], 1.5)


@query(
    "w15_flatten_cube", "scans",
    f"{STACK}, s AS (SELECT r, c, channel, value::DOUBLE AS value FROM stack), {clip_sql('s', 'channel, r', 'k', 3, True)}, b AS (SELECT *, (r >= 4)::INT + (r >= 8)::INT + (r >= 12)::INT AS band FROM k), {clip_sql('b', 'channel, band, c', 'q', 3, True)} --- SELECT r, c, channel, value FROM q", "value",
)
def _(v):
    return op.flatten_cube(op.stack(v.scans), (4, 8, 12))


@query("w16_subsample", "scans", "SELECT scan_id, r, c, channel, value FROM scans WHERE r % 4 = 0 AND c % 4 = 0")
def _(v):
    return op.subsample(v.scans, 4).select("scan_id", "r", "c", "channel", "value")


LUM = STACK + ", lum AS (SELECT r, c, avg(value) lum FROM stack GROUP BY r, c)"


@query("w17_flatten_luminosity", "scans", f"{LUM}, a AS (SELECT r, c, lum - avg(lum) OVER (PARTITION BY r) lum, r >= 8 b FROM lum) --- SELECT r, c, lum - median(lum) OVER (PARTITION BY b, c) lum FROM a", "lum")
def _(v):
    return op.flatten_luminosity(op.luminosity(op.stack(v.scans)), 8)


@query("w18_luminosity", "scans", f"{LUM} --- SELECT * FROM lum", "lum")
def _(v):
    return op.luminosity(op.stack(v.scans))


@query("a32_channel_bins", "spectra", "SELECT source, bin::INT AS bin, avg(v) AS value FROM (SELECT source, unnest(spectrum)::DOUBLE v, (generate_subscripts(spectrum, 1) - 1) // 8 bin FROM spectra) GROUP BY source, bin", "value")
def _(v):
    return v.spectra.select("source", F.posexplode(op.binned(F.col("spectrum").cast("array<double>"), 8)).alias("bin", "value"))


@query(
    "a33_temporal_features", "scans",
    """p AS (SELECT scan_id FROM (SELECT scan_id, row_number() OVER (PARTITION BY night ORDER BY scan_id) - 1 i FROM (SELECT DISTINCT night, scan_id FROM scans)) WHERE i IN (0, 3, 7)),
    s AS (SELECT * FROM scans WHERE scan_id IN (SELECT scan_id FROM p)), n AS (SELECT min(n) ncol FROM (SELECT max(c) + 1 n FROM s GROUP BY scan_id)),
    f AS (SELECT scan_id, r, c, channel // 2 bin, floor(avg(value))::INT v FROM s, n WHERE c < ncol GROUP BY 1, 2, 3, 4)
    --- SELECT r, c, array_to_string(list(v ORDER BY scan_id, bin), ',') features FROM f GROUP BY r, c""",
)
def _(v):
    return op.temporal_features(v.scans, 2, (0, 3, 7)).select("r", "c", F.array_join(F.col("features").cast("array<string>"), ",").alias("features"))
