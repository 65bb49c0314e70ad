"""Queries on states, durations and group comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightlights.functions import times
from nightlights.functions.stats import level_curve
from nightlights.operators import states as op
from nightlights.operators.masks import either
from nightlights.registry import query
from nightlights.runtime import materialize

SERIES = "PARTITION BY night, source ORDER BY obs_idx"
STATES = f"""states AS (SELECT night, obs_idx, ts, source,
  coalesce(last_value(CASE WHEN is_off THEN 0 WHEN is_on THEN 1 END IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1
  OR coalesce(first_value(CASE WHEN is_on THEN 0 WHEN is_off THEN 1 END IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) = 1 lit FROM edges)"""
DURATIONS = STATES + ", durations AS (SELECT night, source, sum(CASE WHEN lit THEN 10.0 ELSE 0.0 END)::DOUBLE duration FROM states GROUP BY night, source)"
TEST, CONTROL = ("AUTOMOBILE", "BUILDING"), ("FURNITURE", "HOUSEHOLD", "MACHINERY")
#: Sources of a group that are ever lit, their totals of distances from the night's mean in deviations of these.
STANDARD = "m AS (SELECT night, avg(duration) mean FROM {0} GROUP BY night), apart AS (SELECT night, source, abs(duration - mean) d FROM {0} JOIN m USING (night)), sd AS (SELECT night, stddev_pop(d) sd FROM apart GROUP BY night), totals AS (SELECT source, sum(CASE WHEN sd > 0 THEN d / sd ELSE 0 END) total FROM apart JOIN sd USING (night) GROUP BY source)"
GROUP = f"CASE WHEN lamp_class IN {TEST} THEN 'test' WHEN lamp_class IN {CONTROL} THEN 'control' END"
GROUPED = DURATIONS + f", lit AS (SELECT * FROM durations WHERE source IN (SELECT source FROM durations GROUP BY source HAVING sum(duration) > 0) AND source IN (SELECT source FROM source_class WHERE {GROUP} IS NOT NULL)), {STANDARD.format('lit')}, grouped AS (SELECT source, {GROUP} grp, total FROM totals JOIN source_class USING (source))"


def durations(v):
    return op.lit_durations(op.lit_states(v.edges))


def grouped(v):
    classes = v.source_class.select("source", op.lamp_group(F.col("lamp_class"), TEST, CONTROL).alias("grp")).where("grp IS NOT NULL")
    totals = op.standardised_totals(op.ever_lit(durations(v)).join(classes, "source", "left_semi"))
    return totals.join(classes, "source").select("source", "grp", "total")


@query("w7_lit_state", "edges", f"{STATES} --- SELECT night, source, count(*) n, sum(lit::INT)::BIGINT n_lit, min(CASE WHEN lit THEN obs_idx END) first_lit FROM states GROUP BY night, source")
def _(v):
    return op.lit_states(v.edges).groupBy("night", "source").agg(F.count("*").alias("n"), F.sum(F.col("lit").cast("long")).alias("n_lit"), F.min(F.when(F.col("lit"), F.col("obs_idx"))).alias("first_lit"))


@query("w8_lit_states", "edges", f"{STATES} --- SELECT night, obs_idx, source, lit FROM states")
def _(v):
    return op.lit_states(v.edges).select("night", "obs_idx", "source", "lit")


@query("a18_durations", "edges", f"{DURATIONS} --- SELECT * FROM durations", "duration")
def _(v):
    return durations(v)


@query(
    "w9_event_durations", "edges",
    """e AS (SELECT night, source, obs_idx, is_on, is_off, coalesce(sum(is_off::INT) OVER (PARTITION BY night, source ORDER BY obs_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) k FROM edges WHERE is_on <> is_off),
    g AS (SELECT night, source, k, min(obs_idx) FILTER (is_on) o, max(obs_idx) FILTER (is_off) f FROM e GROUP BY night, source, k),
    h AS (SELECT *, lag(f) OVER (PARTITION BY night, source ORDER BY k) p FROM g)
    --- SELECT night, source, coalesce(sum(f - coalesce(o, p, 0)), 0)::BIGINT steps FROM (SELECT DISTINCT night, source FROM edges) LEFT JOIN h USING (night, source) GROUP BY night, source""",
)
def _(v):
    return op.event_durations(v.edges)


@query("a19_last_off", "edges", "SELECT night, source, max(CASE WHEN is_off THEN ts END) last_off FROM edges GROUP BY night, source")
def _(v):
    return op.last_off(v.edges)


@query("a20_mean_last_off", "edges", "SELECT source, avg(nullif(l, 0)) mean_last FROM (SELECT night, source, max(CASE WHEN is_off THEN obs_idx END) l FROM edges GROUP BY night, source) GROUP BY source", "mean_last")
def _(v):
    return op.mean_last_off_index(v.edges)


STATS = "hours hours_per_source minutes_per_night"


@query(
    "a21_light_stats", "edges source_class",
    f"""{DURATIONS}, t AS (SELECT source, sum(duration) total FROM durations GROUP BY source)
    --- SELECT CASE WHEN grouping(lamp_class) = 1 THEN 'all' ELSE lamp_class END lamp_class, count(*) n_sources, count(*) FILTER (total > 0) n_on, sum(total) / 3600 AS hours,
    avg(total) FILTER (total > 0) / 3600 hours_per_source, avg(total) FILTER (total > 0) / (60 * 29) minutes_per_night FROM t JOIN source_class USING (source) GROUP BY ROLLUP (lamp_class)""", STATS,
)
def _(v):
    return op.light_stats(durations(v), v.source_class)


@query(
    "a22_off_counts", "edges",
    """n AS (SELECT night, CAST(floor(obs_idx / 10) AS INT) bin, sum(is_off::INT)::BIGINT n_off FROM edges GROUP BY 1, 2), g AS (SELECT DISTINCT night, b bin FROM n, range((SELECT max(bin) + 1 FROM n)) t(b))
    --- SELECT night, (date_diff('day', DATE '1970-01-01', night::DATE) % 7)::INT weekday, bin::INT bin, coalesce(n_off, 0) n_off FROM g LEFT JOIN n USING (night, bin)""",
)
def _(v):
    return op.off_counts(v.edges, 10)


@query(
    "a23_histogram", "edges source_class",
    f"{GROUPED}, q AS (SELECT grp, round(total, 9) total FROM grouped), e AS (SELECT grp, min(total) lo, max(total) hi FROM q GROUP BY grp) --- SELECT grp, CASE WHEN hi > lo THEN least(floor((total - lo) / ((hi - lo) / 100)), 99) ELSE 0 END::INT bin, count(*) n FROM q JOIN e USING (grp) GROUP BY 1, 2",
)
def _(v):
    return op.histogram(grouped(v).withColumn("total", F.round("total", 9)), "total", ["grp"])


@query("x1_groups", "edges source_class", f"{GROUPED} --- SELECT * FROM grouped", "total")
def _(v):
    return grouped(v)


#: The statistic's mean is k - 1; its deviation by Scholz and Stephens, sums written as they stand there. A parabola through
#: the levels' logarithms gives p for two groups.
_CURVE = " + ".join(f"({c!r}) * power(t, {2 - i})" for i, c in enumerate(level_curve(2).tolist()))


@query(
    "x2_anderson_darling", "edges source_class",
    f"""{GROUPED}, v AS (SELECT grp, round(total, 9) total FROM grouped), s AS (SELECT grp, count(*) n FROM v GROUP BY grp), t AS (SELECT sum(n) AS al, count(*) k, sum(1.0 / n) H FROM s), l AS (SELECT total, count(*) l FROM v GROUP BY total),
    f AS (SELECT total, grp, count(*) f FROM v GROUP BY total, grp),
    c AS (SELECT grp, n, l, sum(coalesce(f, 0)) OVER w - coalesce(f, 0) / 2 M, sum(l) OVER w - l / 2 B FROM l CROSS JOIN s LEFT JOIN f USING (total, grp) WINDOW w AS (PARTITION BY grp ORDER BY total)),
    a AS (SELECT sum(l / al * (al * M - B * n) ** 2 / (B * (al - B) - al * l / 4) / n) * (any_value(al) - 1) / any_value(al) a2, any_value(al)::BIGINT n, any_value(k) k, any_value(H)::DOUBLE "H" FROM c, t),
    hg AS (SELECT (SELECT sum(1.0 / i) FROM range(1, n) r(i)) u, (SELECT sum(1.0 / ((n - i) * j)) FROM range(1, n - 1) r(i), range(2, n) q(j) WHERE j > i) g FROM a),
    w AS (SELECT a2, n, k, a."H", (4 * g - 6) * (k - 1) + (10 - 6 * g) * a."H" c3, (2 * g - 4) * k * k + 8 * u * k + (2 * g - 14 * u - 4) * a."H" - 8 * u + 4 * g - 6 c2, (6 * u + 2 * g - 2) * k * k + (4 * u - 4 * g + 6) * k + (2 * u - 6) * a."H" + 4 * u c1, (2 * u + 6) * k * k - 4 * u * k c0 FROM a, hg),
    z AS (SELECT a2, n, k, "H", (a2 - (k - 1)) / sqrt((c3 * n ** 3 + c2 * n ** 2 + c1 * n + c0) / ((n - 1) * (n - 2) * (n - 3))) t FROM w)
    --- SELECT a2, n, k, "H", t AS statistic, least(0.25, greatest(0.001, exp({_CURVE}))) p FROM z""", "a2 H statistic p",
)
def _(v):
    return op.anderson_darling(grouped(v).withColumn("total", F.round("total", 9)))


@query(
    "p9_quiet_nights", "edges",
    f"{DURATIONS}, m AS (SELECT source, avg(duration) + 1.5 * stddev_pop(duration) lim FROM durations GROUP BY source), g AS (SELECT night FROM durations JOIN m USING (source) GROUP BY night HAVING avg((duration > lim)::INT) < 0.15) --- SELECT * FROM durations WHERE night IN (SELECT night FROM g)", "duration",
)
def _(v):
    return op.quiet_nights(durations(v), 1.5, 0.15)


@query("p12_ever_lit", "edges", f"{DURATIONS} --- SELECT * FROM durations WHERE source IN (SELECT source FROM durations GROUP BY source HAVING sum(duration) > 0)", "duration")
def _(v):
    return op.ever_lit(durations(v))


@query(
    "w10_rank_by_last_event", "edges",
    "k AS (SELECT source, row_number() OVER (ORDER BY max(obs_idx), source) AS rank FROM edges WHERE (is_on OR is_off) AND night = '2024-01-02' GROUP BY source) --- SELECT source, rank::INT AS rank, obs_idx FROM edges JOIN k USING (source) WHERE (is_on OR is_off) AND night = '2024-01-03'",
)
def _(v):
    return op.rank_by_last_event(v.edges, "2024-01-02", "2024-01-03")


@query("w10_relative_brightness", "curves", "SELECT night, source, obs_idx, lum / max(lum) OVER (PARTITION BY night, source) share FROM curves", "share")
def _(v):
    return op.relative_brightness(v.curves)


@query("w11_rank_by_duration", "edges", f"{DURATIONS} --- SELECT night, source, row_number() OVER (PARTITION BY night ORDER BY duration DESC, source)::INT AS rank FROM durations")
def _(v):
    return op.rank_sources(durations(v), F.col("duration"))


@query("w12_standardised_totals", "edges", f"{DURATIONS}, {STANDARD.format('durations')} --- SELECT source, total FROM totals", "total")
def _(v):
    return op.standardised_totals(durations(v))


@query(
    "a26_regression", "edges source_class",
    """l AS (SELECT source, avg(nullif(m, 0)) y FROM (SELECT night, source, max(CASE WHEN is_off THEN obs_idx END) m FROM edges GROUP BY night, source) GROUP BY source),
    f AS (SELECT count(*)::INT n, regr_slope(y, score) slope, regr_intercept(y, score) intercept, corr(y, score) r FROM l JOIN source_class USING (source) WHERE y IS NOT NULL),
    q AS (SELECT *, atan(abs(r) / sqrt(1 - r * r)) theta FROM f)
    --- SELECT n, slope, intercept, r, 1 - sin(theta) * (SELECT sum(exp(lgamma(2 * j + 1.0) - 2 * lgamma(j + 1.0)) / power(4, j) * power(cos(theta), 2 * j)) FROM range(0, (n - 2) // 2) s(j)) p FROM q""", "slope intercept r p",
)
def _(v):
    return op.off_regression(op.mean_last_off_index(v.edges), v.source_class)


@query("j11_attributes", "edges source_class", f"{DURATIONS} --- SELECT night, source, duration, lamp_class, score FROM durations JOIN source_class USING (source)", "duration score")
def _(v):
    return durations(v).join(v.source_class, "source").select("night", "source", "duration", "lamp_class", "score")


@query("f1_local_time", "curves", "SELECT night, source, obs_idx, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') local FROM curves")
def _(v):
    return v.curves.select("night", "source", "obs_idx", F.date_format(times.local_time(F.unix_timestamp("ts")), "yyyy-MM-dd HH:mm:ss").alias("local"))


@query("f2_night_dates", "curves", "SELECT night, (DATE '2017-06-25' + (dense_rank() OVER (ORDER BY night) - 1)::INT)::VARCHAR date FROM (SELECT DISTINCT night FROM curves)")
def _(v):
    from pyspark.sql import Window

    return v.curves.select("night").distinct().select("night", times.night_date((F.dense_rank().over(Window.orderBy("night")) - 1).cast("int")).cast("string").alias("date"))


@query("f3_hours", "curves", "SELECT night, hour(ts)::INT AS hour, substr(night, 6, 2) AS month, count(*) n FROM curves GROUP BY 1, 2, 3")
def _(v):
    month, _ = times.month_night(F.concat(F.lit("curves_"), F.replace(F.substring("night", 6, 5), F.lit("-"), F.lit("_")), F.lit(".parquet")))
    return v.curves.groupBy("night", F.hour("ts").alias("hour"), month.alias("month")).agg(F.count("*").alias("n"))


@query("f4_event_value", "edges", "SELECT night, source, obs_idx, is_on::INT - is_off::INT AS event FROM edges")
def _(v):
    return v.edges.select("night", "source", "obs_idx", op.event_value(F.col("is_on"), F.col("is_off")).alias("event"))


@query("f2_date_ranges", "curves", "SELECT night, unnest(range(night::DATE, night::DATE + INTERVAL 3 DAY, INTERVAL 1 DAY))::DATE::VARCHAR date FROM (SELECT DISTINCT night FROM curves)")
def _(v):
    nights = v.curves.select("night").distinct()
    place = F.datediff(F.to_date("night"), F.lit(times.FIRST_NIGHT))
    return nights.select("night", F.explode(times.night_dates(place, place + 2)).alias("date")).withColumn("date", F.col("date").cast("string"))


@query(
    "f5_capture_times", "curves",
    "SELECT night, source, obs_idx, ts FROM curves WHERE obs_idx >= 2 AND obs_idx < 50 AND (obs_idx - 2) % 3 = 0",
)
def _(v):
    from nightlights.sources.frames import slice_frames

    return slice_frames(v.curves.select("night", "source", "ts"), "ts", 2, 50, 3, by=["night", "source"]).select("night", "source", "obs_idx", "ts")


@query("u1_union", "edges source_class", f"{DURATIONS} --- SELECT night, source, duration FROM durations JOIN source_class USING (source)", "duration")
def _(v):
    d = materialize(durations(v).join(v.source_class, "source"), "durations")
    parts = [d.where(op.lamp_group(F.col("lamp_class"), TEST, CONTROL) == g).select("night", "source", "duration") for g in ("test", "control")]
    return parts[0].unionByName(parts[1])


@query("u1_or_of_masks", "pixels", "SELECT r, c FROM pixels GROUP BY night, r, c HAVING max(lum) > 40 UNION SELECT r, c FROM pixels GROUP BY night, r, c HAVING min(lum) < 5")
def _(v):
    nightly = v.pixels.groupBy("night", "r", "c").agg(F.max("lum").alias("most"), F.min("lum").alias("least"))
    return either(nightly.where("most > 40"), nightly.where("least < 5"))


@query("s4_clipped_curves", "curves source_class", "SELECT night, obs_idx, source, lum FROM curves WHERE source IN (SELECT source FROM source_class WHERE score >= 0.35)", "lum")
def _(v):
    return v.curves.select("night", "obs_idx", "source", "lum").join(v.source_class.where("score >= 0.35"), "source", "left_semi").select("night", "obs_idx", "source", "lum")
