"""Lit states, durations and what is made of them. Series go by (night, source) in the order of obs_idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightlights.functions.stats import anderson_normal, student_p
from nightlights.operators.ranks import running
from nightlights.runtime import materialize

SERIES = ["night", "source"]


def _by():
    return Window.partitionBy(*SERIES).orderBy("obs_idx")


def event_value(is_on: Column, is_off: Column) -> Column:
    """+1 for on, -1 for off, 0 for both or neither."""
    return is_on.cast("int") - is_off.cast("int")


def lit_states(edges: DataFrame) -> DataFrame:
    """edges' keys and lit: on since the last event, where off wins a tie, or until the next one, where on wins.

    The next event is the last one in descending order: a frame up to the end of a series is summed up anew for each row."""
    before = F.last(F.when(F.col("is_off"), 0).when(F.col("is_on"), 1), ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, 0))
    backwards = Window.partitionBy(*SERIES).orderBy(F.desc("obs_idx")).rowsBetween(Window.unboundedPreceding, 0)
    after = F.last(F.when(F.col("is_on"), 0).when(F.col("is_off"), 1), ignorenulls=True).over(backwards)
    return edges.select("night", "obs_idx", "ts", "source", ((F.coalesce(before, F.lit(0)) == 1) | (F.coalesce(after, F.lit(0)) == 1)).alias("lit"))


def lit_durations(states: DataFrame, step_s: float = 10.0) -> DataFrame:
    """Seconds lit for each night and source."""
    return states.groupBy(*SERIES).agg(F.sum(F.when(F.col("lit"), step_s).otherwise(0.0)).alias("duration"))


def event_durations(edges: DataFrame) -> DataFrame:
    """Steps lit by events: each off counts from the first on since the off before it, or else from that off, or 0.

    On and off in one step cancel out; further ons are ignored; an on without a later off adds nothing.
    """
    events = edges.where(F.col("is_on") != F.col("is_off"))
    offs_before = F.coalesce(F.sum(F.col("is_off").cast("int")).over(_by().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretch = events.withColumn("k", offs_before).groupBy(*SERIES, "k").agg(F.min(F.when(F.col("is_on"), F.col("obs_idx"))).alias("on"), F.max(F.when(F.col("is_off"), F.col("obs_idx"))).alias("off"))
    previous = F.lag("off").over(Window.partitionBy(*SERIES).orderBy("k"))
    total = stretch.withColumn("from", F.coalesce("on", previous, F.lit(0))).where("off IS NOT NULL").groupBy(*SERIES).agg(F.sum(F.col("off") - F.col("from")).alias("steps"))
    return edges.select(*SERIES).distinct().join(total, SERIES, "left").select(*SERIES, F.coalesce("steps", F.lit(0)).cast("long").alias("steps"))


def last_off(edges: DataFrame) -> DataFrame:
    """Time of the last off of each night and source, null without one."""
    return edges.groupBy(*SERIES).agg(F.max(F.when(F.col("is_off"), F.col("ts"))).alias("last_off"))


def mean_last_off_index(edges: DataFrame) -> DataFrame:
    """Mean over the nights of the last off's place, nights without one, or with place 0, left out."""
    nightly = edges.groupBy(*SERIES).agg(F.max(F.when(F.col("is_off"), F.col("obs_idx"))).alias("last"))
    return nightly.groupBy("source").agg(F.avg(F.nullif("last", F.lit(0))).alias("mean_last"))


def light_stats(durations: DataFrame, classes: DataFrame, nights: int = 29) -> DataFrame:
    """Per lamp class and in all (lamp_class 'all'): sources, those ever lit, hours, mean hours and mean nightly minutes of the latter."""
    totals = durations.groupBy("source").agg(F.sum("duration").alias("total")).join(classes, "source")
    on = F.when(F.col("total") > 0, F.col("total"))
    return totals.rollup("lamp_class").agg(
        F.count("*").alias("n_sources"), F.count(on).alias("n_on"), (F.sum("total") / 3600).alias("hours"), (F.avg(on) / 3600).alias("hours_per_source"), (F.avg(on) / (60 * nights)).alias("minutes_per_night"), F.grouping("lamp_class").alias("g")
    ).select(F.when(F.col("g") == 1, "all").otherwise(F.col("lamp_class")).alias("lamp_class"), "n_sources", "n_on", "hours", "hours_per_source", "minutes_per_night")


def off_counts(edges: DataFrame, width: int = 180) -> DataFrame:
    """Offs in each bin of width steps for each night, empty bins included, with the night's place modulo 7."""
    counts = edges.groupBy("night", F.floor(F.col("obs_idx") / width).cast("int").alias("bin")).agg(F.sum(F.col("is_off").cast("long")).alias("n_off"))
    last = counts.agg(F.max("bin").alias("last"))
    nights = counts.select("night").distinct().withColumn("weekday", F.pmod(F.datediff("night", F.lit("1970-01-01")), F.lit(7)))
    grid = nights.crossJoin(last).select("night", "weekday", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin"))
    return grid.join(counts, ["night", "bin"], "left").select("night", "weekday", "bin", F.coalesce("n_off", F.lit(0)).alias("n_off"))


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 100) -> DataFrame:
    """Counts of value in equal bins from the group's least to its most; the last bin is closed."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in by]
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    return df.withColumns({f"_{c}": k for c, k in zip(by, keys, strict=True)}).join(ends, [f"_{c}" for c in by]).groupBy(*by, F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def quiet_nights(durations: DataFrame, k: float = 2.0, share: float = 0.05) -> DataFrame:
    """durations of the nights on which fewer than share of the sources exceed their own mean + k deviations."""
    durations = materialize(durations, "durations")
    limits = durations.groupBy("source").agg((F.avg("duration") + k * F.stddev_pop("duration")).alias("limit"))
    good = durations.join(limits, "source").groupBy("night").agg(F.avg((F.col("duration") > F.col("limit")).cast("int")).alias("above")).where(F.col("above") < share)
    return durations.join(good, "night", "left_semi")


def ever_lit(durations: DataFrame) -> DataFrame:
    """durations of sources with a positive total."""
    durations = materialize(durations, "durations")
    return durations.join(durations.groupBy("source").agg(F.sum("duration").alias("total")).where("total > 0"), "source", "left_semi")


def rank_by_last_event(edges: DataFrame, night: str, other: str) -> DataFrame:
    """Sources ranked by their last event on night, and (rank, obs_idx) of their events on other."""
    event = F.col("is_on") | F.col("is_off")
    last = edges.where(event & (F.col("night") == night)).groupBy("source").agg(F.max("obs_idx").alias("last"))
    ranked = running(last, [F.col("last"), F.col("source")], {"rank": F.lit(1)}).select("source", F.col("rank").cast("int").alias("rank"))
    return edges.where(event & (F.col("night") == other)).join(ranked, "source").select("source", "rank", "obs_idx")


def relative_brightness(curves: DataFrame) -> DataFrame:
    """Brightness as a share of the series' largest."""
    return curves.select(*SERIES, "obs_idx", (F.col("lum") / F.max("lum").over(Window.partitionBy(*SERIES))).alias("share"))


def rank_sources(df: DataFrame, value: Column, by: str = "night") -> DataFrame:
    """by, source and rank within by, by value descending, then by source."""
    rows = df.select(by, "source", value.alias("_value"))
    return running(rows, [F.col("_value").desc(), F.col("source")], {"rank": F.lit(1)}, [by]).select(by, "source", F.col("rank").cast("int").alias("rank"))


#: Orders by colour: what each ranks by, descending.
COLOUR_RANKS = {"red": "red", "green": "green", "blue": "blue", "r-b": "red - blue", "b-r": "blue - red", "b-g": "blue - green", "r-g": "red - green"}


def rank_by_colour(fractions: DataFrame) -> DataFrame:
    """(by, source, rank) for each order of COLOUR_RANKS of sources with colour fractions (source, red, green, blue)."""
    long = fractions.select("source", F.explode(F.create_map(*[x for k, e in COLOUR_RANKS.items() for x in (F.lit(k), F.round(F.expr(e), 9))])).alias("by", "value"))
    return rank_sources(long, F.col("value"), "by")


def off_regression(last: DataFrame, colours: DataFrame, y: str = "mean_last", x: str = "score") -> DataFrame:
    """(n, slope, intercept, r, p) of y over x by source; p is two-sided, of the slope's t statistic with n - 2 degrees of freedom."""
    both = last.join(colours, "source").where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = both.agg(F.count("*").cast("int").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") ** 2))
    return fit.withColumn("p", F.when(F.abs("r") < 1, student_p(t, F.col("n") - 2)).when(F.abs("r") >= 1, 0.0))


def standardised_totals(durations: DataFrame) -> DataFrame:
    """Each source's sum over the nights of its duration's distance from the night's mean, in deviations (population) of these
    distances over the night; 0 on a night without spread. Aggregates are joined back: a night is one large group, which a
    window would keep in one task."""
    durations = materialize(durations, "durations")
    mean = durations.groupBy("night").agg(F.avg("duration").alias("mean"))
    apart = durations.join(mean, "night").select("night", "source", F.abs(F.col("duration") - F.col("mean")).alias("d"))
    spread = apart.groupBy("night").agg(F.stddev_pop("d").alias("sd"))
    return apart.join(spread, "night").groupBy("source").agg(F.sum(F.when(F.col("sd") > 0, F.col("d") / F.col("sd")).otherwise(0.0)).alias("total"))


#: Efficient lamps against conventional ones; the fixture's market segments stand for lamp classes.
TEST, CONTROL = ("LED", "fluorescent"), ("HPS", "MH", "LPS")


def lamp_group(lamp_class: Column, test=TEST, control=CONTROL) -> Column:
    return F.when(lamp_class.isin(*test), "test").when(lamp_class.isin(*control), "control")


def anderson_darling(df: DataFrame, value: str = "total", group: str = "grp") -> DataFrame:
    """One row (a2, n, k, H, statistic, p): the k-sample statistic with midranks over the groups of df, its normalised form and
    the latter's p, held to 0.001 .. 0.25. Null groups and values are left out.

    Counts per distinct value are cumulated over ranges of values, so that a group of any size lies in several tasks. One row of
    sums comes out, which alone is normalised in Python.
    """
    rows = materialize(df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value), "totals")
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    at = rows.groupBy(value, group).agg(F.count("*").alias("f"))
    every = at.groupBy(value).agg(F.sum("f").alias("l"))
    total = sizes.agg(F.sum("n").alias("all"), F.count("*").alias("k"), F.sum(1 / F.col("n")).alias("H"))
    grid = every.crossJoin(sizes).join(at, [value, group], "left").fillna(0, ["f"])
    summed = running(grid, [F.col(value)], {"_f": F.col("f"), "_l": F.col("l")}, [group])
    cum = summed.withColumns({"M": F.col("_f") - F.col("f") / 2, "B": F.col("_l") - F.col("l") / 2}).crossJoin(total)
    inner = F.col("l") / F.col("all") * (F.col("all") * F.col("M") - F.col("B") * F.col("n")) ** 2 / (F.col("B") * (F.col("all") - F.col("B")) - F.col("all") * F.col("l") / 4)
    a2 = cum.groupBy(group).agg((F.sum(inner) / F.first("n")).alias("part")).agg(F.sum("part").alias("s")).crossJoin(total)
    row = a2.select((F.col("s") * (F.col("all") - 1) / F.col("all")).alias("a2"), F.col("all").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "H")
    return row.mapInPandas(anderson_normal, "a2 double, n long, k long, H double, statistic double, p double")
