"""Event tables by hand, and a step-by-step restatement on random input."""

from __future__ import annotations

import random

import pytest

from nightlights import registry
from nightlights.jobs import states as jobs
from nightlights.operators import ranks
from nightlights.operators import states as op


def edges(spark, series):
    rows = [("n", k, s, bool(on), bool(off)) for s, steps in enumerate(series) for k, (on, off) in enumerate(steps)]
    return spark.createDataFrame(rows, "night string, obs_idx int, source int, is_on boolean, is_off boolean").selectExpr("*", "CAST(obs_idx AS timestamp) AS ts")


def walk(steps):
    """Durations by walking through the events."""
    anchor, total, on = 0, 0, None
    for k, (a, b) in enumerate(steps):
        if a and not b and on is None:
            on = k
        if b and not a:
            total += k - (on if on is not None else anchor)
            anchor, on = k, None
    return total


def test_event_durations(spark):
    cases = [[(0, 0), (0, 1)], [(1, 0), (0, 0), (0, 1), (0, 1)], [(1, 0), (1, 0), (0, 1)], [(1, 1), (0, 1)], [(0, 1), (1, 0), (0, 0)], [(0, 0)]]
    rng = random.Random(3)
    cases += [[(rng.random() < 0.3, rng.random() < 0.3) for _ in range(20)] for _ in range(30)]
    found = {r.source: r.steps for r in op.event_durations(edges(spark, cases)).collect()}
    assert found == {s: walk(steps) for s, steps in enumerate(cases)}


def test_states(spark):
    """Lit from on until off; before a first off; off wins a tie going forward, on going back."""
    cases = [[(0, 0), (1, 0), (0, 0), (0, 1), (0, 0)], [(0, 0), (0, 1), (0, 0)], [(0, 0), (1, 1), (0, 0)]]
    got = {}
    for r in op.lit_states(edges(spark, cases)).collect():
        got[r.source, r.obs_idx] = r.lit
    assert [got[0, k] for k in range(5)] == [False, True, True, True, False]
    assert [got[1, k] for k in range(3)] == [True, True, False]
    assert [got[2, k] for k in range(3)] == [False, False, False]


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    e = edges(spark, [[(rng.random() < 0.3, rng.random() < 0.3) for _ in range(15)] for _ in range(10)])
    one = sorted(op.lit_states(e.coalesce(1)).collect())
    assert one == sorted(op.lit_states(e.repartition(7)).collect())


def test_standardised_totals_and_histogram(spark):
    """By the formula, over a matrix of nights and sources."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(0, 900, (3, 7)).astype(float)
    x[2] = 50.0
    rows = [(f"n{i}", j, float(x[i, j])) for i in range(3) for j in range(7)]
    d = np.abs(x - x.mean(1, keepdims=True))
    sd = d.std(1, keepdims=True)
    want = np.where(sd > 0, d / np.where(sd > 0, sd, 1), 0).sum(0)
    totals = op.standardised_totals(spark.createDataFrame(rows, "night string, source int, duration double"))
    got = {r.source: r.total for r in totals.collect()}
    assert np.allclose([got[j] for j in range(7)], want)
    one = totals.selectExpr("total", "source % 2 = 0 AS even")
    found = {(r.even, r.bin): r.n for r in op.histogram(one, "total", ["even"], 4).collect()}
    for even in (True, False):
        part = np.array([want[j] for j in range(7) if (j % 2 == 0) == even])
        count, _ = np.histogram(part, 4)
        assert [found.get((even, k), 0) for k in range(4)] == count.tolist()


def test_significance(spark):
    """Normalised Anderson-Darling statistic of the paper's four laboratories, and p of t statistics by numeric integration."""
    import math

    import numpy as np
    from nightlights.functions.stats import student_p
    from pyspark.sql import functions as F

    labs = {  # fixed values: Scholz and Stephens (1987), smoothness of paper
        "A": [38.7, 41.5, 43.8, 44.5, 45.5, 46.0, 47.7, 58.0], "B": [39.2, 39.3, 39.7, 41.4, 41.8, 42.9, 43.3, 45.8],
        "C": [34.0, 35.0, 39.0, 40.0, 43.0, 43.0, 44.0, 45.0], "D": [34.0, 34.8, 34.8, 35.4, 37.2, 37.8, 41.2, 42.8],
    }
    df = spark.createDataFrame([(k, x) for k, v in labs.items() for x in v], "grp string, total double")
    r = op.anderson_darling(df).first()
    assert abs(r.statistic - 4.480) < 0.005 and abs(r.p - 0.00236) < 0.0005 and (r.n, r.k) == (32, 4)
    few = op.anderson_darling(df.limit(2)).first()
    assert few.statistic is None and few.p is None
    for t, n in ((0.3, 1), (2.1, 2), (1.0, 3), (2.5, 6), (0.0, 9), (4.0, 12)):
        x = np.linspace(0, t, 20001)
        c = math.gamma((n + 1) / 2) / math.sqrt(n * math.pi) / math.gamma(n / 2)
        want = 1 - 2 * np.trapezoid(c * (1 + x * x / n) ** (-(n + 1) / 2), x)
        got = spark.range(1).select(student_p(F.lit(-t), F.lit(n)).alias("p")).first().p
        assert abs(got - want) < 1e-6, (t, n)


def test_states_take_no_frame_to_the_end(spark):
    """A frame that ends with the series is summed up anew for each row, in time with the square of a series' length."""
    plan = op.lit_states(edges(spark, [[(1, 0)]]))._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("take", [op.ever_lit, op.quiet_nights, op.standardised_totals])
def test_states_are_found_once(spark, take):
    """What reads durations several times doesn't find the states behind them each time."""
    found = take(op.lit_durations(op.lit_states(edges(spark, [[(1, 0), (0, 0), (0, 1)]]))))
    assert "is_on" not in found._jdf.queryExecution().toString()


#: Queries on lit states whose time goes with the length of a series, not with its square.
LINEAR = [
    "w7_lit_state",
    "w8_lit_states",
    "j11_attributes",
    "w11_rank_by_duration",
    "j4_lit_pixels",
    "a14_precision_stack",
    "j4_lit_in_window",
    "p12_ever_lit",
    "p9_quiet_nights",
    "w12_standardised_totals",
    "u1_union",
    "x1_groups",
    "a23_histogram",
    "x2_anderson_darling",
    "a25_colour_durations",
]


@pytest.mark.parametrize("name", LINEAR)
def test_queries_take_no_frame_to_the_end(spark, sf_dir, monkeypatch, name):
    for module in (op, ranks, jobs):
        monkeypatch.setattr(module, "materialize", lambda df, tag="": df, raising=False)
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString().lower()
    assert "is_off" in plan and "unboundedfollowing" not in plan
