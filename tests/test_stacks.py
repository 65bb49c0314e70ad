"""Stacks of vectors against NumPy, lit intervals against samples."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from nightlights.operators import stacks, vectors
from pyspark.sql import functions as F

CHANNELS = 848


@pytest.fixture(scope="module")
def cubes():
    """By scan: (night, rows x columns x channels), of widths of their own."""
    rng = np.random.default_rng(5)
    return {k: ("ab"[k % 2], rng.integers(0, 65535, (3, 5 + k % 3, CHANNELS))) for k in range(6)}


@pytest.fixture(scope="module")
def scans(spark, cubes):
    rows = [(k, night, r, c, x[r, c].tolist()) for k, (night, x) in cubes.items() for r in range(x.shape[0]) for c in range(x.shape[1])]
    return spark.createDataFrame(rows, "scan_id int, night string, r int, c int, spectrum array<int>").repartition(5).cache()


def cube_of(df, shape, by=None):
    out = np.full(shape, np.nan)
    for x in df.collect():
        out[x.r, x.c, x.channel] = x.value
    return out


def test_stack_of_many_channels(scans, cubes):
    want = sum(x[:, :5].astype(np.int64) for _, x in cubes.values())
    assert (cube_of(stacks.stack(scans), want.shape) == want).all()
    assert (cube_of(stacks.stack(scans, wrap=True), want.shape) == want % 65536).all()
    assert (cube_of(stacks.mean_stack(scans), want.shape) == want // 6).all()
    want = sum(x[1:3, 2:4].astype(np.int64) * 2 // 15 for k, (_, x) in cubes.items() if k % 2 == 0)
    assert (cube_of(stacks.box_stack(scans, (1, 3), (2, 4), 7.5, 2), (3, 5, CHANNELS))[1:3, 2:4] == want).all()


def test_channels_become_rows_after_the_last_shuffle(scans):
    plan = stacks.stack(scans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Exchange")  # plans name the last step first


def test_cells_and_vectors_give_the_same(scans):
    long = scans.where("r = 0").select("scan_id", "night", "r", "c", F.posexplode(F.slice("spectrum", 1, 9)).alias("channel", "value"))
    gaps = long.where("(channel + c + scan_id) % 3 > 0")
    got = {(x.r, x.c, x.channel): x.value for x in stacks.stack(gaps).collect()}
    want = {(x.r, x.c, x.channel): x.value for x in gaps.where("c < 5").groupBy("r", "c", "channel").agg(F.sum("value").alias("value")).collect()}
    assert got == want


def test_sums_handed_on_in_parts(spark, scans, cubes, monkeypatch):
    """A task that holds little gives the same sums: in parts, whose last key goes on."""
    rows = [tuple(x) for x in scans.select("r", "c", "spectrum").collect()]
    rows.sort()
    batch = vectors.pa.RecordBatch.from_arrays([*(vectors.pa.array([x[k] for x in rows], vectors.pa.int32()) for k in range(2)), vectors.pa.nulls(len(rows), vectors.pa.list_(vectors.pa.int32())), vectors.pa.array([[float(y) for y in x[2]] for x in rows])], names=["r", "c", "at", "v"])
    monkeypatch.setattr(vectors, "HELD", 3 * CHANNELS)
    pieces = list(vectors._summing(["r", "c"], True)(iter([batch.slice(k, 4) for k in range(0, len(rows), 4)])))
    found = {(r, c): v for p in pieces for r, c, v in zip(*(p.column(k).to_pylist() for k in ("r", "c", "v")), strict=True)}
    assert len(pieces) > 3 and sum(map(len, pieces)) == len(found)
    for (r, c), v in found.items():
        assert v == sum(x[r, c] for _, x in cubes.values() if c < x.shape[1]).tolist()


def test_precision_stack(spark, scans, cubes):
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 3, 2), (1, 2, 2), (2, 4, 9)], "r int, c int, label int")
    lit = {(0, 1), (0, 2), (1, 2), (2, 1), (3, 1), (3, 2), (5, 9)}
    source = {(0, 0): 1, (0, 1): 1, (0, 3): 2, (1, 2): 2, (2, 4): 9}
    want = {}
    for k, (night, x) in cubes.items():
        on = np.array([[(k, source.get((r, c))) in lit for c in range(x.shape[1])] for r in range(3)])
        flat = np.where(on[:, :, None], x, 0).astype(float)
        flat -= np.median(flat, axis=1, keepdims=True)
        for r in range(3):
            for c in range(x.shape[1]):
                want[night, r, c] = want.get((night, r, c), 0) + flat[r, c]
    got = {}
    for x in stacks.precision_stack(scans, labels, spark.createDataFrame(sorted(lit), "scan_id int, source int")).collect():
        got.setdefault((x.night, x.r, x.c), np.zeros(CHANNELS))[x.channel] = x.value
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


def test_lit_intervals_stand_for_samples(spark):
    """Windows before, in, between and after runs of lit samples, with bounds that touch; as few join rows as intervals."""
    rng = random.Random(9)
    second = lambda t: f"2024-01-01 {t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}"
    samples = [(s, second(t), rng.random() < (0.9 if t // 4000 % 2 else 0.03)) for s in range(4) for t in sorted(rng.sample(range(0, 80000, 10), 900))]
    states = spark.createDataFrame(samples, "source int, ts string, lit boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    scans = spark.createDataFrame([(k, second(rng.randrange(0, 80000, 10))) for k in range(150)], "scan_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for minutes in (0.5, 5, 200):
        want = sorted(stacks.lit_in_window(stacks.scan_windows(scans, states, minutes)).collect())
        assert sorted(stacks.lit_sources(scans, states, minutes).collect()) == want and want
    spans = stacks.lit_intervals(states, 5).agg(F.count("*").alias("n"), F.sum("samples").alias("s")).first()
    assert spans.n < spans.s / 3


def test_background_is_no_key(spark, scans):
    labels = spark.createDataFrame([(0, 0, 1)], "r int, c int, label int")
    lit = spark.createDataFrame([(0, 1)], "scan_id int, source int")
    plan = stacks.lit_pixels(scans, labels, lit)._jdf.queryExecution().optimizedPlan().toString()
    join = re.search("Join LeftOuter, (.*)", plan)[1]
    assert "scan_id" in join and "source" not in join
    rows = stacks.lit_pixels(scans, labels, lit).collect()
    assert len(rows) == scans.count() and sum(any(x.spectrum) for x in rows) == 1


def test_lit_intervals_order_cells_not_samples(spark):
    """A source's samples are counted where they lie, however many; runs are the same as those of its samples in order."""
    rng = np.random.default_rng(4)
    at = np.sort(rng.integers(-4_000, 40_000, 150)).tolist()
    states = spark.createDataFrame([(k % 2, t, True) for k, t in enumerate(at)], "source int, t long, lit boolean").selectExpr("source", "CAST(t AS timestamp) AS ts", "lit")
    want = []
    for source in (0, 1):
        for t in at[source::2]:
            if not want or want[-1][0] != source or t - want[-1][2] >= 600:
                want.append([source, t, t, 0])
            want[-1] = [source, want[-1][1], t, want[-1][3] + 1]
    found = stacks.lit_intervals(states, 5)
    assert sorted([r.source, r.first // 10**6, r.last // 10**6, r.samples] for r in found.collect()) == want
    assert "cell" in found._jdf.queryExecution().toString()
