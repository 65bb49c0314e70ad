"""Running sums over ranges, and what is ranked by them."""

from __future__ import annotations

import random

import numpy as np
from nightlights.operators import learning, states
from nightlights.operators.ranks import running
from pyspark.sql import functions as F


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), k, rng.randint(-3, 9)) for k in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "k string, at int, x int").repartition(5)
    want = {}
    total, n = {}, {}
    for k, at, x in sorted(rows):
        total[k], n[k] = total.get(k, 0) + x, n.get(k, 0) + 1
        want[k, at] = (total[k], n[k])
    found = running(df, [F.col("at")], {"s": F.col("x"), "n": F.lit(1)}, ["k"])
    assert found.columns == ["k", "at", "x", "s", "n"] and {(r.k, r.at): (r.s, r.n) for r in found.collect()} == want
    down = running(df, [F.col("x").desc(), F.col("at")], {"n": F.lit(1)})
    assert [r.n for r in sorted(down.collect(), key=lambda r: (-r.x, r.at))] == list(range(1, 3001))
    assert running(df.where("false"), [F.col("at")], {"s": F.col("x")}, ["k"]).count() == 0


def test_a_group_of_ties_lies_in_several_ranges(spark):
    """All values equal: sources order them, and no range has most of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(8000).selectExpr("'n' AS night", "CAST(id AS INT) source", "0.0D duration")
        found = states.rank_sources(df, F.col("duration"))
        assert all(r.rank == r.source + 1 for r in found.collect())
        sizes = df.repartitionByRange(F.col("night"), F.col("duration").desc(), F.col("source")).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_em(x, k, kind, mean, spread, rounds, ridge):
    """Expectation-maximisation with whole covariances of every kind; the log likelihood before the last update."""
    cov, weight, d = np.stack([np.diag(spread)] * k), np.full(k, 1 / k), x.shape[1]
    for _ in range(rounds):
        logp = np.stack([np.log(weight[i]) - 0.5 * (np.einsum("nd,de,ne->n", x - mean[i], np.linalg.inv(cov[i]), x - mean[i]) + np.linalg.slogdet(cov[i])[1] + d * np.log(2 * np.pi)) for i in range(k)], 1)
        total = np.logaddexp.reduce(logp, axis=1)
        r = np.exp(logp - total[:, None])
        n = r.sum(0)
        mean, weight = r.T @ x / n[:, None], n / n.sum()
        cov = np.stack([((x - mean[i]) * r[:, i, None]).T @ (x - mean[i]) / n[i] for i in range(k)])
        if kind == "tied":
            cov = np.stack([(cov * weight[:, None, None]).sum(0)] * k)
        elif kind != "full":
            var = np.diagonal(cov, axis1=1, axis2=2)
            cov = np.stack([np.diag(np.full(d, v.mean()) if kind == "spherical" else v) for v in var])
        cov = cov + ridge * np.eye(d)
    return total.sum()


def test_mixtures_against_plain_em(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, s, (120, 3)) for m, s in ((0, 1), (4, 0.5), (-3, 2))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "source int, spectrum array<double>").repartition(3)
    models = [(k, kind) for k in (2, 3) for kind in ("spherical", "tied", "diag", "full")]
    got = learning.mixture_bics(df, models, rounds=6)
    first = np.array([r.x for r in df.select(F.col("spectrum").alias("x")).orderBy(F.xxhash64(F.lit(1), F.col("x").cast("string"))).limit(3).collect()])
    for (k, kind), bic in zip(models, got, strict=True):
        free = {"spherical": k, "diag": k * 3, "tied": 6, "full": k * 6}[kind] + k * 3 + k - 1
        want = -2 * plain_em(x, k, kind, first[:k], x.var(0) + 1e-6, 6, 1e-6) + free * np.log(len(x))
        assert abs(bic - want) < 1e-6 * abs(want)
