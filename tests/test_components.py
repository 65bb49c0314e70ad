"""Components of graphs and masks: hubs, snakes over many tiles, numbers by first pixel."""

from __future__ import annotations

import numpy as np
import pytest
from nightlights.operators import components as op
from nightlights.runtime import materialize


def labelled(mask):
    """Labels by flooding, numbered in row order."""
    out, n = np.zeros(mask.shape, int), 0
    for r, c in np.argwhere(mask):
        if not out[r, c]:
            n += 1
            todo = [(r, c)]
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = n
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def snake(n):
    """One path that turns at each end of every second row."""
    mask = np.zeros((n, n), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    return mask


@pytest.mark.parametrize("tile", [3, 4, 128])
@pytest.mark.parametrize("mask", [snake(21), np.random.default_rng(1).random((23, 19)) < 0.6, np.ones((9, 9), bool), np.eye(9, dtype=bool)], ids=["snake", "random", "full", "diagonal"])
def test_masks_in_tiles(spark, monkeypatch, tile, mask):
    monkeypatch.setattr(op, "TILE", tile)
    rows = [(int(r), int(c)) for r, c in np.argwhere(mask)]
    got = np.zeros(mask.shape, int)
    for x in op.label_components(spark.createDataFrame(rows + rows[:3], "r int, c int"), mask.shape[1]).collect():
        got[x.r, x.c] = x.label
    assert (got == labelled(mask)).all()


def test_masks_by_frame(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE", 4)
    rng = np.random.default_rng(2)
    masks = {k: rng.random((11, 13)) < 0.5 for k in "abc"}
    rows = [(k, int(r), int(c)) for k, m in masks.items() for r, c in np.argwhere(m)]
    got = {k: np.zeros(m.shape, int) for k, m in masks.items()}
    for x in op.label_components(spark.createDataFrame(rows, "frame string, r int, c int").repartition(5), 13, ["frame"]).collect():
        got[x.frame][x.r, x.c] = x.label
    assert all((got[k] == labelled(m)).all() for k, m in masks.items())
    assert op.label_components(spark.createDataFrame([], "r int, c int"), 5).count() == 0


def test_nodes_of_the_graph_are_parts_in_tiles(spark, monkeypatch):
    """A full mask of 64 x 64 pixels in tiles of 16 is a graph of 16 nodes, not of 4,096."""
    monkeypatch.setattr(op, "TILE", 16)
    seen = []
    whole = op.connected_components
    monkeypatch.setattr(op, "connected_components", lambda links: seen.append(links.select("a").union(links.select("b")).distinct().count()) or whole(links))
    mask = spark.range(64 * 64).selectExpr("CAST(id DIV 64 AS INT) r", "CAST(id % 64 AS INT) c")
    assert {x.label for x in op.label_components(mask, 64).collect()} == {1} and seen == [16]


def test_random_graphs(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500, 500), (None, 3)]
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(300):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = op.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in got} == root and len(got) == len(root)


def test_a_hub_is_split(spark):
    """Both joins of a round on a star: Spark splits the hub's partition, as neither side is an aggregate."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        star = materialize(spark.range(1, 200_000).selectExpr("xxhash64(id) & 9223372036854775807 AS u", "0L AS v"))
        for step in (op._large_star(star), op._small_star(star.selectExpr("v AS u", "u AS v"))):
            step.collect()
            assert "skew=true" in step._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert op.connected_components(star, "u", "v").where("component <> 0").count() == 0
