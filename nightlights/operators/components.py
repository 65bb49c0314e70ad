"""Connected components by rounds of neighbourhood minima and pointer jumping, and of image masks by tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightlights.operators.ranks import numbered
from nightlights.runtime import materialize

#: Side of a tile in pixels.
TILE = 128


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the undirected edges; component is the least node reachable.

    Each round links every node of a larger neighbourhood to its least member (large star), then every node's smaller
    neighbours to the least of them (small star), until the edges no longer change. Nodes without edges don't appear;
    rows with a null end are ignored and self-loops give one-node components. Rounds are cut by written tables. After some
    rounds a component's least node has all its members: the minima that edges meet are dealt anew before each join, so that
    both of its sides are plain exchanges, of which Spark splits one that is too large.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = materialize(both.select("u").union(both.select("v")).distinct(), "nodes")
    now = materialize(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit("check"), "u", "v"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.withColumnRenamed("u", "node"), nodes["u"] == F.col("node"), "left").select(nodes["u"].alias("node"), F.coalesce("v", nodes["u"]).alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
    return sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
    small = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return small.where("u <> v").distinct()


def adjacent(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): ids of neighbouring cells (keys, r, c, id) of a mask. Each is sent to the pairs that it begins and ends."""
    side = lambda name, dr, dc, first: F.struct(F.lit(name).alias("side"), (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(first).alias("first"))
    ends = F.array(side("right", 0, 0, True), side("right", 0, 1, False), side("down", 0, 0, True), side("down", 1, 0, False))
    rows = cells.select(*keys, "id", F.explode(ends).alias("e")).select(*keys, "e.side", "e.r", "e.c", "e.first", "id")
    both = rows.groupBy(*keys, "side", "r", "c").agg(F.max(F.when(F.col("first"), F.col("id"))).alias("a"), F.max(F.when(~F.col("first"), F.col("id"))).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the least of the numbers that each one is joined with, after a and b are joined too: they take the lesser of their
    roots, and roots are followed to their ends, until nothing changes."""
    root = root.copy()
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def joined_cells(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For cells in row order, the first cell of each one's 4-connected component."""
    place = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), -1)
    place[r - r.min(), c - c.min()] = np.arange(len(r))
    a, b = np.concatenate([place[:, :-1].ravel(), place[:-1].ravel()]), np.concatenate([place[:, 1:].ravel(), place[1:].ravel()])
    a, b = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
    return joined(np.arange(len(r)), a, b)


def tile_components(mask: DataFrame, ncol: int, keys: list[str]) -> DataFrame:
    """keys, r, c, root: the mask's cells (r * ncol + c), each with the first cell of its component within its tile."""
    types = {f.name: f.dataType.simpleString() for f in mask.schema.fields}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell = np.unique(table.column("r").to_numpy().astype(np.int64) * ncol + table.column("c").to_numpy())
        r, c = np.divmod(cell, ncol)
        named = {k: pa.array([v.as_py()] * len(cell), v.type) for k, v in zip(keys, key, strict=False)}
        return pa.table(named | {"r": pa.array(r.astype(np.int32)), "c": pa.array(c.astype(np.int32)), "root": pa.array(cell[joined_cells(r, c)])})

    tiles = mask.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.floor(F.col("r") / TILE).alias("_tr"), F.floor(F.col("c") / TILE).alias("_tc"))
    return tiles.groupBy(*keys, "_tr", "_tc").applyInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "r int, c int, root long"]))


def label_components(mask: DataFrame, ncol: int, keys: list[str] | None = None) -> DataFrame:
    """keys, r, c, label of the mask's 4-connected components, numbered within keys by their first pixel in row order.

    Tiles are joined up in their own tasks. Links between them are those of cells on their edges, so the graph that takes rounds
    has a node for each part of a component in a tile, not for each pixel; numbers are counted in bands of rows.
    """
    keys = keys or []
    cells = materialize(tile_components(mask, ncol, keys), "tiles")
    node = F.struct(*keys, "root")
    edge = F.col("r") % TILE, F.col("c") % TILE
    border = cells.where((edge[0] == 0) | (edge[0] == TILE - 1) | (edge[1] == 0) | (edge[1] == TILE - 1)).select(*keys, "r", "c", node.alias("id"))
    links = materialize(adjacent(border, keys).where("a <> b").distinct(), "links")
    parts = cells.select(node.alias("id")).distinct()
    if not links.isEmpty():
        parts = parts.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("first"))
    else:
        parts = parts.select("id", F.col("id").alias("first"))
    firsts = parts.select("first").distinct().select("first", *[F.col(f"first.{k}").alias(k) for k in keys])
    number = numbered(firsts, F.floor(F.col("first.root") / (ncol * TILE)), [F.col("first.root")], "label", keys).select("first", (F.col("label") + 1).cast("int").alias("label"))
    labels = parts.join(number, "first").select("id", "label")
    return cells.withColumn("id", node).join(labels, "id").select(*keys, "r", "c", "label")
