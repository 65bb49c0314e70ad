"""SimHash near-duplicates: fingerprints, exact comparison by tiles, and the groups that links make."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightlights.llm import jaccard
from nightlights.llm import textscan as ts
from nightlights.llm.tables import fresh, quoted, row_key
from nightlights.operators.components import connected_components
from nightlights.runtime import materialize

RADIUS = 3
#: Bits of the fingerprint's parts. Two of five parts agree wherever at most three bits differ.
PARTS = (13, 13, 13, 13, 12)
#: Fingerprints in a tile. A group of fingerprints with equal parts is compared whole if it has no more; otherwise by pairs of tiles.
TILE = 2048


def shingle_fingerprint(text: bytes, n: int) -> int:
    """SimHash of XXH64 (seed 42) over n-word shingles, repeats included; all words where there are fewer, 0 without words."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # both ASCII only on bytes
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    if len(found) <= n:
        return xxh64_intdigest(whole, 42)
    starts = [0, *(ends[: len(found) - n] + 1).tolist()]
    h = np.fromiter((xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, columns: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """columns of docs and fp, the fingerprint's 64 bits as a long. Null and empty texts have fingerprint 0."""
    source = docs.select(*(F.col(quoted(c)) for c in columns), F.col(quoted(text_col)).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in ts.blocks(batches, "_text"):
            fp = np.array([shingle_fingerprint(x, shingle) for x in data], np.uint64).view(np.int64)
            yield ts.record(**{c: rows.column(c) for c in columns}, fp=fp)

    kinds = ", ".join(f"{quoted(c)} {source.schema[c].dataType.simpleString()}" for c in columns)
    return source.mapInArrow(run, f"{kinds}, fp long")


def _keys(fp: Column, radius: int) -> Column:
    """The agreeing parts by which any two fingerprints within radius meet, as one long for each choice of parts."""
    at, parts = 0, []
    for bits in PARTS:
        parts.append((F.shiftrightunsigned(fp, at).bitwiseAND((1 << bits) - 1), bits))
        at += bits
    out = []
    for k, chosen in enumerate(combinations(parts, len(PARTS) - radius)):
        key, shift = F.lit(k).cast("long"), 0
        for part, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(part)
            shift += bits
        out.append(key)
    return F.array(*out)


def _forest(fp: np.ndarray, radius: int, tile: int = 512) -> tuple[list[int], list[int]]:
    """Links of fp that join all that are within radius, one fewer than the members of each connected set.

    fp is sorted by population count; pairs of tiles whose counts differ by more than radius are skipped.
    """
    parent = list(range(len(fp)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    count, a, b = np.bitwise_count(fp).astype(int), [], []
    for i in range(0, len(fp), tile):
        for j in range(i, len(fp), tile):
            if count[j] - count[min(i + tile, len(fp)) - 1] > radius:
                break
            near = np.bitwise_count(fp[i : i + tile, None] ^ fp[None, j : j + tile]) <= radius
            for x, y in zip(*(k.tolist() for k in np.nonzero(np.triu(near, 1) if i == j else near)), strict=True):
                p, q = root(i + x), root(j + y)
                if p != q:
                    parent[q] = p
                    a.append(i + x)
                    b.append(j + y)
    return a, b


def _compare(radius: int):
    """Links within each run of equal cells of a partition sorted by cell and count. A run fits two tiles."""

    def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(first, len(cell)))
        a, b = [], []
        two = first[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        a += fp[near].view(np.int64).tolist()
        b += fp[near + 1].view(np.int64).tolist()
        for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = _forest(part := fp[s : s + n], radius)
            a += part[x].view(np.int64).tolist()
            b += part[y].view(np.int64).tolist()
        return ts.record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, object), np.zeros(0, np.uint64)
        for batch in batches:
            cell = np.concatenate([cell, np.array(batch.column("cell").to_pylist(), object)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(cell) > TILE * 4:
                whole = int(np.searchsorted(cell, cell[-1]))
                if whole:
                    yield links(cell[:whole], fp[:whole])
                    cell, fp = cell[whole:], fp[whole:]
        if len(cell):
            yield links(cell, fp)

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose connected sets are those of all pairs within radius.

    Fingerprints meet where enough parts agree. A group of more than TILE is cut by population count and a salt into
    tiles of about TILE, and each pair of tiles with counts within radius is a cell of its own, in whichever task; other
    pairs of tiles are skipped. Every cell reports a spanning forest, not its pairs.
    """
    keyed = materialize(distinct.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("key"), F.bit_count("fp").cast("int").alias("pop")), "keys")
    by_count = keyed.groupBy("key", "pop").agg(F.count("*").alias("n"))
    groups = by_count.groupBy("key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / TILE).cast("int").alias("s")))).alias("salts")).where("n > 1")
    groups = groups.select("key", F.when(F.col("n") > TILE, F.col("salts")).alias("salts"))
    own = F.pmod(F.xxhash64("fp"), F.element_at("salts", F.col("pop"))).cast("int")
    tile = lambda pop, salt: pop * 1_000_000 + salt
    others = F.flatten(F.transform(F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda q: F.when(F.map_contains_key("salts", q), F.transform(F.sequence(F.lit(0), F.element_at("salts", q) - 1), lambda s: tile(q, s))).otherwise(F.array().cast("array<int>"))))
    rows = keyed.join(groups, "key").withColumn("_own", tile(F.col("pop"), own))
    cells = rows.select("fp", "pop", "key", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit("-"))).otherwise(F.transform(others, lambda t: F.concat_ws("-", F.least("_own", t), F.greatest("_own", t))))).alias("pair"))
    cells = cells.select(F.concat_ws("/", F.lpad(F.col("key").cast("string"), 20, "0"), "pair").alias("cell"), "fp", "pop")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "cell").sortWithinPartitions("cell", "pop").select("cell", "fp").mapInArrow(_compare(radius), "a long, b long").distinct()


def fingerprint_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, grp): for each distinct fingerprint of rows that links to another, the least fingerprint reachable.

    Fingerprints without a link don't appear. Copies count once: rows with equal fingerprints are one node.
    """
    return connected_components(near_links(rows.select("fp").distinct(), radius)).toDF("fp", "grp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint of 16 hexadecimal digits, component_id) for each row.

    component_id is the smallest id reachable over links of at most radius differing bits; rows of equal fingerprints
    (all texts without words among them) are linked. A null id gets the smallest id of its component, null if none has one.
    Other columns aren't read; an empty table gives an empty one.
    """
    rows = materialize(fingerprints(docs, [id_col], text_col, shingle), "fingerprints")
    least = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    groups = least.join(fingerprint_groups(rows, radius), "fp", "left").withColumn("grp", F.coalesce("grp", "fp"))
    least = materialize(groups, "groups")
    component = least.groupBy("grp").agg(F.min("least").alias("component_id"))
    return rows.join(least.join(component, "grp").select("fp", "component_id"), "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_prints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between nodes (node, fp), a < b, whose connected sets are those of all fingerprints within radius."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = nodes.join(first.hint("rebalance"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, other = (first.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")) for c in "ab")
    far = near_links(first.select("fp"), radius).join(one, "a").join(other, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    return materialize(same.union(far).distinct(), "near")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one row of each group, all columns: that of the smallest id (null: last), then of the least row hash.

    Groups are the connected sets of links between texts whose sets of shingles have a Jaccard similarity of 4/5 or more. SimHash
    links texts whose fingerprints differ in at most RADIUS bits, as in simhash_components, and whole sets check each link.
    Since 64 majority bits have no radius that surely covers this similarity, jaccard.py joins what lies farther apart.
    Null texts and texts without words are one group; equal texts are linked, repeated rows among them. Columns of any
    name and type are carried along; an empty table gives an empty one.
    """
    h1, h2 = (fresh(docs.columns, c) for c in ("row_hash", "row_check"))
    marked = docs.withColumns(dict(zip((h1, h2), row_key(docs), strict=True)))
    text = F.col(quoted(text_col)).cast("string").alias("text")
    plain = marked.select(F.col(quoted(id_col)).alias("id"), F.col(h1).alias("h1"), F.col(h2).alias("h2"), text)
    prints = materialize(fingerprints(plain, ["h1", "h2"], "text", shingle), "fingerprints")
    rows = materialize(jaccard.sets(plain, ["id", "h1", "h2"], "text", shingle), "sets")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")
    while True:
        best = materialize(rows.groupBy("node").agg(F.min(order).alias("best"), F.min("twin").alias("lo"), F.max("twin").alias("hi")).select("node", "best.h1", "best.h2", "best", "lo", "hi"), "best")
        clash = best.where("lo <> hi").select("node", F.lit(True).alias("clash"))
        if clash.isEmpty():
            break
        rows = materialize(rows.join(clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "twin")).otherwise(F.col("node"))).drop("clash"), "sets")  # different sets with one hash
    wide = materialize(rows.select("h1", "h2", "node", "n", "wide", "narrow").join(best.select("h1", "h2"), ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["node"]), "wide")

    def texts_of(nodes: DataFrame) -> DataFrame:
        chosen = nodes.join(best.select("node", F.col("h1").alias(h1), F.col("h2").alias(h2)), "node")
        return marked.select(h1, h2, text).join(chosen, [h1, h2]).select("node", "text").dropDuplicates(["node"])

    near = similar_prints(materialize(best.select("node", "h1", "h2").join(prints, ["h1", "h2"]).select("node", "fp").distinct(), "prints"))
    groups = jaccard.similar_groups(rows.select("node", "n", "few"), wide, near, texts_of, shingle)
    grouped = best.join(groups, "node", "left").groupBy(F.coalesce("grp", "node").alias("grp")).agg(F.min("best").alias("best"))
    winners = materialize(grouped.select(F.col("best.h1").alias(h1), F.col("best.h2").alias(h2)), "winners")
    return marked.join(winners, [h1, h2], "left_semi").dropDuplicates([h1, h2]).select(*[F.col(quoted(c)) for c in docs.columns])
