"""Substring dedup over words: a compacted de Bruijn graph whose edges are the windows of WINDOW words.

Consecutive windows with one minimizer (the least hashed K-word piece) form an unbranched path already, a segment. Only
segments whose minimizer several documents have can hold repeated edges. Spark joins compact further: segments that
always follow one another make a path. Where segments with one minimizer differ, the graph branches, and their windows are
looked at one by one. Every edge knows its source, the place of its first occurrence: spans are runs along a path with
one source, and the words there, fetched by these coordinates, verify them before anything is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightlights.llm import textscan as ts
from nightlights.llm.tables import quoted
from nightlights.runtime import materialize

WINDOW = 50
K = 20
W = WINDOW - K + 1
_POSITION = np.uint64((1 << 24) - 1)


class Words:
    """Words of some texts, and prefix hashes over them."""

    def __init__(self, data: list[bytes]):
        self.buf, at = ts.joined(data)
        self.start, self.end = ts.words(self.buf, ~ts.SPACE[self.buf])
        self.cut = np.searchsorted(self.start, at)
        self.prefix = ts.prefix_hash(ts.span(ts.prefix_hash(ts.symbol_codes()[self.buf]), self.start, self.end))

    def segments(self) -> tuple[np.ndarray, ...]:
        """(text, first window, windows, minimizer's hash, hash of all words) of each segment, in order."""
        n = len(self.start)
        empty = np.zeros(0, np.int64)
        if n < WINDOW:
            return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        where = np.arange(n - K + 1)
        h = ts.span(self.prefix, where, where + K)
        least = np.empty(n - WINDOW + 1, np.int64)
        step = int(_POSITION) + 2 - W  # a place within so many windows fits the packed bits
        for low in range(0, len(least), step):
            part = h[low : min(low + step, len(least)) + W - 1]
            v, width = part & ~_POSITION | np.arange(len(part), dtype=np.uint64), 1
            while width * 2 <= W:
                v = np.minimum(v[:-width], v[width:])
                width *= 2
            least[low : low + step] = (np.minimum(v[: len(v) - (W - width)], v[W - width :]) & _POSITION).astype(np.int64) + low
        owner = np.searchsorted(self.cut, np.arange(len(least)), "right") - 1
        start = np.flatnonzero(np.arange(len(least)) + WINDOW <= self.cut[owner + 1])
        owner, least = owner[start], least[start]
        new = np.ones(len(start), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        low = start[first]
        count = np.diff(np.append(first, len(start)))
        place = least[first]
        whole = ts.span(self.prefix, low, low + count + WINDOW - 1) ^ ts.mix((place - low).astype(np.uint64) + np.uint64(1))
        return owner[first], low - self.cut[owner[first]], count, ts.mix(h[place] ^ np.uint64(5)), whole


def segments(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, at, n, minimizer, segment) of each segment of docs (doc, text_hash, text): n windows from word at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in ts.blocks(batches):
            text, at, n, minimizer, whole = Words(data).segments()
            pick = pa.array(text)
            yield ts.record(doc=rows.column("doc").take(pick), text_hash=rows.column("text_hash").take(pick), at=at.astype(np.int32), n=n.astype(np.int16), minimizer=minimizer.view(np.int64), segment=whole.view(np.int64))

    return docs.select("doc", "text_hash", "text").mapInArrow(run, "doc long, text_hash long, at int, n smallint, minimizer long, segment long")


def compact(links: DataFrame) -> DataFrame:
    """(segment, path, place) of segments on unbranched paths of distinct links (a, b): path is the first segment's name.

    A link is unbranched if a has no other successor and b no other predecessor; degrees are counted before anything is
    joined, so a segment with very many neighbours takes part in no join. Each round joins every segment with the one it
    points back to, so places double; what a round reaches is written down. Segments in a ring, which has no first, are
    not returned.
    """
    out = links.groupBy("a").agg(F.count("*").alias("n"), F.max("b").alias("b")).where("n = 1").select("a", "b")
    single = out.join(links.groupBy("b").agg(F.count("*").alias("n"), F.max("a").alias("a")).where("n = 1").select("a", "b"), ["a", "b"]).where("a <> b")
    single = materialize(single, "single")
    now = single.select(F.col("b").alias("segment"), F.col("a").alias("back"), F.lit(1).alias("place"))
    heads = single.select(F.col("a").alias("segment")).join(single.select(F.col("b").alias("segment")), "segment", "left_anti").distinct().select("segment", F.col("segment").alias("back"), F.lit(0).alias("place"))
    now = materialize(now.union(heads), "paths")
    heads = materialize(heads.select(F.col("segment").alias("head")), "heads")
    rounds = math.ceil(math.log2(now.count() + 2)) + 1
    open_before = None
    for _ in range(rounds):
        for _ in range(2):
            to = now.select(F.col("segment").alias("back"), F.col("back").alias("further"), F.col("place").alias("more"))
            now = now.join(to, "back").select("segment", F.col("further").alias("back"), (F.col("place") + F.col("more")).alias("place"))
        now = materialize(now, "paths")
        still = now.join(heads, now["back"] == heads["head"], "left_anti").count()
        if not still or still == open_before:
            break
        open_before = still
    return now.join(heads, now["back"] == heads["head"], "left_semi").select("segment", F.col("back").alias("path"), "place")


def _digest(words: list[bytes]) -> bytes:
    """Names a sequence of words; words hold no spaces."""
    return blake2b(b" ".join(words), digest_size=16).digest()


def _runs(rows: DataFrame) -> DataFrame:
    """(doc, text_hash, at, n, source) of the maximal runs of rows (doc, text_hash, at, n, path, place, source) whose windows
    follow one another, along one path and in one source document alike. source: its doc, text_hash and at."""
    on = Window.partitionBy("doc", "text_hash").orderBy("at")
    before = lambda c: F.lag(c).over(on)
    step = F.col("at") - before("at")
    same = (before("path") == F.col("path")) & (before("place") == F.col("place") - 1) & (before("at") + before("n") == F.col("at"))
    same &= (before("source.doc") == F.col("source.doc")) & (before("source.text_hash") == F.col("source.text_hash")) & (F.col("source.at") - before("source.at") == step)
    run = rows.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc", "text_hash", "run").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.min("source").alias("source")).drop("run")


def _repeats(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, at, n, digest): windows at, at + 1, ... of docs that a smaller document has too, and the digest of that
    document's words there. Segments and windows are known by two hashes, their minimizer's and their own."""
    every = materialize(segments(docs.where("doc IS NOT NULL")), "segments")
    shared = every.groupBy("minimizer").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("minimizer")
    shared = materialize(shared, "minimizers")  # read back, the join below has plain exchanges, of which Spark splits a hot one
    found = materialize(every.join(shared, "minimizer"), "shared")
    source = F.min(F.struct("doc", "text_hash", "at")).alias("source")
    kinds = materialize(found.groupBy("minimizer", "segment").agg(source, F.max("doc").alias("last")), "kinds")
    repeated = kinds.where("source.doc < last").select("minimizer", "segment", "source")
    marked = materialize(found.join(repeated, ["minimizer", "segment"]).drop("minimizer"), "marked")
    by_text = Window.partitionBy("doc", "text_hash").orderBy("at")
    follows = (F.lead("at").over(by_text) == F.col("at") + F.col("n")).alias("follows")
    links = marked.select("segment", F.lead("segment").over(by_text).alias("next"), follows).where("follows").select(F.col("segment").alias("a"), F.col("next").alias("b")).distinct()
    paths = compact(materialize(links, "links"))
    on_path = marked.where("source.doc < doc").join(paths, "segment", "left").select("doc", "text_hash", "at", "n", F.coalesce("path", "segment").alias("path"), F.coalesce("place", F.lit(0)).alias("place"), "source")

    branching = kinds.groupBy("minimizer").agg(F.count("*").alias("k")).where("k > 1").select("minimizer")
    branching = materialize(branching, "branching")
    borders = found.join(kinds.join(branching, "minimizer").select("minimizer", "segment", F.col("source.doc").alias("doc")), ["minimizer", "segment", "doc"]).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("at", F.col("n").cast("int").alias("n"), "minimizer")).alias("parts"))

    def run_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in ts.blocks(batches):
            w = Words(data)
            parts = rows.column("parts").to_pylist()
            text = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            at, n, minimizer = (np.array([s[c] for x in parts for s in x], np.int64) for c in ("at", "n", "minimizer"))
            one = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = np.repeat(text, n)
            first = w.cut[text] + one
            pick = pa.array(text)
            yield ts.record(doc=rows.column("doc").take(pick), text_hash=rows.column("text_hash").take(pick), at=one.astype(np.int32), minimizer=np.repeat(minimizer, n), edge=ts.span(w.prefix, first, first + WINDOW).view(np.int64))

    windows = materialize(docs.join(borders, ["doc", "text_hash"]).select("doc", "text_hash", "text", "parts").mapInArrow(run_windows, "doc long, text_hash long, at int, minimizer long, edge long"), "windows")
    least = windows.groupBy("minimizer", "edge").agg(source, F.max("doc").alias("last")).where("source.doc < last")
    least = least.hint("rebalance")  # dealt anew, so that both sides below are plain exchanges, of which Spark splits a hot one
    single = windows.join(least.select("minimizer", "edge", "source"), ["minimizer", "edge"]).where("source.doc < doc")
    single = single.select("doc", "text_hash", "at", F.lit(1).cast("short").alias("n"), F.lit(0).cast("long").alias("path"), F.col("at").alias("place"), "source")
    spans = materialize(_runs(on_path).unionByName(_runs(single)).select("doc", "text_hash", "at", "n", "source"), "spans")

    # Many copies point to one source, mostly to the same words of it: each place is fetched once.
    asked = spans.select(F.col("source.doc").alias("doc"), F.col("source.text_hash").alias("text_hash"), F.struct(F.col("source.at").alias("at"), "n").alias("place")).distinct()
    asked = asked.groupBy("doc", "text_hash").agg(F.collect_list("place").alias("places"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in ts.blocks(batches):
            places, found = rows.column("places").to_pylist(), [x.split() for x in data]
            pick = pa.array([k for k, x in enumerate(places) for _ in x], pa.int64())
            digests = [_digest(found[k][p["at"] : p["at"] + p["n"] + WINDOW - 1]) for k, x in enumerate(places) for p in x]
            yield ts.record(doc=rows.column("doc").take(pick), text_hash=rows.column("text_hash").take(pick), at=pa.array([p["at"] for x in places for p in x], pa.int32()), n=pa.array([p["n"] for x in places for p in x], pa.int32()), digest=pa.array(digests, pa.binary()))

    words = docs.join(asked, ["doc", "text_hash"]).select("doc", "text_hash", "text", "places").mapInArrow(fetch, "doc long, text_hash long, at int, n int, digest binary")
    words = materialize(words.dropDuplicates(["doc", "text_hash", "at", "n"]).select(F.struct("doc", "text_hash", "at").alias("source"), "n", "digest"), "sources")
    return spans.join(words, ["source", "n"]).select("doc", "text_hash", "at", "n", "digest")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with _n_words, _kept string (the words that stay, joined by a space) and _spans
    array<struct<start, length>> (the maximal runs of words cut).

    A word is cut if a window of WINDOW words over it also starts in a document with a smaller id. Ids are integers; rows
    with a null id neither lose words nor cause it, repeated rows of one id don't cut each other, null texts have no words.
    Columns of docs with the added names are replaced; others may have any name and type.
    """
    docs = docs.drop("_n_words", "_kept", "_spans")
    text = F.col(quoted(text_col))
    source = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), text.cast("string").alias("text"), *[F.col(quoted(c)).alias(f"_c{k}") for k, c in enumerate(docs.columns) if c != text_col])
    found = _repeats(source.select("doc", "text_hash", "text")).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("at", "n", "digest")).alias("parts"))
    joined = source.join(found, ["doc", "text_hash"], "left")
    carried = [c for c in joined.columns if c not in ("doc", "text_hash", "parts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in ts.blocks(batches):
            kept, spans, n_words = [], [], []
            for x, parts in zip(data, rows.column("parts").to_pylist(), strict=True):
                found = x.split()
                n = len(found)
                parts = [s for s in parts or () if _digest(found[s["at"] : s["at"] + s["n"] + WINDOW - 1]) == s["digest"]]
                gone = ts.covered(np.array([s["at"] for s in parts]), np.array([s["n"] for s in parts]) + WINDOW - 1, n) if parts else np.zeros(n, bool)
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                spans.append([{"start": a, "length": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                kept.append(b" ".join(w for w, g in zip(found, gone.tolist(), strict=True) if not g) if len(edge) else b" ".join(found))
                n_words.append(n)
            yield ts.record(**{c: rows.column(c) for c in carried}, _n_words=np.array(n_words, np.int64), _kept=pa.array(kept, pa.binary()).cast(pa.string()), _spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))))

    made = T.StructType([joined.schema[c] for c in carried]).add("_n_words", "long").add("_kept", "string").add("_spans", T.ArrayType(T.StructType().add("start", "integer").add("length", "integer")))
    out = joined.mapInArrow(run, made)
    return out.select(*[F.col("text" if c == text_col else f"_c{k}").alias(c) for k, c in enumerate(docs.columns)], "_n_words", "_kept", "_spans")
