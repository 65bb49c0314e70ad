"""Benchmark decontamination: which words of a document stand in a window of a benchmark item's words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightlights.llm import textscan as ts
from nightlights.llm.tables import quoted
from nightlights.runtime import materialize

WINDOW = 10
#: Bytes of item texts held by a task at once. A larger benchmark is taken in blocks, one after the other, each within this bound.
BLOCK_BYTES = 4 << 20
_BITS = 22


class Tokens:
    """Words of a block of texts: spans in the lower-cased buffer, hashes, and each text's first word."""

    def __init__(self, data: list[bytes]):
        self.buf, at = ts.joined(data, lower=True)
        self.start, self.end = ts.words(self.buf, ts.ALNUM[self.buf])
        self.cut = np.searchsorted(self.start, at)
        self.hash = ts.span(ts.prefix_hash(ts.symbol_codes()[self.buf]), self.start, self.end)

    def words(self, first: int, n: int) -> tuple[bytes, ...]:
        return tuple(self.buf[a:b].tobytes() for a, b in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True))


class Lookup:
    """Places of hashes in a sorted table, through a bit table that rejects most of the others."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.values >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in values) of the hashes that are there."""
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, h[maybe]), len(self.values) - 1)
        hit = self.values[at] == h[maybe]
        return maybe[hit], at[hit]


class Windows:
    """The windows of some items, and for each the necessary prefix: with containment 1 that is its rarest word."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.items, self.tokens = [k for k, _ in items], Tokens([x for _, x in items])
        spans = []
        for i, (a, b) in enumerate(zip(self.tokens.cut[:-1].tolist(), self.tokens.cut[1:].tolist(), strict=True)):
            n = min(size, b - a)
            spans += [(p, n, i) for p in range(a, b - n + 1) if n]
        self.first, self.length, self.item = (np.array(x, np.int64) for x in (zip(*spans, strict=True) if spans else ((), (), ())))
        self.vocabulary = Lookup(self.tokens.hash)

    def prepare(self, counts: np.ndarray) -> None:
        """counts: occurrences in the corpus of each word of the vocabulary."""
        word = np.searchsorted(self.vocabulary.values, self.tokens.hash)
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((self.vocabulary.values, counts))] = np.arange(len(counts))
        prefix = ts.prefix_hash(self.tokens.hash)
        self.hash = ts.span(prefix, self.first, self.first + self.length)
        self.by_hash: dict[int, list[int]] = defaultdict(list)
        self.items_of: dict[int, set[int]] = {}
        probes: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for k, (p, n, h) in enumerate(zip(self.first.tolist(), self.length.tolist(), self.hash.tolist(), strict=True)):
            mine = self.tokens.words(p, n) if h in self.by_hash else ()
            same = next((w for w in self.by_hash[h] if self.length[w] == n and self.tokens.words(int(self.first[w]), n) == mine), None)
            if same is not None:  # equal windows are one, which has all their items
                self.items_of[same].add(int(self.item[k]))
                continue
            self.by_hash[h].append(k)
            self.items_of[k] = {int(self.item[k])}
            at = int(np.argmin(rank[word[p : p + n]]))
            probes[int(self.tokens.hash[p + at])].add((at, n))
        self.windows = Lookup(self.hash)
        self.rare = Lookup(np.array(list(probes), np.uint64))
        #: By rare word: where it stands in windows, and their lengths.
        flat = [(i, at, n) for i, h in enumerate(self.rare.values.tolist()) for at, n in sorted(probes[h])]
        self.probe_from = np.searchsorted([x[0] for x in flat], np.arange(len(self.rare.values) + 1))
        self.probe_at, self.probe_n = np.array([x[1] for x in flat], np.int64), np.array([x[2] for x in flat], np.int64)

    def hits(self, t: Tokens) -> list[tuple[int, int, int]]:
        """(first word in t, window's words, window) of each occurrence; equal windows of several items are one."""
        where, which = self.rare.find(t.hash)
        n = self.probe_from[which + 1] - self.probe_from[which]
        where, k = np.repeat(where, n), np.repeat(self.probe_from[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, length = where - self.probe_at[k], self.probe_n[k]
        text = np.searchsorted(t.cut, where, "right") - 1
        fits = (first >= t.cut[text]) & (first + length <= t.cut[text + 1])
        first, length = first[fits], length[fits]
        found, at = self.windows.find(ts.span(ts.prefix_hash(t.hash), first, first + length))
        out = []
        for p, n, h in zip(first[found].tolist(), length[found].tolist(), self.windows.values[at].tolist(), strict=True):
            same = t.words(p, n)
            out += [(p, n, w) for w in self.by_hash[h] if self.length[w] == n and self.tokens.words(int(self.first[w]), n) == same]
        return out


def _blocks_of_items(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """Distinct items, in blocks of BLOCK_BYTES at most or of one item. A block that is too large is halved by one more bit of
    the items' hashes until it fits; nothing is collected before its size is known."""
    rows = items.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("null")).alias("k"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text")).distinct()
    rows = materialize(rows.withColumn("h", F.xxhash64("k", "text")), "items")
    size = F.sum(F.octet_length("text") + F.octet_length("k"))
    pending, given = [(1, 0)], False
    while pending:
        parts, rest = pending.pop()
        part = rows.where(F.pmod("h", F.lit(parts)) == rest)
        n, total = part.agg(F.count("*"), size).first()
        if n > 1 and total > BLOCK_BYTES and parts < 1 << 62:
            pending += [(2 * parts, rest + parts), (2 * parts, rest)]
        elif n or not (given or pending):
            given = True
            yield [(r.k, r.text.encode()) for r in part.collect()]


def _count_words(docs: DataFrame, windows: Windows) -> np.ndarray:
    """Occurrences in all of docs of each word of the windows' vocabulary."""
    size = len(windows.vocabulary.values)
    vocabulary = docs.sparkSession.sparkContext.broadcast(windows.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, data in ts.blocks(batches):
            total += np.bincount(vocabulary.value.find(Tokens(data).hash)[1], minlength=size)
        yield ts.record(word=pa.array(np.flatnonzero(total), pa.int32()), n=total[total > 0])

    counts = np.zeros(size, np.int64)
    for r in docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row per benchmark word at most
        counts[r.word] = r.n
    return counts


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, spans array<struct<start, length>>) for each row of docs.

    A window is window consecutive words of an item, or all of a shorter one's. Words occurring in the corpus least often
    are each window's necessary prefix; a document is probed only where it has one, at the offsets and lengths of
    windows with it, within its bounds, and what then has a window's hash is compared word by word. n_hit counts words
    inside any occurrence, items the items with one, sorted as strings. Null and empty texts have no words, items of no
    words no windows; a null item id is the string null. An item's repeats count once.
    """
    found = _scan(docs, benchmark, [id_col], text_col, item_id_col, item_text_col, window)
    return found.select(F.col("keep_0").alias(id_col), "n_words", "n_hit", "items", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit word, all columns, of any name and type. Rows with null or empty texts stay, repeated rows all
    stay or all go."""
    found = _scan(docs, benchmark, docs.columns, text_col, item_id_col, item_text_col, window)
    return found.where("n_hit = 0").select(*[F.col(f"keep_{k}").alias(c) for k, c in enumerate(docs.columns)])


def _scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, item_id_col: str, item_text_col: str, window: int) -> DataFrame:
    """keep_0, keep_1, ... (the columns keep), text, spans, items, n_words, n_hit: no shuffle of docs, one pass for each block of items."""
    source = docs.select(F.col(quoted(text_col)).cast("string").alias("text"), *[F.col(quoted(c)).alias(f"keep_{k}") for k, c in enumerate(keep)])
    carried = source.columns
    made = T.StructType(list(source.schema.fields)).add("spans", T.ArrayType(T.StructType().add("start", "integer").add("length", "integer"))).add("items", T.ArrayType(T.StringType())).add("n_words", "long").add("n_hit", "long")
    chain = source.withColumns({"spans": F.array().cast("array<struct<start:int,length:int>>"), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long")})
    for items in _blocks_of_items(benchmark, item_id_col, item_text_col):
        windows = Windows(items, window)
        windows.prepare(_count_words(source, windows))
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for rows, data in ts.blocks(batches):
                t = Tokens(data)
                spans, items, met = rows.column("spans").to_pylist(), [set(x) for x in rows.column("items").to_pylist()], [set() for _ in data]
                for p, n, w in own.hits(t):
                    i = int(np.searchsorted(t.cut, p, "right")) - 1
                    spans[i].append({"start": p - int(t.cut[i]), "length": n})
                    met[i].add(w)
                for i, windows_met in enumerate(met):
                    for w in windows_met:  # a window's items are listed once for a text, however often it has the window
                        items[i].update(own.items[k] for k in own.items_of[w])
                n_hit = [int(ts.covered(np.array([s["start"] for s in x]), np.array([s["length"] for s in x]), int(n)).sum()) if x else 0 for x, n in zip(spans, np.diff(t.cut).tolist(), strict=True)]
                yield ts.record(**{c: rows.column(c) for c in carried}, spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), items=pa.array([sorted(x) for x in items], pa.list_(pa.string())), n_words=np.diff(t.cut).astype(np.int64), n_hit=pa.array(n_hit, pa.int64()))

        chain = chain.mapInArrow(run, made)
    return chain

