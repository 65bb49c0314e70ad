"""Source divergence audit: how far each source's terms are from those of the other sources and of its whole language."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightlights.llm import textscan as ts
from nightlights.llm.tables import quoted
from nightlights.llm.tries import Trie, merge
from nightlights.runtime import materialize

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
SCALE = 1_000_000_000
MIN_DOCUMENTS, TOP = 3, 200
#: Counters that a task holds before it writes its tries, packed bytes of a range of prefixes, and cells of counts at a time.
HELD, RANGE_BYTES, CELLS = 400_000, 2 << 20, 1 << 18
TERM_BITS = 36
_TERM = (1 << TERM_BITS) - 1
#: Bounds are drawn from so many prefixes of so many bytes at most.
SAMPLED, PREFIX = 100_000, 64


class Counts:
    """Counters of (row number << TERM_BITS | term number), added up now and then."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*self.parts, strict=True) if self.parts else ((), ())))
        keys, where = np.unique(keys, return_inverse=True)
        counts = np.bincount(where, counts, len(keys)).astype(np.int64) if len(keys) else counts
        self.parts, self.held = [(keys, counts)], len(keys)
        return keys, counts


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A trie for each language of a task's texts, and prefixes along it. Sources without terms are named too. Terms and groups
    have numbers in the task, so that a block's words are counted as numbers."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    groups: dict[tuple[str, str], int] = {}
    langs: dict[str, int] = {}
    by_group, by_lang = Counts(), Counts()

    def flush() -> Iterator[pa.RecordBatch]:
        terms = sorted(numbers)
        rank = np.empty(len(terms), np.int64)
        rank[np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
        (keys, counts), (seen, documents) = by_group.settle(), by_lang.settle()
        row, term = keys >> TERM_BITS, rank[keys & _TERM]
        lang_row, lang_term = seen >> TERM_BITS, rank[seen & _TERM]
        for lang, number in langs.items():
            names = sorted(s for x, s in groups if x == lang)
            local = np.full(len(groups), -1)
            local[[groups[lang, s] for s in names]] = np.arange(len(names))
            mine = lang_row == number
            by = np.argsort(lang_term[mine])
            ranks, docs = lang_term[mine][by], documents[mine][by]
            own = local[row] >= 0
            trie = Trie.of([terms[k] for k in ranks.tolist()], docs, np.searchsorted(ranks, term[own]), local[row[own]], counts[own])
            some = [terms[k][:PREFIX] for k in ranks[:: max(1, len(ranks) // 64)].tolist()]
            yield ts.record(lang=pa.array([lang]), sources=pa.array([names], pa.list_(pa.string())), trie=pa.array([trie.pack()], pa.binary()), some=pa.array([some], pa.list_(pa.binary())))

    for rows, data in ts.blocks(batches):
        found, sizes = [], []
        for text in data:
            own = TERM.findall(text.lower())
            found.extend(map(numbers.__getitem__, own))
            sizes.append(len(own))
        pairs = zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)
        group = np.array([(groups.setdefault((x, s), len(groups)), langs.setdefault(x, len(langs))) for x, s in pairs], np.int64).reshape(-1, 2)
        keys, counts = np.unique(np.repeat(np.arange(len(data)), sizes) << TERM_BITS | np.array(found, np.int64), return_counts=True)
        row, term = keys >> TERM_BITS, keys & _TERM
        by_group.add(group[row, 0] << TERM_BITS | term, counts)
        by_lang.add(group[row, 1] << TERM_BITS | term, np.ones(len(row), np.int64))
        if by_group.held > HELD:
            by_group.settle(), by_lang.settle()
            if by_group.held > HELD // 2:
                yield from flush()
                numbers.clear()
                groups.clear()
                langs.clear()
                by_group, by_lang = Counts(), Counts()
    yield from flush()


def _bounds(tries: DataFrame) -> dict[str, list[bytes]]:
    """For each language the prefixes at which its tries are cut, for ranges of RANGE_BYTES: quantiles of a sample that is bounded
    at any size of the table. Where they lie doesn't change any result."""
    sizes = {r.lang: (r.b, r.n) for r in tries.groupBy("lang").agg(F.sum(F.length("trie")).alias("b"), F.sum(F.size("some")).alias("n")).where(F.col("b") > RANGE_BYTES).collect()}
    if not sizes:
        return {}
    share = min(1.0, SAMPLED / sum(n for _, n in sizes.values()))
    rows = tries.where(F.col("lang").isin(list(sizes))).select("lang", (F.length("trie") / F.size("some")).alias("w"), F.explode("some").alias("p")).where(F.rand(7) < share).limit(2 * SAMPLED).collect()
    drawn = defaultdict(list)
    for r in rows:
        drawn[r.lang].append((bytes(r.p), r.w))
    out = {}
    for lang, found in drawn.items():
        found.sort()
        parts, weight = -(-sizes[lang][0] // RANGE_BYTES), np.cumsum([w for _, w in found])
        at = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)
        out[lang] = sorted({found[min(k, len(found) - 1)][0] for k in at.tolist()})
    return out


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Values of the columns row by row, so that one packed trie is taken out at a time."""
    for batch in batches:
        for k in range(len(batch)):
            yield tuple(batch.column(c)[k].as_py() for c in columns)


def _cut(bounds: dict[str, list[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, packed in _rows(batches, "lang", "sources", "trie"):
            parts = [(k, part.pack()) for k, part in Trie.unpack(packed).cut(bounds.get(lang, []))]
            if parts:
                n, (ranges, tries) = len(parts), zip(*parts, strict=True)
                yield ts.record(lang=pa.array([lang] * n), range=pa.array(ranges, pa.int32()), sources=pa.array([names] * n, pa.list_(pa.string())), trie=pa.array(tries, pa.binary()))

    return run


def _merged(min_documents: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """One trie from those of a range of prefixes, its leaves of too few documents left out, with sums by source."""
        names = sorted({x for row in table.column("sources").to_pylist() for x in row})
        place = {x: k for k, x in enumerate(names)}
        own = [np.array([place[x] for x in row], np.int64) for row in table.column("sources").to_pylist()]
        found = merge([Trie.unpack(t) for t in table.column("trie").to_pylist()], own, min_documents)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, found.source, found.count)
        return pa.table({"lang": [key[0].as_py()], "sources": pa.array([names], pa.list_(pa.string())), "sums": pa.array([sums.tolist()], pa.list_(pa.int64())), "terms": pa.array([len(found)], pa.int64()), "trie": pa.array([found.pack()], pa.binary())})

    return run


def shares(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact by long division in steps that don't leave 64 bits; count + 1 <= total < 2**53."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return 1 + out


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q); the square is at most SCALE**2, which 64 bits hold."""
    return (p - q) ** 2 // q


def _pair_sums(count: np.ndarray, p: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """For each two sources the sum over the block's terms, beyond what each term adds that neither has (rare: the shares of a
    count of zero). Only terms that one of the two has are visited."""
    base = divergences(rare[:, None], rare[None, :])
    out = np.zeros(base.shape, np.int64)
    for g in range(len(rare)):
        own = count[:, g] > 0
        out[g] += (divergences(p[own, g, None], p[own]) - base[g]).sum(0)
        other = divergences(rare[None, :], p[own, g, None]) - base[:, g]
        out[:, g] += np.where(count[own] > 0, 0, other).sum(0)
    return out


def _audited(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Walks each range's trie in order: sums for pairs of sources, and each source's first candidates, ties in order of bytes."""
        for lang, own, packed, groups, terms in _rows(batches, "lang", "sources", "trie", "groups", "all_terms"):
            trie, names = Trie.unpack(packed), [g["source"] for g in groups]
            place = np.array([bisect_left(names, x) for x in own], np.int64)
            total = np.array([g["n"] for g in groups], np.int64) + terms
            rare, whole = shares(np.zeros(len(names), np.int64), np.maximum(total, 1)), total.sum() - terms * (len(names) - 1)
            sums, best, path = np.zeros((len(names), len(names)), np.int64), defaultdict(list), trie.terms()
            step = max(1, CELLS // len(names))
            for k in range(0, len(trie), step):
                cut = trie.leaf_from[k : min(k + step, len(trie)) + 1]
                block = [x for _, x in zip(range(len(cut) - 1), path, strict=False)]
                count = np.zeros((len(block), len(names)), np.int64)
                leaf = np.repeat(np.arange(len(block)), np.diff(cut))
                np.add.at(count, (leaf, place[trie.source[cut[0] : cut[-1]]]), trie.count[cut[0] : cut[-1]])
                p, q = shares(count, total), shares(count.sum(1), whole)
                sums += _pair_sums(count, p, rare)
                above = np.where((count > 0) & (p > q[:, None]), divergences(p, q[:, None]), -1)
                for g in range(len(names)):
                    found = np.flatnonzero(above[:, g] >= 0)
                    first = found[np.argsort(-above[found, g], kind="stable")[:top]]
                    best[g] += [(int(above[t, g]), block[t]) for t in first.tolist()]
                    best[g] = sorted(best[g], key=lambda x: -x[0])[:top]
            g, o = np.nonzero(sums)
            part = [(names[a], "pair", names[b], v) for a, b, v in zip(g.tolist(), o.tolist(), sums[g, o].tolist(), strict=True) if a != b]
            part += [(names[g], "term", term.decode(), v) for g, found in best.items() for v, term in found]
            if part:
                yield ts.record(lang=pa.array([lang] * len(part)), **{k: pa.array(x) for k, x in zip(("source", "part", "item", "value"), zip(*part, strict=True), strict=True)})

    return run


def divergence_audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distance to each other one (part pair) and
    the top terms that it uses more than its language (part term).

    Tasks count the terms of their texts in tries, one for each language; tries are cut at bounds of prefixes and merged range
    by range, so a common language is spread over as many tasks as its tries need. Then each range is walked once. A null
    text, lang or source is an empty one; rows count each time, whatever their ids; an empty table gives an empty one. Only
    the three columns are read. What is bounded by nature and not by size: the sources of one language, as the result has a row
    for each two of them.
    """
    text = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    given = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    tries = materialize(given.mapInArrow(_tries, "lang string, sources array<string>, trie binary, some array<binary>"), "tries")
    cut = tries.drop("some").mapInArrow(_cut(_bounds(tries)), "lang string, range int, sources array<string>, trie binary")
    merged = materialize(cut.groupBy("lang", "range").applyInArrow(_merged(min_documents), "lang string, sources array<string>, sums array<long>, terms long, trie binary"), "merged")
    named = tries.select("lang", F.explode("sources").alias("source"), F.lit(0).cast("long").alias("n"))
    summed = merged.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.sums").alias("n"))
    groups = named.union(summed).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups")).join(merged.groupBy("lang").agg(F.sum("terms").alias("all_terms")), "lang", "left")
    by_lang = materialize(by_lang.withColumn("all_terms", F.coalesce("all_terms", F.lit(0))), "groups")
    parts = merged.select("lang", "sources", "trie").join(by_lang, "lang").mapInArrow(_audited(top), "lang string, source string, part string, item string, value long")
    parts = materialize(parts, "parts")

    pairs = by_lang.select("lang", "all_terms", F.explode("groups").alias("a"), "groups").select("lang", "all_terms", "a", F.explode("groups").alias("b")).where("a.source <> b.source")
    rare = lambda x: F.when(F.col("all_terms") == 0, F.lit(1).cast("long")).otherwise(F.expr(f"1L + {SCALE}L div greatest({x}.n + all_terms, 1L)"))
    pairs = pairs.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), "all_terms", rare("a").alias("p"), rare("b").alias("q"))
    seen = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("seen"))
    value = F.coalesce("seen", F.lit(0).cast("long")) + F.expr("all_terms * ((p - q) * (p - q) div q)")
    pairs = pairs.join(seen, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
