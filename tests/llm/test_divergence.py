"""The divergence audit against dictionaries and whole numbers of any size; tries against sorted lists."""

from __future__ import annotations

import random

import numpy as np
import plain
from nightlights.llm import divergence, queries
from nightlights.llm.tables import table
from nightlights.llm.tries import Trie, merge, shared

RNG = random.Random(6)
WORDS = ["a", "an", "and", "ant", "Ähre", "zu", "zuÄ", "blé", "日本", "日", "x" * 70, "x" * 71, "long" * 40, "tie", "Tie", "TIE"]


def corpus():
    text = lambda n: " ".join(RNG.choices(WORDS + ["".join(RNG.choices("abcé", k=3)) for _ in range(9)], k=n))
    rows = [(RNG.choice(["en", "en", "de", None, ""]), RNG.choice(["s", "t", "u", None, "ü"]), text(RNG.randint(0, 60))) for _ in range(150)]
    rows += [rows[0], rows[0], ("one", "alone", "few words"), ("none", "p", None), ("none", "q", "123 ..."), ("en", "long", "word " * 30_000), ("en", "never", "")]
    return rows + [("v1", s, t) for s in ("k", "l") for t in ("only", "only", "")]


def walk(trie, names=range(5)):
    """(term, documents, {source: count}) of each leaf."""
    ends = trie.leaf_from.tolist()
    return [(t, int(trie.documents[k]), {names[s]: n for s, n in zip(trie.source[ends[k] : ends[k + 1]].tolist(), trie.count[ends[k] : ends[k + 1]].tolist(), strict=True)}) for k, t in enumerate(trie.terms())]


def leaves(terms):
    return [(t, RNG.randint(1, 3), {k: RNG.randint(1, 9) for k in sorted(RNG.sample(range(5), RNG.randint(1, 3)))}) for t in sorted(set(terms))]


def trie(found):
    cells = [(k, s, n) for k, (_, _, counts) in enumerate(found) for s, n in counts.items()]
    RNG.shuffle(cells)
    return Trie.of([t for t, _, _ in found], np.array([d for _, d, _ in found], np.int64), *(np.array([c[k] for c in cells], np.int64) for k in range(3)))


def test_tries_keep_and_merge_what_they_are_made_of():
    words = lambda: [bytes(RNG.choices(b"ab\xc3\xa4", k=RNG.randint(1, 6))) for _ in range(80)] + [b"long" * RNG.randint(7, 20) + bytes([RNG.randint(97, 99)]) for _ in range(9)]
    made = [leaves(words()) for _ in range(5)] + [[]]
    bounds = [b"a", b"ab", b"b", b"long" * 9, b"\xc3"]
    for x in made:
        assert walk(Trie.unpack(trie(x).pack())) == x
        cut = list(trie(x).cut(bounds))
        assert [leaf for _, part in cut for leaf in walk(Trie.unpack(part.pack()))] == x
        assert all(k == sum(b <= t for b in bounds) for k, part in cut for t in part.terms())
    want = {}
    for x in made:
        for t, d, counts in x:
            docs, own = want.setdefault(t, [0, {}])
            want[t][0] = docs + d
            for k, n in counts.items():
                own[4 - k] = own.get(4 - k, 0) + n
    assert walk(merge([trie(x) for x in made], [np.arange(4, -1, -1)] * len(made), 3)) == [(t, d, dict(sorted(c.items()))) for t, (d, c) in sorted(want.items()) if d >= 3]
    assert shared(b"abcd" * 9, b"abcd" * 8 + b"abxd") == 34 and shared(b"", b"a") == 0 and shared(b"a", b"a") == 1


def test_large_counters_are_kept():
    big = Trie.of([b"a" * 70_000, b"b"], np.array([3, 1 << 40]), np.array([0, 1, 1]), np.array([0, 70_000, 1]), np.array([255, 1 << 33, 256]))
    assert walk(Trie.unpack(big.pack()), range(80_000)) == walk(big, range(80_000)) == [(b"a" * 70_000, 3, {0: 255}), (b"b", 1 << 40, {1: 256, 70_000: 1 << 33})]


def test_shares_are_exact():
    for total in (7, 10**9 + 7, 2**52 + 3):
        for n in (0, 1, total // 3, total - 1):
            assert divergence.shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total


def test_against_whole_numbers(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, value int, `a.b` int").repartition(4)
    got = divergence.divergence_audit(docs, top=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(plain.audit(rows, top=7))
    assert divergence.divergence_audit(docs.where("false")).count() == 0


def test_flushes_change_nothing(monkeypatch):
    rows = [(x or "", s or "", t or "") for x, s, t in corpus()]
    batches = lambda: [divergence.ts.record(lang=[x for x, _, _ in rows], source=[s for _, s, _ in rows], text=[t for _, _, t in rows])]

    def merged():
        by = {}
        for b in divergence._tries(batches()):
            by.setdefault(b.column("lang")[0].as_py(), []).append((b.column("sources")[0].as_py(), Trie.unpack(b.column("trie")[0].as_py())))
        names = sorted({s for _, s, _ in rows})
        return {k: walk(merge([t for _, t in v], [np.array([names.index(s) for s in own], np.int64) for own, _ in v]), names) for k, v in by.items()}, sum(map(len, by.values()))

    whole, few = merged()
    monkeypatch.setattr(divergence, "HELD", 200)
    monkeypatch.setattr(divergence.ts, "ROWS", 10)
    monkeypatch.setattr(divergence.ts.blocks, "__defaults__", ("text", 500))
    again, many = merged()
    assert again == whole and many > few


def test_ranges_change_nothing(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(divergence, "RANGE_BYTES", 20_000)
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("lang", "source", "text").collect()]
    assert sorted(map(tuple, queries.op13_divergence(spark, sf_dir).collect())) == sorted(plain.audit(docs))
