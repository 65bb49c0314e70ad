"""SimHash's near-duplicates at a Jaccard similarity of 0.8, against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import plain
import pyarrow as pa
from nightlights.llm import jaccard, simhash
from nightlights.llm.tables import table
from pyspark.sql import functions as F


def test_pipeline_stage_links_at_jaccard(spark, sf_dir):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert dict(p.STAGES)["simhash_near_duplicates"] is p.near_duplicates
    found = p.near_duplicates(spark, docs, sf_dir)
    assert found.columns == p.COLUMNS and sorted(r.doc_id for r in found.collect()) == plain.kept_by_jaccard(rows)


def test_groups_at_every_similarity(spark, monkeypatch):
    """Copies with more and more words changed, far more than a tile holds; a line that all have; short, equal and empty texts."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    rng = np.random.default_rng(5)
    line = " ".join(f"licence{k}" for k in range(12))
    rows = [(900, None), (901, " \n"), (902, "a B c"), (903, "A b\tc"), (904, "a b c d"), (905, "one two three four five"), (906, "One two three four five")]
    for base in range(3):
        words = [f"w{base}x{k}" for k in range(120)]
        for copy in range(60):
            now = list(words)
            for k in rng.choice(120, copy // 8, replace=False):
                now[k] = f"z{rng.integers(1 << 30)}"
            rows.append((base * 100 + copy, " ".join(now) + "\n" + line))
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sample in (0, 20_000):
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        assert sorted(r.doc_id for r in simhash.keep_one_of_each_group(docs).collect()) == plain.kept_by_jaccard(rows)


def test_fingerprints_never_differ_more_than_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 200, 300, 3000):
        one = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        other = np.unique(np.concatenate([one[: len(one) * 9 // 10], rng.integers(0, 1 << 60, n // 5).astype(np.uint64)]))
        wide, narrow = jaccard.sketches(np.concatenate([one, other]), np.array([0, len(one), len(one) + len(other)]))
        apart = len(np.setxor1d(one, other))
        assert jaccard.differing(*wide) <= apart and np.bitwise_count(narrow[0] ^ narrow[1]).sum() <= apart


def test_cells_small_and_large_agree():
    """The same pairs come from a cell whether all rows are shifted against each other or tiles are compared."""
    rng = np.random.default_rng(3)
    m = 50
    bits = rng.integers(-(1 << 62), 1 << 62, (m, 4))
    bits[1::2] = bits[::2] ^ 1
    n = rng.integers(90, 110, m)
    rows = pa.table({"node": rng.permutation(m).astype(np.int64), "n": n.astype(np.int32), "at": np.zeros(m, np.int32), "comp": rng.integers(0, 20, m), "tile": np.repeat([0, 1], m // 2).astype(np.int32), "narrow": pa.array(bits.tolist(), pa.list_(pa.int64()))})
    cells = jaccard._Cells(rows)

    def pairs(found):
        return {frozenset(p) for a, b in found for p in zip(a.tolist(), b.tolist(), strict=True)}

    small, large = pairs(cells.small(np.array([0]), np.array([m]))), pairs(cells.large(0, m, side=8))
    want = {frozenset((i, j)) for i in range(m) for j in range(i) if cells.comp[i] != cells.comp[j] and cells.tile[i] != cells.tile[j] and 9 * sum((int(x) ^ int(y)).bit_count() if (int(x) ^ int(y)) >= 0 else 64 - (~(int(x) ^ int(y))).bit_count() for x, y in zip(bits[i], bits[j], strict=True)) <= int(n[i] + n[j])}
    assert small == large == want


def test_clashing_names_maps_repeats_and_equal_hashes(spark, monkeypatch):
    """Odd columns stay as they are; repeated rows and null ids leave one row; different sets with one hash stay apart."""
    rows = [(3, "one two three four five six", {"k": 1}, "x", 7), (3, "one two three four five six", {"k": 1}, "x", 7), (None, "one two three four five six", None, None, None), (5, "quite another text of six words", {}, "y", 8), (None, None, None, "z", 9), (9, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `a.b` string, row_hash int")
    out = simhash.keep_one_of_each_group(docs)
    assert out.schema == docs.schema
    assert sorted(out.collect(), key=lambda r: r.doc_id) == [rows[0], rows[3], rows[5]]
    assert simhash.keep_one_of_each_group(docs.where("false")).count() == 0
    real = jaccard.ts.mix
    monkeypatch.setattr(jaccard, "node_hash", lambda h, first, seed: real(np.diff(first).astype(np.uint64)).view(np.int64) if seed == 7 else real(np.append(h, np.uint64(1))[first[:-1]]).view(np.int64))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each_group(docs.where("doc_id < 9")).collect()) == [3, 5]


def test_stage_takes_links_of_simhash(spark, monkeypatch):
    """Fingerprints of majority bits are linked as in simhash_components, and whole sets check their links."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[:k] + [f"z{rng.integers(1 << 30)}"] + words[k + 1 :])) for k in range(40)]
    rows += [(k, " ".join(f"x{rng.integers(1 << 30)}" for _ in range(60))) for k in range(40, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, real = [], simhash.near_links

    def spy(distinct, radius=simhash.RADIUS):
        seen.extend(r.fp for r in distinct.collect())
        return real(distinct, radius)

    monkeypatch.setattr(simhash, "near_links", spy)
    assert sorted(r.doc_id for r in simhash.keep_one_of_each_group(docs).collect()) == plain.kept_by_jaccard(rows) == [0, *range(40, 50)]
    assert sorted({x % (1 << 64) for x in seen}) == sorted({plain.fingerprint(t, 5) for _, t in rows})
    seen.clear()
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, columns, *_: docs.select(*columns, F.lit(0).cast("long").alias("fp")))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each_group(docs).collect()) == plain.kept_by_jaccard(rows) and seen == [0]  # links of unlike texts don't hold


def test_rows_of_comparisons_follow_rows_not_pairs():
    """Of m like texts in one cell, and of m similar ones in one block, at most m - 1 rows come out."""
    rng = np.random.default_rng(4)
    bits = rng.integers(-(1 << 62), 1 << 62, 4).tolist()
    for m in (40, 400):
        one = np.zeros(m, np.int32)
        cell = pa.record_batch({"token": one.astype(np.int64), "low": one, "high": one, "node": np.arange(m) + 7, "n": one + 300, "at": one, "comp": np.arange(m) + 7, "tile": one, "narrow": pa.array([bits] * m, pa.list_(pa.int64()))})
        out = pa.Table.from_batches(jaccard._compare(iter([cell])))
        assert len(out) == m - 1 and set(out.column("a").to_pylist()) == {7} and sorted(out.column("b").to_pylist()) == list(range(8, m + 7))
        texts = [" ".join(["same"] + [f"w{j}" for j in range(60)] + [f"end{k}"]) for k in range(m)]
        block = pa.record_batch({"block": one.astype(np.int64), "low": one, "high": one, "node": np.arange(m), "comp": np.arange(m), "tile": one, "text": texts})
        assert sum(b.num_rows for b in jaccard._verify(5)(iter([block]))) == m - 1


def test_blocks_beyond_a_tile(spark, monkeypatch):
    """Blocks of more texts or shingles than a tile are compared by pairs of tiles; long sets have folded fingerprints of several widths."""
    monkeypatch.setattr(jaccard, "SHINGLES", 4000)
    rng = np.random.default_rng(9)
    rows = []
    for base, size in enumerate((90, 700, 2600, 5000)):
        words = [f"w{base}x{k}" for k in range(size)]
        for copy in range(9):
            now = list(words)
            for k in rng.choice(size, size * copy // 200, replace=False):
                now[k] = f"z{rng.integers(1 << 30)}"
            rows.append((base * 100 + copy, " ".join(now[: size - size * copy // 40])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each_group(docs).collect()) == plain.kept_by_jaccard(rows)
