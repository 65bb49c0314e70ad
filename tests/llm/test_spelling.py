"""Spelling variants against neighbours found by leaving out code points."""

from __future__ import annotations

import random

import plain
from nightlights.llm import queries, spelling
from nightlights.llm.tables import table
from pyspark.sql import functions as F


def edited(rng, word):
    k, letter = rng.randrange(len(word)), rng.choice("aeiouxyzéßÿ×÷")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + letter + word[k:], word[:k] + letter + word[k + 1 :]])


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeghiklmnoprstuéüÀ", k=rng.randint(4, 14))) for _ in range(150)]
    words += [edited(rng, w) for w in words] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "naïve", "naive", "Naive"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(w.title() if rng.random() < 0.1 else edited(rng, w) if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=120))) for k in range(60)]
    return docs + [(3, docs[3][1]), (None, docs[4][1]), (90, None), (91, ""), (92, "1234 -- 日本"), (93, "word " * 4000)]


def test_against_neighbours_by_holes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain.variants(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(w[1] and w[2] != w[1] for w in want)  # a form that has a form


def test_each_pair_is_met_once(spark):
    words = ["abcdef", "abcdeg", "abcdefg", "bcdef", "abcxdef", "éabcde", "abcde", "zzzzz", "zzzzzz"]
    found = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(found).collect())
    near = {w: n for w, *_, n, _ in plain.variants([(0, " ".join(words))], 5, 1)}
    assert len(got) == len(set(got)) == sum(near.values()) // 2


def test_bands_differ_by_two_bits_at_most(spark):
    rng = random.Random(5)
    rows = [(w, edited(rng, w)) for w in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüÿ", k=8)) for _ in range(200))]
    bands = lambda c: F.array(*[spelling.parity_band(F.col(c), k) for k in range(spelling.BANDS)])
    for r in spark.createDataFrame(rows, "a string, b string").select(bands("a").alias("x"), bands("b").alias("y")).collect():
        assert sum((x ^ y).bit_count() for x, y in zip(r.x, r.y, strict=True)) <= 2


def test_chain_and_empty_table(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)], "word string, form string")
    assert {r.root for r in spelling.follow(forms).collect()} == {"w20"}
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_spelling(spark, sf_dir).collect())) == sorted(plain.variants(docs))


def test_words_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Whatever Spark takes their size for: it is that of compressed files, without what explode makes of them."""
    plans = []
    write = spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda df, tag: (plans.append(df), write(df, tag))[1])
    docs = spark.createDataFrame([(i, "garden garden garden gardem lantern lantern lantern " * 3) for i in range(20)], "doc_id long, text string")
    plans.append(spelling.spelling_variants(docs))
    joins = [str(df._jdf.queryExecution().executedPlan()) for df in plans]
    assert sum("SortMergeJoin" in x for x in joins) >= 4 and not any("Broadcast" in x for x in joins)
