"""What tasks and the driver hold, and learned scores against plain sums."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import plain
from nightlights.llm import decontaminate, langid, toxicity
from nightlights.llm import textscan as ts
from pyspark.sql import functions as F

RNG = random.Random(12)


def prose(n, letters="abcdefghijklmnopqrstuvwxyzé"):
    return " ".join("".join(RNG.choices(letters, k=RNG.randint(1, 9))) for _ in range(n))


def test_emissions_are_sums_of_weights(monkeypatch):
    data = [prose(40).encode(), b"", "Straße über é".encode(), b"...", ("x" * 300).encode()]
    weights = np.random.default_rng(1).normal(size=(1 << langid.BITS, 5))
    f = langid.Features(data)
    want = np.stack([weights[f.ngram[a - 1 : b - 1]].mean(0) + weights[f.whole[k]].sum(0) for k, (a, b) in enumerate(zip(f.start, f.end, strict=True))])
    for cells in (1, 60, 1 << 21):
        monkeypatch.setattr(langid, "CELLS", cells)
        assert np.allclose(f.emissions(weights), want)
    assert langid.Features([b""]).emissions(weights).shape == (0, 5)


def test_memory_with_many_languages(spark):
    """A task's block is smaller the more languages there are."""
    names = [f"l{k:03d}" for k in range(128)]
    rng = np.random.default_rng(2)
    weights = rng.normal(0, 0.1, (1 << langid.BITS, len(names)))
    model = langid.Model(names, weights, np.eye(len(names)))

    class Shared:
        value = model

    batch = ts.record(id=np.arange(300), text=[prose(600) for _ in range(300)])  # over 1 MB of text
    run = None

    class Docs:
        """Takes what predict would give Spark to run."""

        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda m: Shared)})})
        schema = {"id": type("F", (), {"dataType": type("T", (), {"simpleString": staticmethod(lambda: "long")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            nonlocal run
            run = f
            return self

        def withColumnRenamed(self, *_):
            return self

    langid.predict(Docs(), model)
    tracemalloc.start()
    try:
        rows = sum(len(b) for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 300 and peak < 500 << 20


def test_items_with_a_common_window():
    """5,000 items share a window that a text of 4 kB has over and over."""
    common = prose(10)
    items = [(f"i{k}", f"{prose(3)} {common} {prose(2)}".encode()) for k in range(5000)]
    text = " ".join([common] * 60)
    w = decontaminate.Windows(items, 10)
    w.prepare(np.zeros(len(w.vocabulary.values), np.int64))
    began = time.time()
    hits = w.hits(decontaminate.Tokens([text.encode()]))
    assert time.time() - began < 1 and 60 <= len(hits) < 600  # not one for each item
    assert sum(w.items_of[k] == set(range(5000)) for _, _, k in hits) == 60


def test_common_windows_against_brute_force(spark):
    common = prose(14)
    items = [(f"i{k}", f"{prose(k % 4)} {common}") for k in range(40)] + [("twice", common + " " + common), ("short", "only four words here")]
    docs = [(1, f"{prose(5)} {common} {common}"), (2, common[:-4]), (3, "so only four words here"), (4, None), (5, prose(30))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted(plain.contamination(docs, items))


def test_margins_are_sums_over_pairs():
    """The machine's margins against the sum over all pairs of a text's terms."""
    rng = np.random.default_rng(4)
    hashes = np.sort(rng.integers(0, 1 << 63, 30).astype(np.uint64))
    m = toxicity.Machine(hashes, -0.7, rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS)))
    texts = [sorted(rng.choice(30, rng.integers(0, 12), replace=False).tolist()) for _ in range(20)]
    text, index = np.repeat(np.arange(20), [len(x) for x in texts]), np.array([t for x in texts for t in x], np.int64)
    for own, got in zip(texts, m.margins(text, index, 20)[0], strict=True):
        want = m.bias + sum(m.linear[t] for t in own) + sum(m.factors[a] @ m.factors[b] for a in own for b in own if a < b)
        assert abs(got - want) < 1e-9


def test_scores_of_texts_by_their_terms(spark):
    """score() finds the terms of each text: against distinct words looked up one by one."""
    words = ["insult", "group", "été", "fine", "word"]
    h = toxicity.terms([w.encode() for w in words])[1]
    order = np.argsort(h)
    rng = np.random.default_rng(6)
    m = toxicity.Machine(h[order], 0.3, rng.normal(size=5), rng.normal(size=(5, toxicity.FACTORS)))
    at = {words[k]: int(np.flatnonzero(order == k)[0]) for k in range(5)}
    texts = [" ".join(RNG.choices([*words, "Insult", "other", "12"], k=n)) for n in range(12)] + [None, "word " * 100_000]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for k, t in enumerate(texts):
        own = sorted({at[w] for w in plain.lower(t or "").split() if w in at})
        margin = m.bias + sum(m.linear[i] for i in own) + sum(m.factors[a] @ m.factors[b] for a in own for b in own if a < b)
        assert abs(got[k] - 1 / (1 + np.exp(-margin))) < 1e-9


def test_terms_chosen_by_spark_are_those_chosen_here(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TERMS", 40)
    texts = [prose(12, "abc") for _ in range(400)]
    label = np.array([int("ab" in t.split()) | int(RNG.random() < 0.1) for t in texts])
    text, h = toxicity.terms([t.encode() for t in texts])
    rows = [(int(label[k]), h[text == k].view(np.int64).tolist()) for k in range(len(texts))]
    df = spark.createDataFrame(rows, "label int, terms array<long>").withColumn("id", F.lit(1))
    want = toxicity.choose(text, h, label.astype(float))
    assert (toxicity.chosen_terms(df, len(texts), int(label.sum())) == want).all() and len(want) == 40
