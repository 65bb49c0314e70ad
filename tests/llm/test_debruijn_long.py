"""Minimizers of texts with more words than their packed places can hold."""

from __future__ import annotations

import numpy as np
import plain
from nightlights.llm import debruijn


def test_texts_longer_than_the_packed_place(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "_POSITION", np.uint64(63))
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    shared = [word(90) for _ in range(6)]
    rows = []
    for i in range(4):
        parts = []
        for k in rng.permutation(6):
            parts += word(int(rng.integers(100, 400))) + shared[k]
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r._n_words, sum(s["length"] for s in r._spans), plain.sha(r._kept.encode())) for r in debruijn.repeated_spans(docs).collect()]
    assert sorted(got) == sorted(plain.cut_words(rows))


def test_places_do_not_reach_the_hash(monkeypatch):
    text = " ".join(f"w{x}" for x in np.random.default_rng(12).integers(0, 1 << 40, 1000)).encode()
    want = debruijn.Words([text]).segments()
    monkeypatch.setattr(debruijn, "_POSITION", np.uint64(63))
    for x, y in zip(debruijn.Words([text]).segments(), want, strict=True):
        assert np.array_equal(x, y)
