"""What the docstrings say of empty tables, null and repeated ids, null texts and further columns."""

from __future__ import annotations

import numpy as np
from nightlights.llm import simhash, toxicity

SCHEMA = "doc_id int, text string, score string, fingerprint string"
ROWS = [(1, "you are a fool", "x", "y"), (1, "you are a fool", "x", "y"), (None, None, None, None), (2, "", "x", "y"), (3, "a b " * 100_000, "x", "y")]


def test_components(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == [(-1, 2), (1, 1), (1, 1), (2, 2), (3, 3)]
    assert simhash.simhash_components(docs.where("false")).count() == 0


def test_scores(spark):
    words = np.sort(toxicity.terms([b"fool you"])[1])
    rng = np.random.default_rng(1)
    hashes = np.unique(words)
    machine = toxicity.Machine(hashes, 0.1, rng.normal(size=len(hashes)), rng.normal(size=(len(hashes), 8)))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (None, 2)}) == 1 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert toxicity.score(docs.where("false"), machine).count() == 0
