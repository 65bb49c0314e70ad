"""The registered queries over whole small tables, against SQL, brute force or held-out labels."""

from __future__ import annotations

import plain
import pytest
from nightlights.llm import queries
from nightlights.llm.tables import table
from oracle import same
from pyspark.sql import functions as F

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.queries()[name], SQL[name])


def test_op3(spark, sf_dir, texts):
    f = [plain.fingerprint(t, 3) for _, t in texts]
    g = plain.groups(f)
    least = {k: min(i for (i, _), x in zip(texts, g, strict=True) if x == k) for k in g}
    assert sorted(map(tuple, queries.op3_simhash(spark, sf_dir).collect())) == sorted((i, f"{x:016x}", least[k]) for (i, _), x, k in zip(texts, f, g, strict=True))


def test_op8(spark, sf_dir, texts):
    assert sorted(map(tuple, queries.op8_substring(spark, sf_dir).collect())) == sorted(plain.cut_words(texts))


def test_op10(spark, sf_dir, texts):
    assert sorted(map(tuple, queries.op10_suffix_array(spark, sf_dir).collect())) == sorted(plain.cut_bytes(texts))


def test_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs = table(spark, big, "documents").select("doc_id", "lang")
    r = queries.op2_langid(spark, big).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97


def test_pipeline(spark, sf_dir):
    """Stage by stage, each against brute force on what the stage before kept."""
    import corpus_pipeline as p
    from nightlights.llm import quality
    from nightlights.runtime import materialize

    docs = table(spark, sf_dir, "documents")
    good = {r.doc_id for r in quality.repetition_coverage(docs).where("kept").collect()}
    now = materialize(p.STAGES[0][1](spark, docs, sf_dir))
    assert {r.doc_id for r in now.collect()} == good
    rows = [(r.doc_id, r.text) for r in now.collect()]
    now = materialize(p.STAGES[1][1](spark, now, sf_dir))
    assert sorted(r.doc_id for r in now.collect()) == plain.kept_by_jaccard(rows)
    rows = [(r.doc_id, r.text) for r in now.collect()]
    now = materialize(p.STAGES[2][1](spark, now, sf_dir))
    left = {r.doc_id: r.text for r in now.collect()}
    for (i, t), dead in zip(rows, plain.gone([(i, (t or "").encode()) for i, t in rows], 50), strict=True):
        want = bytes(b for b, d in zip((t or "").encode(), dead, strict=True) if not d).decode("utf-8", "ignore")
        assert left.get(i, "").strip() == want.strip()
    rows = sorted(left.items())
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    now = materialize(p.STAGES[3][1](spark, now, sf_dir))
    assert {r.doc_id for r in now.collect()} == {i for i, _, n, _ in plain.contamination(rows, items) if not n}
    assert now.columns == p.COLUMNS
    path, pattern = queries.tokenizer()
    ranks = plain.ranks(path)
    want = [(r.doc_id, len(x := plain.bpe(r.text, ranks, pattern)) // 4, plain.sha(x), plain.sha((r.text or "").encode())) for r in now.collect()]
    digests = lambda df: sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert digests(p.STAGES[4][1](spark, now, sf_dir)) == digests(p.run(spark, sf_dir)) == sorted(want)


def test_pipeline_edges(spark, sf_dir, tmp_path):
    """Null ids and texts, empty and repeated rows, ties, a long text, further columns; and tables without rows."""
    import random

    import corpus_pipeline as p

    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))
    base, other, item = prose(120), prose(80), prose(30)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, base), (1, base), (2, near), (None, base), (None, prose(70)), (3, None), (4, ""), (5, " \n"), (6, "too short"), (7, "x " * 60), (8, prose(60) + " " + other), (9, prose(60) + " " + other), (10, prose(60) + " " + item), (11, prose(30_000)), (12, prose(51))]
    docs = spark.createDataFrame([(i, t, "en", None, 0, "u", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_hash string, `a.b` int")
    for name, of in (("some", docs), ("none", docs.where("false"))):
        of.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([("i", item)], "item_id string, text string").where("item_id = 'i'" if name == "some" else "false").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    now, kept = docs, []
    for _, stage in p.STAGES:
        now = stage(spark, now, str(tmp_path / "some"))
        kept.append(sorted((r.doc_id for r in now.collect()), key=repr))
    assert kept[0] == sorted([1, 1, 2, None, None, 8, 9, 10, 11, 12], key=repr)
    assert kept[1] == kept[2] == sorted([1, None, 8, 9, 10, 11, 12], key=repr)
    assert kept[3] == kept[4] == sorted([1, None, 8, 9, 11, 12], key=repr)
    assert sorted((r.doc_id for r in p.run(spark, str(tmp_path / "some")).collect()), key=repr) == kept[4]
    cut = {r.doc_id: r for r in p.repeated_strings(spark, p.near_duplicates(spark, p.quality_rules(spark, docs, ""), ""), "").collect()}
    assert other in cut[8].text and other not in cut[9].text and cut[9].n_chars == len(cut[9].text)
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_held_out_toxicity(spark, sf_dir):
    """Every document has a score; on the fold that nothing is learned from, toxic ones rank above the others."""
    big = sf_dir.replace("sf0.001", "sf0.1")
    got = queries.op5_toxicity(spark, big)
    labels = table(spark, big, "labels").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("score", "toxic").collect()
    yes, no = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert len(yes) > 30 and sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no)) > 0.95
    assert got.count() == table(spark, big, "documents").count()
    assert got.where("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS INT)").count() == 0


def test_op1(spark, sf_dir, texts):
    """The query's digests against the tokenizer library."""
    path, pattern = queries.tokenizer()
    ranks = plain.ranks(path)
    want = [(i, len(x := plain.bpe(t, ranks, pattern)) // 4, plain.sha(x), plain.sha((t or "").encode())) for i, t in texts]
    assert sorted(map(tuple, queries.op1_byte_bpe(spark, sf_dir).collect())) == sorted(want)
