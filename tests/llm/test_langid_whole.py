"""Language identification learns every language and the whole of each sampled text."""

from __future__ import annotations

from nightlights.llm import langid


def test_languages_beyond_64_are_learned(spark):
    rows = []
    for k in range(70):
        for i in range(3 if k == 69 else 6):
            stem = chr(97 + k % 26) + chr(97 + k // 26) + "q"
            rows.append((len(rows), f"l{k:02d}", " ".join(f"{stem}{chr(97 + (i + j) % 26)}{stem}" for j in range(20))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    rare = {i for i, lang, _ in rows if lang == "l69"}
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, fold=9, folds=9).collect()}
    assert {got[i] for i in rare} == {"l69"}


def test_words_late_in_a_text_are_learned(spark):
    rows = [(i, lang, "tik tak " * 5000 + f"{word} " * 40) for i, (lang, word) in enumerate([("aa", "zorvu"), ("bb", "mekli")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert set(langid.sample(docs, "doc_id", "text", "lang", 9, 9)[0]) == {t.encode() for _, _, t in rows}
    asked = spark.createDataFrame([(100, "zorvu zorvu zorvu"), (101, "mekli mekli mekli")], "doc_id long, text string")
    model = langid.fit(*langid.sample(docs, "doc_id", "text", "lang", 9, 9))
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()} == {100: "aa", 101: "bb"}


def test_switched_text_is_labelled_word_by_word(spark, sf_dir):
    """Pieces of held-out texts of two languages: most words get their piece's language, and transitions are learned."""
    import numpy as np
    from nightlights.llm.tables import fold, table

    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    model = langid.fit(*langid.sample(docs, "doc_id", "text", "lang", 1, 3))
    off = model.transition[~np.eye(len(model.languages), dtype=bool)]
    assert len(model.languages) > 1 and (np.diag(model.transition) > off.max()).all() and off.std() > 0
    held = docs.where(fold("doc_id", 3) == 1).where("lang IS NOT NULL AND length(text) BETWEEN 400 AND 3000").select("lang", "text").collect()
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for k in range(40):
        one, other = (held[int(rng.integers(len(held)))] for _ in range(2))
        text, marks = "", []
        for piece in range(4):
            r = (one, other)[piece % 2]
            words = r.text.split()[10 * piece : 10 * piece + 12]
            start = len(text.encode())
            text += " ".join(words) + " "
            marks.append((start, len(text.encode()), r.lang))
        rows.append((k, text))
        truth[k] = marks
    rows += [(90, None), (91, ""), (92, "123 !")]
    found = {r.doc_id: r.runs for r in langid.label_words(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found[90] == found[91] == found[92] == []
    right = total = 0
    for k, marks in truth.items():
        for run in found[k]:
            for a, b, lang in marks:
                n = max(0, min(run.end, b) - max(run.start, a))
                total += n
                right += n * (run.lang == lang)
    assert right > 0.9 * total > 0


def test_sample_is_bounded_and_odd_columns(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 3)
    rows = [(i // 2, f"wort {i % 5} text", "de", "x", 1) for i in range(60)] + [(100, "single row here", "en", "y", 2), (None, "null id", "fr", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string, shares int")
    texts, labels = langid.sample(docs, "doc_id", "text", "lang", 9, 9)
    assert labels == ["de"] * 3 + ["en"]
    assert langid.identify(docs, fold=9, folds=9).count() == len(rows)
