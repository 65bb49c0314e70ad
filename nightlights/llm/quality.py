"""Quality rules: how much of a text stands in repeated word n-grams and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightlights.llm import textscan as ts
from nightlights.llm.tables import quoted

#: Largest share of the word characters that may stand in n-grams found twice or more, by n-gram length.
NGRAM_SHARES = {5: 0.15, 7: 0.13, 10: 0.10}
#: Largest share of the word characters that may stand in lines equal to an earlier line.
LINE_SHARE = 0.20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ngram_chars array<long>, dup_line_chars long"


def _per_text(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sum of values[cut[i]:cut[i+1]] for each i."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[cut])


def _measure(data: list[bytes], ngram_shares: dict[int, float], line_share: float, min_words: int) -> dict[str, pa.Array | np.ndarray]:
    buf, at = ts.joined(data)
    inside = ~ts.SPACE[buf]
    start, end = ts.words(buf, inside)
    cut = np.searchsorted(start, at)
    n_words = np.diff(cut)
    text = np.repeat(np.arange(len(data)), n_words)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = points[end] - points[start]
    prefix = ts.prefix_hash(ts.symbol_codes()[buf])
    word_prefix = ts.prefix_hash(ts.span(prefix, start, end))
    salt = ts.mix(text.astype(np.uint64) + np.uint64(1))

    def in_repeats(n: int) -> np.ndarray:
        first = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
        again = first[ts.repeated(ts.span(word_prefix, first, first + n) ^ salt[first])]
        return ts.covered(again, n, len(start))

    repeat_words = _per_text(in_repeats(3), cut)
    word_chars = _per_text(chars, cut)
    ngram_chars = np.stack([_per_text(np.where(in_repeats(n), chars, 0), cut) for n in ngram_shares], 1)

    line_end = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_cut = np.searchsorted(start, np.append(line_start, len(buf)))
    full = np.flatnonzero(np.diff(line_cut))
    owner = np.searchsorted(at, line_start[full], "right") - 1
    h = ts.span(prefix, line_start[full], line_end[full]) ^ ts.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    later = np.zeros(len(h), bool)
    later[order[1:]] = h[order[1:]] == h[order[:-1]]
    dup_lines = np.bincount(owner[later], minlength=len(data))
    line_chars = np.diff(np.concatenate([[0], np.cumsum(chars)])[line_cut])[full]
    dup_line_chars = np.bincount(owner[later], weights=line_chars[later], minlength=len(data)).astype(np.int64)

    base_failed = (n_words < min_words) | (100 * repeat_words > 50 * n_words)
    bad = dup_line_chars > line_share * word_chars
    for k, share in enumerate(ngram_shares.values()):
        bad |= ngram_chars[:, k] > share * word_chars
    return {
        "n_words": n_words.astype(np.int64), "word_chars": word_chars, "n_symbols": _per_text(SYMBOLS[buf], at), "n_dup_lines": dup_lines.astype(np.int64), "n_repeat_words": repeat_words,
        "base_failed": base_failed, "kept": ~base_failed & ~bad, "ngram_chars": pa.array(list(ngram_chars), pa.list_(pa.int64())), "dup_line_chars": dup_line_chars,
    }


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram_shares: dict[int, float] | None = None, line_share: float = LINE_SHARE, min_words: int = 50) -> DataFrame:
    """Counts and a verdict for each row of docs, from hashes rolled over its words and lines.

    ngram_chars holds, for each length of ngram_shares, the characters of words in n-grams found twice or more in the
    text (first ones included); dup_line_chars those in lines equal to an earlier one. A row is kept unless it has
    under min_words words, more than half of its words stand in repeated 3-word windows, or one of the shares is
    exceeded. Null and empty texts have no words and aren't kept. Rows keep their id, null or repeated, and only id and
    text are read, so further columns don't matter. No shuffle; memory follows a block of about 0.5 MB or one text.
    """
    shares = NGRAM_SHARES if ngram_shares is None else ngram_shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in ts.blocks(batches):
            yield ts.record(id=rows.column("id"), **_measure(data, shares, line_share, min_words))

    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The rows of docs, all columns, that repetition_coverage keeps; no shuffle, since each batch judges its own rows."""
    shares = rules.get("ngram_shares") or NGRAM_SHARES
    line_share, min_words = rules.get("line_share", LINE_SHARE), rules.get("min_words", 50)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in ts.blocks(batches, text_col):
            yield rows.filter(pa.array(_measure(data, shares, line_share, min_words)["kept"]))

    return docs.mapInArrow(run, docs.schema)
