"""Language identification: a linear-chain conditional random field labels every word, also of code-switched text; a text's
language has most of it. Transitions between languages are learned from texts made of pieces of labelled ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightlights.llm import textscan as ts
from nightlights.llm.tables import quoted

#: Rows to learn from, for each language, at most.
ROWS_PER_LANGUAGE = 400
#: Words of a piece of a chain.
CHAIN = 64
#: Texts to learn from for each code-switched one that is made of them, and the words of one of its pieces: from, below.
SWITCHED, PIECE = 4, (4, 40)
BITS = 17
#: Weights that are summed at a time.
CELLS = 1 << 21
_MASK = np.uint64((1 << BITS) - 1)
#: Letters of words: a-z after lower-casing, and all bytes from 0x80.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_HAS_LETTER = regex.compile(r"\p{L}").search


class Features:
    """Words of some texts with hashed features: three-byte n-grams with the word's ends, prefixes and suffixes of two
    and three bytes, and the word itself, which makes a lexicon."""

    def __init__(self, data: list[bytes]):
        buf, at = ts.joined([b" " + x for x in data], lower=True)
        letter = LETTER[buf]
        plain = np.where(letter, buf, np.uint8(0x20))
        self.start, self.end = ts.words(buf, letter)
        self.cut = np.searchsorted(self.start, at)
        b = plain.astype(np.uint64)
        trigram = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:] if len(b) > 2 else np.zeros(0, np.uint64)
        self.ngram = (ts.mix(trigram + np.uint64(1 << 32)) & _MASK).astype(np.int64)
        prefix = ts.prefix_hash(ts.symbol_codes()[plain])
        n = self.end - self.start
        pieces = [(self.start, self.start + np.minimum(n, 2)), (self.start, self.start + np.minimum(n, 3)), (self.end - np.minimum(n, 2), self.end), (self.end - np.minimum(n, 3), self.end), (self.start, self.end)]
        self.whole = np.stack([(ts.mix(ts.span(prefix, a, z) + np.uint64(k)) & _MASK).astype(np.int64) for k, (a, z) in enumerate(pieces)], 1)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Words x languages: the mean over a word's n-grams and the sum over its other features. Some words at a time, so that beside
        the result only CELLS numbers are held."""
        labels = weights.shape[1]
        out = np.zeros((len(self.start), labels))
        ends = np.searchsorted(self.end, np.arange(0, len(self.ngram) + 2, max(1, CELLS // labels)))
        for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(self.end)], strict=True):
            if i < j:
                first, last = self.start[i:j] - 1, self.end[i:j] - 1
                of = np.concatenate([weights[self.ngram[first[0] : last[-1]]], np.zeros((1, labels))])
                out[i:j] = np.add.reduceat(of, np.stack([first, last], 1).ravel() - first[0], axis=0)[::2] / (last - first)[:, None]
        for k in range(self.whole.shape[1]):
            out += weights[self.whole[:, k]]
        return out


def forward_backward(emission: np.ndarray, transition: np.ndarray, cut: np.ndarray, pairs: bool = True, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(each word's probabilities of the languages, expected numbers of transitions if pairs). Text k's words are those from
    cut[k] to cut[k + 1], one chain however long.

    Pieces of chain words take their steps together. What a text's earlier and later pieces mean for a piece comes from
    products of each piece's matrices, so the pieces don't change the result. With many languages these products cost more
    than steps, and texts are pieces as a whole.
    """
    labels = emission.shape[1]
    if not len(emission):
        return np.zeros((0, labels)), np.zeros((labels, labels))
    e, move = np.exp(emission - emission.max(1, keepdims=True)), np.exp(transition - transition.max())
    n = np.diff(cut)
    chain = chain if labels <= 16 else int(n.max())
    many = -(-n // chain)
    text = np.repeat(np.arange(len(n)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(chain, n[text] - chain * place)
    order = np.argsort(-size, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place, size, first = place[order], size[order], (cut[text] + chain * place)[order]
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()  # pieces with a word at each place; the longest come first
    alpha, beta = np.empty_like(e), np.empty_like(e)
    before, after = np.ones((len(first), labels)), np.ones((len(first), labels))
    if place.any():
        whole = np.broadcast_to(np.eye(labels), (len(first), labels, labels)).copy()
        for t, k in enumerate(active):
            step = whole[:k] @ move
            if t == 0:
                step[place[:k] == 0] = np.eye(labels)
            step *= e[first[:k] + t][:, None, :]
            whole[:k] = step / step.sum((1, 2), keepdims=True)
        turns = np.argsort(place, kind="stable")
        turns = np.split(turns, np.cumsum(np.bincount(place))[:-1])  # pieces by their place in the text
        following = np.append(rank[1:], 0)[order]  # the next piece of the text, where there is one
        for own in turns[1:]:
            previous = rank[order[own] - 1]
            now = (before[previous][:, None, :] @ whole[previous])[:, 0]
            before[own] = now / now.sum(1, keepdims=True)
        for own in reversed(turns[:-1]):
            own = own[many[text[order[own]]] > place[own] + 1]
            now = (whole[following[own]] @ after[following[own]][:, :, None])[:, :, 0]
            after[own] = now / now.sum(1, keepdims=True)
    now = np.where((place == 0)[:, None], 1.0, before @ move)
    for t, k in enumerate(active):
        at = first[:k] + t
        now = (now[:k] if t == 0 else now[:k] @ move) * e[at]
        now /= now.sum(1, keepdims=True)
        alpha[at] = now
    beta[first + size - 1] = after
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t + 1
        now = (beta[at] * e[at]) @ move.T
        beta[at - 1] = now / now.sum(1, keepdims=True)
    out = alpha * beta
    out /= out.sum(1, keepdims=True)
    total = np.zeros((labels, labels))
    if pairs:
        later = np.ones(len(e), bool)
        later[cut[:-1][n > 0]] = False
        later = np.flatnonzero(later)
        step = max(1, (1 << 22) // (labels * labels))
        for k in range(0, len(later), step):
            at = later[k : k + step]
            pair = alpha[at - 1, :, None] * move * (beta[at] * e[at])[:, None, :]
            total += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return out, total


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray


def switched(texts: list[bytes], labels: list[str], rng: np.random.Generator) -> tuple[list[bytes], list[list[tuple[int, str]]]]:
    """Code-switched texts made of labelled ones: pieces of PIECE words of two languages by turns, so that transitions between
    languages are seen and learned; and the pieces' lengths and languages. One for each SWITCHED texts."""
    by = {k: [x.split() for x, y in zip(texts, labels, strict=True) if y == k] for k in sorted(set(labels))}
    out, about = [], []
    for _ in range(len(texts) // SWITCHED if len(by) > 1 else 0):
        two = [by[k] for k in rng.choice(list(by), 2, replace=False)]
        names = [next(k for k in by if by[k] is x) for x in two]
        pieces, marks = [], []
        for turn in range(int(rng.integers(2, 7))):
            words = two[turn % 2][int(rng.integers(len(two[turn % 2])))]
            start, n = int(rng.integers(max(1, len(words)))), int(rng.integers(*PIECE))
            piece = b" ".join(words[start : start + n])
            if piece:
                pieces.append(piece)
                marks.append((len(Features([piece]).start), names[turn % 2]))
        out.append(b" ".join(pieces))
        about.append(marks)
    return out, about


def fit(texts: list[bytes], labels: list[str], epochs: int = 4, batch: int = 48, rate: float = 0.3, seed: int = 7) -> Model:
    """Adaptive gradient ascent on the texts' log-likelihood. All words of a text have its label; switched texts have their pieces'."""
    languages = sorted(set(labels)) or ["und"]
    size = len(languages)
    model = Model(languages, np.zeros((1 << BITS, size), np.float32), np.zeros((size, size)))
    seen_w, seen_t = np.full(model.weights.shape, 1e-2, np.float32), np.full((size, size), 1e-2)
    rng = np.random.default_rng(seed)
    mixed, marks = switched(texts, labels, rng)
    texts = [*texts, *mixed]
    runs = [*([(None, x)] for x in labels), *marks]
    order = np.argsort([len(x) for x in texts], kind="stable")  # texts of a batch take their steps together, so they are of about one length
    parts = np.array_split(order, max(1, -(-len(texts) // batch)))
    for _ in range(epochs):
        for part in (parts[k] for k in rng.permutation(len(parts))):
            f = Features([texts[i] for i in part])
            if not len(f.start):
                continue
            count = np.diff(f.cut)
            y = np.concatenate([np.repeat([languages.index(k) for _, k in runs[i]], [count[j] if n is None else n for n, _ in runs[i]]) for j, i in enumerate(part)]).astype(np.int64)
            p, pair = forward_backward(f.emissions(model.weights), model.transition, f.cut)
            gap = -p
            gap[np.arange(len(y)), y] += 1
            n = f.end - f.start
            each = np.repeat(np.arange(len(y)), n)
            spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (f.start - 1)[each]
            index = np.concatenate([f.ngram[spot], *f.whole.T])
            value = np.concatenate([gap[each] / n[each][:, None], *[gap] * f.whole.shape[1]])
            rows, back = np.unique(index, return_inverse=True)
            grad = np.stack([np.bincount(back, value[:, k], len(rows)) for k in range(size)], 1) / len(part)
            grad -= 1e-5 * model.weights[rows]
            seen_w[rows] += grad**2
            model.weights[rows] += rate * grad / np.sqrt(seen_w[rows])
            inner = np.ones(len(y), bool)
            inner[f.cut[:-1][count > 0]] = False
            inner = np.flatnonzero(inner)
            truth = np.zeros((size, size))
            np.add.at(truth, (y[inner - 1], y[inner]), 1)
            grad = (truth - pair) / len(part) - 1e-3 * model.transition
            seen_t += grad**2
            model.transition += rate * grad / np.sqrt(seen_t)
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fold: int, folds: int) -> tuple[list[bytes], list[str]]:
    """Whole texts and labels of ROWS_PER_LANGUAGE rows at most of every language: those of the least hashes of id and text
    outside the fold. Hashes below a bound are taken first, so that few rows are ordered whatever the table's size."""
    id_, text, lang = (F.col(quoted(c)) for c in (id_col, text_col, lang_col))
    usable = docs.where((F.crc32(id_.cast("string")) % folds != fold) & text.isNotNull() & lang.isNotNull()).select(lang.cast("string").alias("lang"), text.cast("string").alias("text"), (F.xxhash64(F.lit("langid"), id_, text) / 2.0**64 + 0.5).alias("place"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return [], []
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 2.0 * ROWS_PER_LANGUAGE / r.n))]), F.col("lang"))
    few = usable.where(F.col("place") <= share)
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).where(F.col("k") <= ROWS_PER_LANGUAGE)
    rows = sorted((r.lang, r.text) for r in chosen.select("lang", "text").collect())
    return [t.encode() for _, t in rows], [k for k, _ in rows]


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs array<struct<start, end, lang>>) for each row: maximal runs of words whose likeliest language, by
    forward-backward over the whole text, is the same; start and end are bytes of the text in UTF-8. Words are runs of letters
    a-z and of other characters beyond ASCII. None where there are no words, as in null and empty texts. Rows keep their ids, null or
    repeated; other columns aren't read; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data in ts.blocks(batches):
            f = Features(data)
            best = forward_backward(f.emissions(m.weights), m.transition, f.cut, pairs=False)[0].argmax(1)
            base = np.cumsum([0, *(len(x) + 2 for x in data)])
            out = []
            for k in range(len(data)):
                lo, hi = f.cut[k], f.cut[k + 1]
                turn = np.flatnonzero(np.diff(best[lo:hi], prepend=-1)) + lo
                out.append([{"start": int(f.start[a] - base[k] - 1), "end": int(f.end[z - 1] - base[k] - 1), "lang": m.languages[best[a]]} for a, z in zip(turn.tolist(), [*turn[1:].tolist(), int(hi)], strict=True)] if hi > lo else [])
            yield ts.record(id=rows.column("id"), runs=pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))

    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, runs array<struct<start:long,end:long,lang:string>>").withColumnRenamed("id", id_col)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, shares array<double>) for each row: the language of the largest mean probability over all
    words, that mean, and the means of all languages. lang_pred is und and score 0 where the text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data in ts.blocks(batches, limit=max(1 << 14, (1 << 22) // max(4, len(m.languages)))):
            f = Features(data)
            p, _ = forward_backward(f.emissions(m.weights), m.transition, f.cut, pairs=False)
            owner = np.repeat(np.arange(len(data)), np.diff(f.cut))
            share = np.stack([np.bincount(owner, p[:, k], len(data)) for k in range(len(m.languages))], 1) / np.maximum(1, np.diff(f.cut))[:, None]
            known = (m.languages != ["und"]) & np.array([_HAS_LETTER(x.decode("utf-8", "replace")) is not None for x in data], bool) & (np.diff(f.cut) > 0)
            best = share.argmax(1)
            score = np.where(known, np.clip(share[np.arange(len(data)), best], 0, 1), 0.0)
            yield ts.record(id=rows.column("id"), lang_pred=pa.array([m.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string()), score=score, shares=pa.array(share.tolist(), pa.list_(pa.float64())))

    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, shares array<double>").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 1, folds: int = 3) -> DataFrame:
    """Learns from docs outside the fold crc32(id) % folds == fold and predicts every row, by all of its words. Every language
    with a row to learn from can be predicted; at most ROWS_PER_LANGUAGE rows of each, whole texts, reach the driver. Rows of
    a null id aren't learned from; repeated rows are learned from as often as they are drawn. With nothing to learn from
    every row is und. Only the named columns are read, so others may have any name."""
    return predict(docs, fit(*sample(docs, id_col, text_col, lang_col, fold, folds)), id_col, text_col)
