"""Radix tries of byte strings with counters at their leaves, kept in the order of a traversal."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

#: Bytes of neighbouring terms that are compared at once.
_WIDE = 32
_KINDS = (np.uint8, np.uint16, np.uint32, np.int64)


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b)) + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def depths(terms: list[bytes]) -> np.ndarray:
    """For each of sorted terms, the length of the path that it has in common with the term before it."""
    if not terms:
        return np.zeros(0, np.int64)
    length = np.fromiter(map(len, terms), np.int64, len(terms))
    starts = np.array(terms, f"S{_WIDE}").view(np.uint8).reshape(len(terms), _WIDE)
    differs = starts[1:] != starts[:-1]
    same = np.where(differs.any(1), differs.argmax(1), _WIDE)
    out = np.concatenate([[0], np.minimum(same, np.minimum(length[1:], length[:-1]))])
    for k in np.flatnonzero(out == _WIDE).tolist():
        out[k] = shared(terms[k - 1], terms[k])
    return out


class Trie:
    """A radix trie in the order of its bytes: depth[k] is where leaf k's edge leaves the path to the leaf before it, tails holds
    the edges' bytes one after the other, and each leaf has its documents and its counts by source (leaf_from[k] to leaf_from[k + 1])."""

    def __init__(self, depth: np.ndarray, length: np.ndarray, tails: bytes, documents: np.ndarray, leaf_from: np.ndarray, source: np.ndarray, count: np.ndarray):
        self.depth, self.length, self.tails, self.documents, self.leaf_from, self.source, self.count = depth, length, tails, documents, leaf_from, source, count

    def __len__(self) -> int:
        return len(self.depth)

    @classmethod
    def of(cls, terms: list[bytes], documents: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> Trie:
        """From sorted terms, each one's documents, and counters (leaf, source, count), of which those of one leaf and source are added up."""
        depth = depths(terms)
        edges = [t[d:] for t, d in zip(terms, depth.tolist(), strict=True)]
        order = np.lexsort((source, leaf))
        leaf, source, count = leaf[order], source[order], count[order]
        new = np.flatnonzero(np.diff(leaf, prepend=-1) | np.diff(source, prepend=-1))
        count = np.add.reduceat(count, new) if len(new) else count
        length = np.fromiter(map(len, edges), np.int64, len(edges))
        return cls(depth, length, b"".join(edges), documents, np.searchsorted(leaf[new], np.arange(len(terms) + 1)), source[new], count)

    def terms(self) -> Iterator[bytes]:
        """The traversal: every leaf's path, in order of bytes, which is that of code points."""
        path, at = b"", 0
        for depth, n in zip(self.depth.tolist(), self.length.tolist(), strict=True):
            path = path[:depth] + self.tails[at : at + n]
            at += n
            yield path

    def leaves(self) -> np.ndarray:
        """Each counter's leaf."""
        return np.repeat(np.arange(len(self)), np.diff(self.leaf_from))

    def pack(self) -> bytes:
        """Sizes, the kinds of numbers, and the arrays, each in the smallest kind that holds it."""
        arrays = [self.depth, self.length, self.documents, self.leaf_from, self.source, self.count]
        kinds = [next(k for k, kind in enumerate(_KINDS) if not len(x) or x.max() <= np.iinfo(kind).max) for x in arrays]
        return np.array([len(self.depth), len(self.source), *kinds], np.int64).tobytes() + b"".join(x.astype(_KINDS[k]).tobytes() for x, k in zip(arrays, kinds, strict=True)) + self.tails

    @classmethod
    def unpack(cls, packed: bytes) -> Trie:
        n, m, *kinds = np.frombuffer(packed, np.int64, 8).tolist()
        at, found = 64, []
        for size, k in zip((n, n, n, n + 1, m, m), kinds, strict=True):
            x = np.frombuffer(packed, _KINDS[k], size, at)
            found.append(x.astype(np.int64))
            at += x.nbytes
        depth, length, documents, leaf_from, source, count = found
        return cls(depth, length, packed[at:], documents, leaf_from, source, count)

    def cut(self, bounds: list[bytes]) -> Iterator[tuple[int, Trie]]:
        """(number of the range, its part) for the ranges between bounds, those without leaves left out. A part is a slice
        whose first edge is that leaf's whole path."""
        terms = list(self.terms()) if bounds else []
        ends = [0, *(bisect_left(terms, b) for b in bounds), len(self)]
        at = np.concatenate([[0], np.cumsum(self.length)])
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if a == b:
                continue
            depth, length, low, high = self.depth[a:b].copy(), self.length[a:b].copy(), self.leaf_from[a], self.leaf_from[b]
            tails = self.tails[at[a] : at[b]]
            if depth[0]:
                tails = terms[a][: depth[0]] + tails
                depth[0], length[0] = 0, length[0] + depth[0]
            yield k, Trie(depth, length, tails, self.documents[a:b], self.leaf_from[a : b + 1] - low, self.source[low:high], self.count[low:high])


def merge(tries: list[Trie], sources: list[np.ndarray], min_documents: int = 0) -> Trie:
    """One trie from several, whose own numbers of sources stand for those in sources: equal paths become one leaf, whose
    counters are sums. Leaves of too few documents go."""
    paths = [list(t.terms()) for t in tries]
    order = sorted(set().union(*paths))
    place = dict(zip(order, range(len(order)), strict=True))
    at = [np.fromiter(map(place.__getitem__, p), np.int64, len(p)) for p in paths]
    documents = np.zeros(len(order), np.int64)
    for where, t in zip(at, tries, strict=True):
        documents[where] += t.documents
    kept = documents >= min_documents
    whole = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
    leaf = whole(where[t.leaves()] for where, t in zip(at, tries, strict=True))
    source, count = whole(own[t.source] for own, t in zip(sources, tries, strict=True)), whole(t.count for t in tries)
    stays = kept[leaf]
    return Trie.of([x for x, k in zip(order, kept.tolist(), strict=True) if k], documents[kept], (np.cumsum(kept) - 1)[leaf[stays]], source[stays], count[stays])
