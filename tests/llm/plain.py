"""The operators' results by brute force, over lists of (id, text)."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def lower(x: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def fingerprint(text, n):
    w = SPACED.findall(lower(text or ""))
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, radius=3):
    """Least position reachable for each value."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i + 1, len(values)):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def gone(sequences, n):
    """For each (id, sequence), which places stand in a window of n that also starts in a smaller id."""
    first = {}
    for i, s in sequences:
        if i is not None:
            for k in range(len(s) - n + 1):
                w = s[k : k + n]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, s in sequences:
        dead = np.zeros(len(s), bool)
        if i is not None:
            for k in range(len(s) - n + 1):
                if first[s[k : k + n]] < i:
                    dead[k : k + n] = True
        out.append(dead)
    return out


def shingles(text, n=5):
    w = SPACED.findall(lower(text or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def kept_by_jaccard(rows):
    """Ids of the least row of each group by brute force."""
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if 5 * both >= 4 * (len(s[i]) + len(s[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i, (k, _) in enumerate(rows):
        out[find(i)] = min(out.get(find(i), k), k)
    return sorted(out.values())


def cut_words(docs):
    found = [(i, tuple(SPACED.findall(t or ""))) for i, t in docs]
    return [(i, len(s), int(d.sum()), sha(" ".join(w for w, g in zip(s, d, strict=True) if not g).encode())) for (i, s), d in zip(found, gone(found, 50), strict=True)]


def cut_bytes(docs):
    found = [(i, (t or "").encode()) for i, t in docs]
    return [(i, len(s), int(d.sum()), int((np.diff(d.astype(int), prepend=0) == 1).sum()), sha(np.frombuffer(s, np.uint8)[~d].tobytes())) for (i, s), d in zip(found, gone(found, 50), strict=True)]


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for k, t in items:
        w = tuple(word.findall(lower(t or "")))
        for a in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows.setdefault(w[a : a + 10], set()).add("null" if k is None else str(k))
    out = []
    for i, t in docs:
        w = tuple(word.findall(lower(t or "")))
        hit, found = np.zeros(len(w), bool), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if names := windows.get(w[a : a + n]):
                    hit[a : a + n] = True
                    found |= names
        out.append((i, len(w), int(hit.sum()), tuple(sorted(found))))
    return out


def ranks(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line)}


def bpe(text, ranks, pattern):
    import tiktoken

    ids = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or "")
    return struct.pack(f"<{len(ids)}I", *ids)


def secrets(text):
    """(start, kind, end) of each span, windows counted anew each time."""
    from nightlights.llm import entropy as e

    out, text = [], text or ""
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        x = m[0]
        if len(x) < e.WINDOW or any(a in x.lower() for a in e.ALLOWED) or any(re.search(p, x) for p in e.ALLOWED_PATTERNS):
            continue
        kind = next(k for k, p, _ in e.CLASSES if re.search(p, x))
        inside = np.zeros(len(x), bool)
        for i in range(len(x) - e.WINDOW + 1):
            if sum(round(1e6 * c * math.log2(c)) for c in Counter(x[i : i + e.WINDOW]).values()) <= e.LIMITS[kind]:
                inside[i : i + e.WINDOW] = True
        edges = np.flatnonzero(np.diff(inside.astype(int), prepend=0, append=0)).tolist()
        out += [(m.start() + a, kind, m.start() + b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return sorted(out)


def variants(docs, min_length=5, min_count=3):
    """(word, form, root, n, n_near, form_n) from (id, text), neighbours found by leaving out a code point."""
    seen = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            k = h % len(run)
            seen[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= min_length and c >= min_count}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[k, w[:k], w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in n:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def audit(rows, min_documents=3, top=200):
    """(lang, source, part, item, value, rank) from (lang, source, text), with whole numbers of any size."""
    counts, documents = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for lang, source, text in rows:
        found = [lower(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or ""][source or ""].update(found)
        documents[lang or ""].update(set(found))
    out = []
    for lang, by in counts.items():
        kept = [x for x, n in documents[lang].items() if n >= min_documents]
        share = lambda own, total: [1 + 10**9 * (own[x] + 1) // (total + len(kept)) for x in kept]  # noqa: E731, B023
        whole = sum((by[s] for s in by), Counter())
        sums = {s: sum(by[s][x] for x in kept) for s in by}
        p, q = {s: share(by[s], sums[s]) for s in by}, share(whole, sum(sums.values()))
        for s in by:
            pairs = [(o, sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True))) for o in by if o != s]
            terms = [(x, (a - b) ** 2 // b) for x, a, b in zip(kept, p[s], q, strict=True) if by[s][x] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ranked)]
    return out
