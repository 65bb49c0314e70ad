"""Suffix-array dedup of byte strings: what repeats from an earlier document, found by sorting sampled suffixes.

A string of LENGTH bytes has an anchor, the least hashed of its K-byte pieces, chosen by its content alone; equal strings
have equal anchors at equal offsets. So only suffixes at anchors are sorted, forwards and backwards: two strings with
their anchor at offset o are equal if the suffixes share LENGTH - o bytes to the right of it and o to the left.

1. Documents are dealt once into blocks. A block sends its anchors' hashes, 4 bytes each, to buckets, which answer with
   those that other documents have too.
2. Blocks send the surroundings of the anchors that are left, each once, to buckets, which sort the suffixes there and
   answer for each surrounding at which offsets a smaller document has the string.
3. Blocks cut what is covered. The documents' exchange is the same in all three steps, so Spark reuses it.

Documents and surroundings are compressed before they are exchanged, since exchanges stay on disk until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightlights.llm import textscan as ts
from nightlights.llm.tables import quoted, row_key

LENGTH = 50
K = 24
#: Consecutive pieces of a string of LENGTH bytes.
W = LENGTH - K + 1
#: Bytes of the surroundings of an anchor: all strings that it is the anchor of.
ROOM = 80
#: An anchor with more than HOT packs of PACK different surroundings, a block's last pack counted whole, goes out string by string, so
#: that buckets of strings share it. That makes about a dozen surroundings of one, so the number of blocks alone must not decide.
HOT, PACK = 8192, 16
#: Bytes of texts in a block, and of those whose anchors share a bucket, about, wherever there are more than shuffle partitions hold.
BLOCK_BYTES = 64 << 20
_POSITION = np.uint64((1 << 24) - 1)
_SEGMENT = 1 << 23


# Deep-shallow sorting

SHALLOW = 2
SMALL = 24


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


def blind_trie_order(members: list[int], strings: list[bytes]) -> list[int]:
    """members in the order of their strings (all of one length), through a blind trie: nodes hold only the depth at
    which strings part and the bytes there, so that each string is compared in full with one other."""
    trie: _Node | list[int] = [members[0]]
    for i in members[1:]:
        s, at = strings[i], trie
        while type(at) is _Node:
            at = at.kids.get(s[at.depth]) or next(iter(at.kids.values()))
        other = strings[at[0]]
        if s == other:
            at.append(i)
            continue
        shared = len(s) - ((int.from_bytes(s) ^ int.from_bytes(other)).bit_length() + 7) // 8
        above, at = None, trie
        while type(at) is _Node and at.depth < shared:
            above, at = at, at.kids[s[at.depth]]
        if type(at) is _Node and at.depth == shared:
            at.kids[s[shared]] = [i]
            continue
        node = _Node(shared, {s[shared]: [i], other[shared]: at})
        if above is None:
            trie = node
        else:
            above.kids[s[above.depth]] = node
    out: list[int] = []
    stack = [trie]
    while stack:
        at = stack.pop()
        if type(at) is _Node:
            stack += [at.kids[b] for b in sorted(at.kids, reverse=True)]
        else:
            out += at
    return out


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of byte strings given as rows of a matrix; lcp[i]: what the i-th in order shares with the one before.

    Multikey quicksort by characters of 8 bytes to SHALLOW of them; groups that still agree there, or have few members,
    are ordered by a blind trie.
    """
    n, width = rows.shape
    whole = np.zeros((n, -(-width // 8) * 8), np.uint8)
    whole[:, :width] = rows
    chars = whole.view(">u8").astype(np.uint64)
    raw = rows.tobytes()
    strings = [raw[i : i + width] for i in range(0, n * width, width)]
    out: list[int] = []
    stack = [(np.arange(n), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) <= 1:
            out += part.tolist()
        elif depth == min(SHALLOW, chars.shape[1]) or len(part) <= SMALL:
            out += blind_trie_order(part.tolist(), strings)
        else:
            c = chars[part, depth]
            pivot = np.sort(c[[0, len(c) // 2, -1]])[1]
            stack += [(part[c > pivot], depth), (part[c == pivot], depth + 1), (part[c < pivot], depth)]
    order = np.array(out, np.int64)
    lcp = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 16):
        differ = rows[order[a : a + (1 << 16)]] != rows[order[a - 1 : a - 1 + len(order[a : a + (1 << 16)])]]
        lcp[a : a + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


# Anchors


def row_hash(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each row; the width is a multiple of 8."""
    w = np.ascontiguousarray(rows).view(np.uint64)
    h = np.full(len(rows), seed, np.uint64)
    for j in range(w.shape[1]):
        h = ts.mix(h ^ w[:, j]) + np.uint64(j + 1)
    return ts.mix(h)


def _gather(buf: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(buf, width)[start]


class Part:
    """Anchors of some texts: for each, its text, place, first and last string start, and hash."""

    def __init__(self, data: list[bytes], docs: np.ndarray):
        whole = b"".join(data)
        self.buf = np.frombuffer(whole + b"\0" * ROOM, np.uint8)
        n, at = len(whole), np.concatenate([[0], np.cumsum([len(x) for x in data])])
        least = np.zeros(0, np.int64)
        if n >= LENGTH:
            prefix = ts.prefix_hash(ts.symbol_codes()[self.buf[:n]])
            where = np.arange(n - K + 1)
            v = ts.span(prefix, where, where + K) & ~_POSITION | where.astype(np.uint64)
            width = 1
            while width * 2 <= W:
                v = np.minimum(v[:-width], v[width:])
                width *= 2
            least = (np.minimum(v[: len(v) - (W - width)], v[W - width :]) & _POSITION).astype(np.int64)
        owner = np.repeat(np.arange(len(data)), np.diff(at))[: len(least)]
        start = np.flatnonzero(np.arange(len(least)) + LENGTH <= at[owner + 1])
        owner, least = owner[start], least[start]
        new = np.ones(len(start), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.first, self.last = start[first], start[np.append(first[1:], len(start)) - 1] if len(start) else start
        self.place, self.text, self.base = least[first], owner[first], at
        self.doc = docs[self.text]
        self.key = row_hash(_gather(self.buf, self.place, K), 7)


def parts(data: list[bytes], docs: np.ndarray, usable: np.ndarray) -> Iterator[tuple[Part, list[int], list[int]]]:
    """Parts of at most about BLOCK bytes with the numbers of their texts and where in these they begin; texts beyond
    _SEGMENT bytes go in overlapping pieces."""
    held: list[bytes] = []
    which: list[int] = []
    offset: list[int] = []
    size = 0
    for i, x in enumerate(data):
        if not usable[i] or len(x) < LENGTH:
            continue
        for k in range(0, max(1, len(x) - LENGTH + 1), _SEGMENT):
            piece = x[k : k + _SEGMENT + LENGTH - 1] if len(x) > _SEGMENT else x
            if held and size + len(piece) > ts.BLOCK:
                yield Part(held, docs[which]), which, offset
                held, which, offset, size = [], [], [], 0
            held.append(piece)
            which.append(i)
            offset.append(k)
            size += len(piece)
    if held:
        yield Part(held, docs[which]), which, offset


class Block:
    """A block of documents: its anchors, and what it sends to and gets from buckets, always in the same order."""

    def __init__(self, docs: pa.Table, id_col: str, text_col: str, buckets: int):
        self.buckets = buckets
        self.data = ts.encoded(docs.column(text_col).combine_chunks())
        ids = docs.column(id_col).combine_chunks()
        self.usable = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
        self.ids = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        self.parts = list(parts(self.data, self.ids, self.usable))
        key, doc = (np.concatenate([getattr(p, c) for p, _, _ in self.parts] or [np.zeros(0, kind)]) for c, kind in (("key", np.uint64), ("doc", np.int64)))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        last = np.append(first[1:], len(key)) - 1 if len(key) else first
        packs = self._packs(key[first], last - first + 1)
        #: Of each anchor a row for each pack, and whether several documents here have it.
        self.keys, self.many = np.repeat(key[first], packs), np.repeat(doc[first] != doc[last], packs)

    def _packs(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Of each anchor how many packs its different surroundings here make."""
        packs, often = np.ones(len(keys), np.int64), np.flatnonzero(times > PACK)
        if len(often):
            found = []
            for p, _, _ in self.parts:
                at = np.searchsorted(keys[often], p.key)
                own = np.flatnonzero(keys[often][np.minimum(at, len(often) - 1)] == p.key)
                room = np.where(np.arange(ROOM) < (p.last - p.first)[own, None] + LENGTH, _gather(p.buf, p.first[own], ROOM), np.uint8(0))
                found.append(np.stack([at[own].astype(np.uint64), row_hash(room, 11)], 1))
            which, n = np.unique(np.unique(np.concatenate(found), axis=0)[:, 0].astype(np.int64), return_counts=True)
            packs[often[which]] = -(-n // PACK)
        return packs

    def _by_bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order by bucket, stable; where each bucket's share ends)."""
        b = ((h & np.uint64(0xFFFFFF)) % np.uint64(self.buckets)).astype(np.int64)
        return np.argsort(b, kind="stable"), np.cumsum(np.bincount(b, minlength=self.buckets))

    def anchors(self) -> list[tuple[int, bytes]]:
        """(bucket, its anchors in 4 bytes each: 31 bits of hash, others than choose the bucket, and 1 if several documents here have it).
        Different anchors that agree in these are candidates for nothing, and no more."""
        order, ends = self._by_bucket(self.keys)
        short = ((self.keys[order] >> np.uint64(33)) << np.uint64(1) | self.many[order].astype(np.uint64)).astype("<u4")
        return [(b, short[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if hi > lo]

    def candidates(self, answers: dict[int, bytes]) -> None:
        """Takes the buckets' answers and gathers the surroundings of anchors that other documents have, each once."""
        order, _ = self._by_bucket(self.keys)
        status = np.zeros(len(self.keys), np.uint8)
        if len(order):
            status[order] = np.frombuffer(b"".join(answers[b] for b in sorted(answers)), np.uint8)
        rooms, lows, highs, docs, home = [], [], [], [], []
        for k, (p, _, _) in enumerate(self.parts):
            found = status[np.searchsorted(self.keys, p.key)]
            one = np.flatnonzero(found == 1)
            hot = np.flatnonzero(found == 2)
            n = p.last[hot] - p.first[hot] + 1
            at = np.concatenate([one, np.repeat(hot, n)])
            begin = np.concatenate([p.first[one], np.repeat(p.first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
            stop = np.concatenate([p.last[one], begin[len(one) :]])
            room = _gather(p.buf, begin, ROOM)
            room = np.where(np.arange(ROOM) < (stop - begin + LENGTH)[:, None], room, np.uint8(0))
            rooms.append(room)
            highs.append((p.place[at] - begin).astype(np.uint8))
            lows.append((p.place[at] - stop).astype(np.uint8))
            docs.append(p.doc[at])
            home.append(np.stack([np.full(len(at), k), p.text[at], p.place[at], np.arange(len(at)) >= len(one)], 1))
        empty = not rooms
        room = np.zeros((0, ROOM), np.uint8) if empty else np.concatenate(rooms)
        low, high, doc = (np.zeros(0, kind) if empty else np.concatenate(x) for x, kind in ((lows, np.uint8), (highs, np.uint8), (docs, np.int64)))
        self.home = np.zeros((0, 4), np.int64) if empty else np.concatenate(home)
        name = row_hash(room, 11) ^ ts.mix(low.astype(np.uint64) * np.uint64(256) + high + np.uint64(1))
        key = piece_keys(room, high)
        route = np.where(self.home[:, 3] == 1, row_hash(room, 13), key)
        order = np.lexsort((doc, name, route))
        route, name, doc = route[order], name[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (route[1:] != route[:-1])
        first = np.flatnonzero(new)
        #: Of each candidate its entry, the candidates' order, and the smallest document here with the entry.
        self.entry, self.order, self.low, self.high, self.doc = np.cumsum(new) - 1, order, low[order], high[order], doc
        self.entries = first
        self.room, self.route = room[order[first]], route[first]

    def surroundings(self) -> list[dict]:
        order, ends = self._by_bucket(self.route)
        out = []
        for b, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if hi > lo:
                pick = self.entries[order[lo:hi]]
                out.append({"bucket": b, "room": self.room[order[lo:hi]].tobytes(), "low": self.low[pick].tobytes(), "high": self.high[pick].tobytes(), "doc": self.doc[pick].tobytes()})
        return out

    def covered(self, answers: dict[int, bytes]) -> list[np.ndarray]:
        """For each text, which of its bytes to cut."""
        order, _ = self._by_bucket(self.route)
        mask = np.zeros(len(self.entries), np.uint32)
        if len(order):
            mask[order] = np.frombuffer(b"".join(answers[b] for b in sorted(answers)), np.uint32)
        mine = mask[self.entry] | np.where(self.doc > self.doc[self.entries][self.entry], np.uint32(0xFFFFFFFF), np.uint32(0))
        out = [np.zeros(len(x), bool) for x in self.data]
        part, _, place, _ = self.home[self.order].T
        for k, (p, which, offset) in enumerate(self.parts):
            own = np.flatnonzero(part == k)
            bits, low, high, at = mine[own], self.low[own], self.high[own], place[own]
            starts = np.zeros(len(p.buf) + 1, np.int32)
            for o in range(W):
                starts[at[(bits >> np.uint32(o) & np.uint32(1)).astype(bool) & (low <= o) & (o <= high)] - o] = 1
            inside = np.cumsum(starts[:-1] - np.concatenate([np.zeros(LENGTH, np.int32), starts[: -1 - LENGTH]])) > 0
            for i, shift, a, b in zip(which, offset, p.base[:-1].tolist(), p.base[1:].tolist(), strict=True):
                out[i][shift : shift + b - a] |= inside[a:b]
        return out


def piece_keys(room: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the anchor in each row, which stands at high."""
    out = np.zeros(len(room), np.uint64)
    for h in np.unique(high):
        at = np.flatnonzero(high == h)
        out[at] = row_hash(room[at, int(h) : int(h) + K], 7)
    return out


def repeated_anchors(blobs: list[bytes]) -> list[bytes]:
    """For the anchors of each block of a bucket: 0 where one document alone has it, 1 where several, 2 where very many."""
    each = [np.frombuffer(x, "<u4") for x in blobs]
    every = np.concatenate(each)
    keys, packs = np.unique(every >> 1, return_counts=True)
    several = np.zeros(len(keys), bool)
    several[np.searchsorted(keys, every[every & 1 == 1] >> 1)] = True
    blocks = np.zeros(len(keys), np.int64)
    for x in each:
        blocks[np.searchsorted(keys, np.unique(x >> 1))] += 1
    status = np.where(packs > HOT, 2, several | (blocks > 1)).astype(np.uint8)
    return [status[np.searchsorted(keys, x >> 1)].tobytes() for x in each]


def pack(x: bytes) -> bytes:
    """x compressed, after its length."""
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def unpack(x: bytes) -> bytes:
    return pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def packed(rows: pa.Table) -> list[bytes]:
    """rows in one blob; none of none."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return [pack(sink.getvalue().to_pybytes())] if len(rows) else []


def unpacked(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(unpack(x)).read_all() for x in blobs])


def compare(room: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each surrounding a bit for each offset at which the string there also stands in a smaller document's."""
    key = piece_keys(room, high)
    name = row_hash(room, 11) ^ ts.mix(low.astype(np.uint64) * np.uint64(256) + high + np.uint64(1))
    order = np.lexsort((doc, name, key))
    new = np.ones(len(order), bool)
    new[1:] = (name[order[1:]] != name[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    lead = order[new]
    least = np.repeat(doc[lead][:, None], W, 1)
    _, at, n = np.unique(key[lead], return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[at] > 1)
    if len(several):
        pick = lead[several]
        h = high[pick].astype(np.int64)
        wide = np.concatenate([np.zeros((len(pick), W), np.uint8), room[pick], np.zeros((len(pick), W), np.uint8)], 1)
        right = wide[np.arange(len(pick))[:, None], W + h[:, None] + np.arange(LENGTH)]
        left = wide[np.arange(len(pick))[:, None], W + h[:, None] - 1 - np.arange(W)]
        ranks = []
        for rows in (right, left):
            rank, lcp = deep_shallow(rows)
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            ranks.append((place, lcp))
        for o in range(W):
            valid = np.flatnonzero((low[pick] <= o) & (o <= high[pick]))
            (rp, rl), (lp, ll) = ranks
            r = np.cumsum(rl < LENGTH - o)[rp[valid]]
            group = r * (len(pick) + 1) + np.cumsum(ll < o)[lp[valid]]
            order = np.lexsort((doc[pick[valid]], group))
            g = group[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]))
            small = np.empty(len(g), np.int64)
            small[order] = np.repeat(doc[pick[valid]][order[first]], np.diff(np.append(first, len(g))))
            least[several[valid], o] = small
    return ((least[kind] < doc[:, None]).astype(np.uint32) << np.arange(W, dtype=np.uint32)).sum(1, dtype=np.uint32)


# Spark


def _cut(docs: DataFrame, id_col: str, text_col: str, whole_characters: bool) -> DataFrame:
    """c0, c1, ... (the columns of docs), kept and spans."""
    id_name, text_name = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(F.col(quoted(text_col)).cast("string")).cast("long"))).first()[0] or 0
    blocks, buckets = max(2 * n, -(-size // BLOCK_BYTES)), max(n, -(-size // BLOCK_BYTES))
    named = docs.select(F.pmod(row_key(docs)[0], F.lit(blocks)).cast("int").alias("block"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    fields = named.columns[1:]

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for x in batches if x.num_rows):
            rows, block = pa.Table.from_batches([batch]), batch.column("block").to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            ends = np.flatnonzero(np.diff(block[order], append=-1)) + 1
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                yield pa.record_batch({"block": pa.array([block[order[lo]]], pa.int32()), "docs": pa.array(packed(rows.take(order[lo:hi]).select(fields)), pa.binary())})

    dealt = named.mapInArrow(by_block, "block int, docs binary").repartition(max(n, -(-blocks // 2)), "block")
    read = lambda table: unpacked(table.column("docs").to_pylist())

    def send(table: pa.Table) -> pa.Table:
        out = Block(read(table), id_name, text_name, buckets).anchors()
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(out), pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        answers = repeated_anchors(table.column("blob").to_pylist())
        return pa.table({"block": table.column("block"), "step": pa.array([1] * len(table), pa.int32()), "bucket": table.column("bucket"), "blob": pa.array(answers, pa.binary())})

    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if len(docs):
            block = Block(read(docs), id_name, text_name, buckets)
            block.candidates(_answers(answers, 1))
            out = [x | {"room": pack(x["room"])} for x in block.surroundings()]
        number = docs.column("block")[0].as_py() if len(docs) else None
        return pa.Table.from_pylist([x | {"block": number} for x in out], pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("room", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("doc", pa.binary())]))

    def sort(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        low = [np.frombuffer(r["low"], np.uint8) for r in rows]
        mask = compare(np.frombuffer(b"".join(unpack(r["room"]) for r in rows), np.uint8).reshape(-1, ROOM), np.concatenate(low), np.frombuffer(b"".join(r["high"] for r in rows), np.uint8), np.frombuffer(b"".join(r["doc"] for r in rows), np.int64))
        cuts = np.cumsum([len(x) for x in low])[:-1]
        return pa.table({"block": table.column("block"), "step": pa.array([2] * len(rows), pa.int32()), "bucket": table.column("bucket"), "blob": pa.array([x.tobytes() for x in np.split(mask, cuts)], pa.binary())})

    made = T.StructType(named.schema.fields[1:]).add("kept", "binary").add("spans", T.ArrayType(T.StructType().add("start", "long").add("length", "long")))

    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kept, spans, out = [], [], pa.table({})
        if len(docs):
            out = read(docs)
            block = Block(out, id_name, text_name, buckets)
            block.candidates(_answers(answers, 1))
            for x, gone in zip(block.data, block.covered(_answers(answers, 2)), strict=True):
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                spans.append([{"start": a, "length": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                left = np.frombuffer(x, np.uint8)[~gone].tobytes() if len(edge) else x
                kept.append(left.decode("utf-8", "ignore").encode() if whole_characters and len(edge) else left)
        return out.append_column("kept", pa.array(kept, pa.binary())).append_column("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))))

    answer = "block int, step int, bucket int, blob binary"
    first = dealt.groupBy("block").applyInArrow(send, "bucket int, block int, blob binary").groupBy("bucket").applyInArrow(judge, answer)
    second = dealt.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask, "bucket int, block int, room binary, low binary, high binary, doc binary").groupBy("bucket").applyInArrow(sort, answer)
    both = first.unionByName(second)
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, made)


def _answers(table: pa.Table, step: int) -> dict[int, bytes]:
    return {b: x for s, b, x in zip(table.column("step").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True) if s == step} if len(table) else {}


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """docs, all columns, with _kept binary (the text's bytes that stay; with whole_characters without the rest of
    characters that a cut splits) and _spans array<struct<start, length>> (the
    maximal runs cut, in bytes of the text).

    A byte is cut if a string of LENGTH bytes over it also starts in a document with a smaller id. Ids are integers; rows
    with a null id neither lose bytes nor cause it, repeated rows of one id don't cut each other, null texts are empty.
    Columns of docs with the added names are replaced; others may have any name and type. Numbers of blocks and buckets
    follow the texts' bytes, so a task's share doesn't grow with the table.
    """
    docs = docs.drop("_kept", "_spans")
    found = _cut(docs, id_col, text_col, whole_characters)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("kept").alias("_kept"), F.col("spans").alias("_spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the text cut; characters of which bytes are left over are dropped whole. Null stays null, and
    a text without repeats stays as it is. Columns may have any name and type."""
    found = _cut(docs, id_col, text_col, whole_characters=True)
    return found.select(*[(F.when(F.size("spans") == 0, F.col(f"c{k}")).otherwise(F.col("kept").cast("string")) if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)])
