"""Each numbered operator against brute force on texts with nulls, ties, repeats, long and empty ones, and odd columns."""

from __future__ import annotations

import base64
import gzip
import io
import random

import numpy as np
import plain
import pytest
from nightlights.llm import bpe, chat, debruijn, decontaminate, langid, quality, queries, simhash, suffix, toxicity, warc
from pyspark.sql import functions as F

RNG = random.Random(11)
WORDS = ["the", "of", "Ähre", "zu", "ein", "ration", "blé", "est", "and", "this", "quelle", "x", "日本", "ton", "ba"]


def prose(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "", ".", ","]) for _ in range(n))


def corpus():
    base = prose(400)
    shared = prose(80)
    words = base.split()
    docs = [(5, base), (9, base), (2, prose(30) + " " + shared + " " + prose(20)), (3, shared + "\n" + prose(60)), (7, prose(10) + "  " + shared)]
    docs += [(20 + k, " ".join(words[:k * 17] + ["changed"] + words[k * 17 + 1 :])) for k in range(8)]
    docs += [(40, ""), (41, None), (42, "   \n\t"), (43, "a"), (44, "a b"), (5, base), (5, prose(70)), (None, base), (None, shared), (60, "ab" * 400), (61, "zz " + "ab" * 300), (62, "😀" * 40 + "é" * 40), (63, "x" + "😀" * 40 + "é" * 40)]
    docs += [(100, prose(9000)), (101, "word " * 3000), (102, "word " * 200)]
    return docs


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "u") for i, t in rows], "doc_id long, text string, kept string, fp string, n_hit int, id string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_substrings(docs, rows, empty):
    out = debruijn.repeated_spans(docs)
    got = [(r.doc_id, r._n_words, sum(s.length for s in r._spans), plain.sha(r._kept.encode())) for r in out.collect()]
    same(got, plain.cut_words(rows))
    assert "kept" in out.columns and debruijn.repeated_spans(empty).count() == 0


def test_suffixes(docs, rows, empty):
    out = suffix.repeated_spans(docs)
    got = [(r.doc_id, len((r.text or "").encode()), sum(s.length for s in r._spans), len(r._spans), plain.sha(bytes(r._kept))) for r in out.collect()]
    same(got, plain.cut_bytes(rows))
    assert suffix.repeated_spans(empty).count() == 0


def test_hot_anchors_go_out_string_by_string(docs, rows, monkeypatch):
    """With every repeated anchor taken for a hot one the answer is the same."""
    from nightlights.llm.suffix import Block, compare, repeated_anchors
    import pyarrow as pa

    few = [(i, t) for i, t in rows if i != 100]
    table = pa.table({"doc_id": pa.array([i for i, _ in few], pa.int64()), "text": pa.array([t for _, t in few], pa.string())})
    block = Block(table, "doc_id", "text", 3)
    hot = {b: bytes(2 if x else 0 for x in repeated_anchors([blob])[0]) for b, blob in block.anchors()}
    block.candidates(hot)
    get = lambda r, c, kind: np.frombuffer(r[c], kind)
    masks = {r["bucket"]: compare(get(r, "room", np.uint8).reshape(-1, suffix.ROOM), get(r, "low", np.uint8), get(r, "high", np.uint8), get(r, "doc", np.int64)).tobytes() for r in block.surroundings()}
    dead = block.covered(masks)
    assert [d.sum() for d in dead] == [x[2] for x in plain.cut_bytes(few)]


def test_blocks_alone_make_no_anchor_hot():
    """A passage that each of very many blocks has once goes out as one surrounding a block, not string by string."""
    import pyarrow as pa

    block = suffix.Block(pa.table({"doc_id": pa.array([1], pa.int64()), "text": [prose(60)]}), "doc_id", "text", 1)
    ((_, blob),) = block.anchors()
    assert {x for answer in suffix.repeated_anchors([blob] * 600) for x in answer} == {1}


def test_different_surroundings_make_an_anchor_hot(monkeypatch):
    """They are counted in packs, and a passage alone in its document isn't taken for repeated, however many it makes."""
    import pyarrow as pa

    monkeypatch.setattr(suffix, "HOT", 3)
    around, same = np.random.default_rng(5).integers(97, 123, (8 * suffix.PACK, 2, 40)).astype(np.uint8), prose(60)[: suffix.LENGTH]
    texts = [a.tobytes().decode() + same + b.tobytes().decode() for a, b in around]
    block = suffix.Block(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), "doc_id", "text", 1)
    ((_, blob),) = block.anchors()
    assert 2 in suffix.repeated_anchors([blob])[0]
    monkeypatch.setattr(suffix, "HOT", 8)
    assert max(suffix.repeated_anchors([blob])[0]) == 1
    lone = suffix.Block(pa.table({"doc_id": pa.array([1], pa.int64()), "text": [" ".join(texts)]}), "doc_id", "text", 1)
    ((_, blob),) = lone.anchors()
    assert len(lone.keys) > len(set(lone.keys.tolist())) and not any(suffix.repeated_anchors([blob])[0])


def test_long_texts_go_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix, "_SEGMENT", 200)
    texts = [(1, prose(300)), (2, prose(50))]
    texts.append((3, texts[0][1][100:900] + texts[1][1]))
    block = suffix.Block(pa.table({"doc_id": pa.array([i for i, _ in texts], pa.int64()), "text": [t for _, t in texts]}), "doc_id", "text", 2)
    block.candidates({b: suffix.repeated_anchors([blob])[0] for b, blob in block.anchors()})
    masks = {r["bucket"]: suffix.compare(np.frombuffer(r["room"], np.uint8).reshape(-1, suffix.ROOM), np.frombuffer(r["low"], np.uint8), np.frombuffer(r["high"], np.uint8), np.frombuffer(r["doc"], np.int64)).tobytes() for r in block.surroundings()}
    assert [d.sum() for d in block.covered(masks)] == [x[2] for x in plain.cut_bytes(texts)]


def test_deep_shallow_order():
    rng = np.random.default_rng(0)
    rows = rng.integers(97, 100, (700, 50)).astype(np.uint8)
    rows[100:400, :45] = rows[0, :45]
    rows[400:450] = rows[3]
    order, lcp = suffix.deep_shallow(rows)
    strings = [rows[i].tobytes() for i in order]
    assert strings == sorted(strings) and sorted(order) == list(range(700))
    for k in range(1, 700):
        n = next((j for j in range(50) if strings[k][j] != strings[k - 1][j]), 50)
        assert lcp[k] == n


def test_cut_text_stays_text(spark):
    docs = spark.createDataFrame([(1, "é" * 60), (2, "x" + "é" * 60 + "y"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix.remove_repeats(docs).collect()}
    assert got == {1: "é" * 60, 2: "xy", 3: None}


def test_fingerprints_and_groups(docs, rows, empty):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()]
    f = [plain.fingerprint(t, 3) for _, t in rows]
    g = plain.groups(f)
    least = {k: min((i for (i, _), x in zip(rows, g, strict=True) if x == k and i is not None), default=None) for k in g}
    same(got, [(i, f"{x:016x}", least[k]) for (i, _), x, k in zip(rows, f, g, strict=True)])
    assert simhash.simhash_components(empty).count() == 0


def test_strings_keep_odd_columns(odd):
    out = suffix.repeated_spans(odd)
    assert out.columns == [*odd.columns, "_kept", "_spans"]
    got = {r._block: r for r in out.collect()}
    assert [len(got[k]._spans) for k in (7, 8, 9, 1)] == [0, 1, 0, 0] and (got[7]["a.b"], got[7].m, got[9].m) == ("p", {"a": 1}, {})
    left = {r._block: r for r in suffix.remove_repeats(odd).collect()}
    assert left[8].text == "x " and left[1].text is None and left[1].m == {"b": None} and suffix.remove_repeats(odd).schema == odd.schema
    assert suffix.remove_repeats(odd.where("false")).count() == 0


def test_contamination_keeps_odd_columns(spark, odd):
    item = odd.where("doc_id = 1").selectExpr("'i' AS item_id", "text", "1 AS `x.y`")
    left = decontaminate.drop_contaminated(odd, item)
    assert left.schema == odd.schema and [(r["a.b"], r.m) for r in left.collect()] == [("r", {"b": None})]
    assert {r.doc_id for r in decontaminate.contamination(odd, item).where("n_hit > 0").collect()} == {1, 2, None}


def test_blocks_of_items_keep_to_their_bound(spark, monkeypatch):
    """Very many copies of one item are one; blocks are halved until they fit."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = [("same", "a b c d e f g")] * 3000 + [(f"i{k}", f"word{k} " * 10) for k in range(20)] + [("long", "z " * 500), (None, None)]
    blocks = list(decontaminate._blocks_of_items(spark.createDataFrame(items, "item_id string, text string"), "item_id", "text"))
    assert sorted(k for b in blocks for k, _ in b) == sorted({k or "null" for k, _ in items})
    assert all(len(b) == 1 or sum(len(k) + len(t) for k, t in b) <= 200 for b in blocks) and len(blocks) > 5
    assert list(decontaminate._blocks_of_items(spark.createDataFrame([], "item_id string, text string"), "item_id", "text")) == [[]]


def test_one_of_each_group_stays(docs, rows):
    """Null ids come last; repeated rows and rows without words leave one."""
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    numbered = [((i is None, i or 0), t) for i, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == plain.kept_by_jaccard(numbered)


@pytest.fixture(scope="module")
def odd(spark):
    """Columns with dots, maps and names that operators might use themselves."""
    text = prose(90)
    rows = [(1, text, "p", {"a": 1}, 7, "b"), (2, "x " + text, "q", None, 8, "c"), (None, text, None, {}, 9, "d"), (3, None, "r", {"b": None}, 1, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, m map<string,int>, _block int, parts string")


def test_substrings_keep_odd_columns(odd):
    out = debruijn.repeated_spans(odd)
    assert out.columns == [*odd.columns, "_n_words", "_kept", "_spans"]
    got = {r._block: r for r in out.collect()}
    assert [sum(s.length for s in got[k]._spans) for k in (7, 8, 9, 1)] == [0, 90, 0, 0] and got[8]._kept == "x"
    assert (got[7]["a.b"], got[7].m, got[8].m, got[1].m, got[8].parts) == ("p", {"a": 1}, None, {"b": None}, "c")


def test_large_groups_go_by_tiles(spark, monkeypatch):
    """Fingerprints that agree in most bits, far more than a tile holds."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    values = {0, centre}
    while len(values) < 400:
        x = centre
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values = sorted(values)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    found = {r.fp: r.grp for r in simhash.fingerprint_groups(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    g = plain.groups(values)
    sets = {}
    for x, k in zip(signed, g, strict=True):
        sets.setdefault(k, []).append(x)
    for members in sets.values():
        assert {found.get(x, x) for x in members} == {min(members)}


def test_decontamination(spark, docs, rows, empty):
    shared = rows[2][1].split()
    items = [(1, " ".join(shared[40:70])), (12, "Ähre zu"), (2, None), (None, " ".join(shared[60:75])), (1, " ".join(shared[40:70])), (4, "..."), (5, "never seen anywhere at all in this or that")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect()]
    want = plain.contamination(rows, items)
    same(got, want)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[2] for x in want)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_decontamination_in_blocks(spark, docs, rows, monkeypatch):
    items = [(k, " ".join(rows[2][1].split()[k : k + 14])) for k in range(0, 60, 7)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()]
    same(got, plain.contamination(rows, items))


def test_bpe(docs, rows, empty):
    import public_tokenizers

    vocabulary, pattern = queries.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    got = [(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.encode(docs, vocabulary, pattern).collect()]
    ids = [(i, plain.bpe(t, ranks, pattern), (t or "").encode()) for i, t in rows]
    same(got, [(i, plain.sha(x), plain.sha(t), len(x) // 4) for i, x, t in ids])
    assert bpe.encode_digests(empty, vocabulary, pattern).count() == 0


def test_bpe_odd_texts():
    import public_tokenizers

    vocabulary, pattern = queries.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = bpe.Codec(bpe.read_ranks(open(vocabulary, "rb")), pattern)
    for t in ["", " ", "  ", " \n x", "it's 'll\t\tz \r\n", "\x00\x01\x7f", "<|endoftext|>", "a  b", "١٢ ² ½", "x" * 300, "日本 語　", "s\x85 t"]:
        assert own.ids(t) == plain.bpe(t, ranks, pattern) and own.decode(own.ids(t)) == t.encode()
    assert all(own.ids(x.decode()) and True for x in [b"abc"])


def test_quality(docs, rows, empty):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.repetition_coverage(docs).collect()}
    for i, t in rows:
        w = plain.SPACED.findall(t or "")
        r = got[i, len(w), sum(map(len, w))]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)} if len(w) < 1000 else None
        if again is not None:
            assert r.n_repeat_words == len(again)
            assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        lines = [x for x in (t or "").split("\n") if plain.SPACED.search(x)]
        assert r.n_dup_lines == len(lines) - len(set(lines)) and not (r.base_failed and r.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in quality.repetition_coverage(docs).collect())
    assert quality.repetition_coverage(empty).count() == 0


def test_arc_versions():
    for version in (1, 2):
        block = warc.http_block("<p>é</p>".encode())
        found = list(warc.arc_records(warc.arc_file([("http://x.example/a b", block), ("u", b""), (None, b"a\nb 1 2 3 4\n")], version)))
        assert [x["block"] for x in found] == [block, b"", b"a\nb 1 2 3 4\n"] and [x["url"] for x in found] == ["http://x.example/a%20b", "u", "-"]
    foreign = list(warc.arc_records(warc.arc_file([("u", b"x")], 1).replace(b"1 0 nightlights", b"9 0 nightlights")))
    assert len(foreign) == 1 and foreign[0]["problem"].startswith("no version block")


def test_arc_files_become_warc_files(spark, tmp_path):
    """Archives of several records, of both versions, plain and gzipped."""
    (tmp_path / "in").mkdir()
    blocks = [warc.http_block(x.encode()) for x in ("one", "two", "one", "é" * 300)]
    (tmp_path / "in" / "a.arc").write_bytes(warc.arc_file([("http://a/", blocks[0]), ("http://b/", blocks[1])], 1, "20010203040506"))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(warc.arc_file([("http://c/", blocks[2]), ("http://d/", blocks[3])], 2)))
    warc.convert_arcs(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.url: r for r in warc.check_revisits(warc.read_archives(spark, str(tmp_path / "out"))).collect()}
    assert {k: (r.type, r.payload_bytes, r.sound) for k, r in got.items()} == {"http://a/": ("response", 3, True), "http://b/": ("response", 3, True), "http://c/": ("revisit", 3, True), "http://d/": ("response", 600, True)}
    assert got["http://c/"].refers_to == got["http://a/"].row and got["http://a/"].date == "2001-02-03T04:05:06Z" and got["http://b/"].block == blocks[1]


def test_damaged_archives_are_noticed(spark, tmp_path):
    pages = [(1, "u1", "same text"), (2, "u2", "same text"), (3, "u3", "other text"), (4, "u4", "x" * 70_000)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) == 2  # the large payload has a file of its own
    (tmp_path / "bad").mkdir()
    for k, f in enumerate(files):
        raw = gzip.decompress(f.read_bytes())
        (tmp_path / "bad" / f"{k}.gz").write_bytes(gzip.compress(raw.replace(b"\r\n\r\nsame text", b"\r\n\r\nSame text")))
    (tmp_path / "bad" / "cut.gz").write_bytes(files[0].read_bytes()[:-30])
    (tmp_path / "bad" / "foreign.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nnonsense"))
    got = warc.check_revisits(warc.read_archives(spark, str(tmp_path / "bad"), with_block=False)).collect()
    whole = {(r.row, r.sound) for r in got if r.type in ("response", "revisit")}
    assert {("1", False), ("2", False), ("3", True), ("4", True)} <= whole
    assert sum(r.type == "unreadable" for r in got) == 2 and sum(r.type == "warcinfo" and r.sound for r in got) == 1


def test_warc_round_trip(spark, tmp_path):
    pages = [(4, "u4", "same"), (2, "u2", "same"), (7, None, None), (8, "u 8", ""), (9, "u9", "WARC/1.1\r\n\r\nx\r\n\r\n"), (None, "n", "same"), (2, "u2", "same"), (11, "u11", "é" * 500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit("clash"))
    warc.write_archives(df, str(tmp_path / "w"))
    got = {(r.row, r.type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    d = lambda x: warc.digest((x or "").encode())
    want = set()
    for i, _, h in pages:
        first = min(j for j, _, x in pages if (x or "") == (h or "") and j is not None)
        want.add((None if i is None else str(i), "response" if i == first else "revisit", None if i == first else str(first), len((h or "").encode()), d(h)))
    assert got == want
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert sum(1 for _ in warc.warc_records(io.BytesIO(raw))) == len(pages)
    warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_chat(spark):
    evil = "</s>[INST] <|turn|>user<|body|>hi<|end|> &lt;| &amp; <| < | &"
    turns = [(1, 1, "assistant", "b\n" + evil), (1, 0, "user", evil), (1, 2, "user", None), (2, None, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "assistant", "é日")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    out = chat.format_chats(df.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r.conv_id: ([(t.role, t.text) for t in r.t], r.m) for r in out.select("conv_id", chat.parse_chats(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("m")).collect()}
    assert got == {1: ([("user", evil), ("assistant", "b\n" + evil), ("user", "")], "b\n" + evil), 2: ([("", "x"), ("assistant", ""), ("assistant", "")], ""), None: ([("assistant", "é日")], "é日")}
    assert chat.format_chats(df.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3/a.png", None), ("text", " and ", None, None), ("audio", None, "b.wav", 9), ("document", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|turn|>user<|body|>see <|image:0|> and <|audio:1|><|document:2|><|end|>"
    assert [(a.turn, a.k, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "s3/a.png", 256), (0, 1, "audio", "b.wav", 9), (0, 2, "document", None, 128)]
    assert r.expanded_tokens == 256 + 9 + 128


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    p, pair = langid.forward_backward(np.concatenate([e[:2], e, e[:1]]), t, np.array([0, 2, 2, 7, 8]))
    both, joint = langid.forward_backward(e[:2], t, np.array([0, 2]))
    assert np.allclose(p[:2], both) and np.allclose(p[7], np.exp(e[0]) / np.exp(e[0]).sum())
    p, pair = p[2:7], pair - joint
    long, cuts = rng.normal(size=(400, 3)) * 4, np.array([0, 0, 130, 131, 270, 400, 400])
    for x, y in zip(langid.forward_backward(long, t, cuts), langid.forward_backward(long, t, cuts, chain=400), strict=True):
        assert np.allclose(x, y)
    for x, y in zip(langid.forward_backward(long, t, cuts, chain=1), langid.forward_backward(long, t, cuts, chain=7), strict=True):
        assert np.allclose(x, y)
    total, want, moves = 0.0, np.zeros((5, 3)), np.zeros((3, 3))
    for y in product(range(3), repeat=5):
        w = np.exp(sum(e[k, y[k]] for k in range(5)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        for k in range(5):
            want[k, y[k]] += w
        for a, b in zip(y, y[1:], strict=False):
            moves[a, b] += w
    assert np.allclose(p, want / total) and np.allclose(pair, moves / total)


def test_language(spark, empty):
    en, de = "the of and this that with", "der die und nicht ein zu für"
    rows = [(k, " ".join(RNG.choices((en if k % 2 else de).split(), k=30)), "en" if k % 2 else "de") for k in range(120)] + [(500, None, "en"), (501, "123 !!", "de"), (502, "", None), (None, "the of and", "en"), (503, "the of and this " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") for k in range(120))
    assert {got[k].lang_pred for k in (500, 501, 502)} == {"und"} and got[503].lang_pred == "en" and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty).count() == 0 and {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_learns_pairs(spark, empty):
    """Neither word alone is toxic; both together are."""
    rows = []
    for k in range(1200):
        a, b = k % 2, k // 2 % 2
        filler = RNG.choices(["one", "two", "three", "four", "five", "six"], k=8)
        rows.append((k, " ".join(filler + ["insult"] * a + ["group"] * b), a * b))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(9999, None), (9998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, quality int")
    machine = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    assert np.mean([got[k].predicted == y for k, _, y in rows]) > 0.97
    assert 0 <= got[9999].score <= 1 and got[9999].score == got[9998].score
    assert toxicity.score(empty, toxicity.learn(empty, labels.limit(0))).count() == 0
    twice = docs.union(docs).withColumn("a.b", F.lit(1))
    again = toxicity.learn(twice, labels.union(spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 4)], labels.schema)))
    assert toxicity.score(twice, again).count() == 2 * docs.count()
