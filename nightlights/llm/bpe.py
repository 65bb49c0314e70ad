"""Byte-level BPE through a sentencepiece model that is serialised here, straight from a vocabulary of ranks."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightlights.llm import textscan as ts
from nightlights.llm.tables import quoted

#: Distinct pre-tokens whose ids a worker remembers; beyond it the memory is emptied. Results don't depend on it.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


def read_ranks(lines) -> list[bytes]:
    """Token bytes by rank from lines of base64 and rank."""
    ranks = {int(n): base64.b64decode(token) for token, n in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _field(number, 2, _varint(len(body)) + body)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece k is token k in byte characters with score -k, so that the best-scored merge is
    the one of least rank; identity normalisation, no dummy prefix, white space untouched. The unknown piece comes last."""
    chars = byte_characters()
    pieces = [_message(1, _message(1, "".join(chars[b] for b in token).encode()) + _field(2, 5, struct.pack("<f", -float(k)))) for k, token in enumerate(tokens)]
    pieces.append(_message(1, _message(1, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2))))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(tokens) + 1)) + _field(24, 0, _varint(0)) + _field(40, 0, _varint(len(tokens))) + b"".join(_field(n, 0, b"\xff" * 9 + b"\x01") for n in (41, 42, 43))
    normalizer = _message(1, b"identity") + b"".join(_field(n, 0, b"\x00") for n in (3, 4, 5))
    return b"".join(pieces) + _message(2, trainer) + _message(3, normalizer)


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens, self.find = tokens, regex.compile(pattern).findall
        self.chars = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; each match of the pattern is encoded by itself."""
        parts, known = self.find(text), self.known
        new = [x for x in set(parts) if x not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known = self.known = {x: known[x] for x in set(parts) if x in known}
            mapped = [x.encode().decode("latin-1").translate(self.chars) for x in new]
            for x, ids in zip(new, self.model.encode(mapped, num_threads=1), strict=True):
                known[x] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(2)
def codec(tokens_file: str, pattern: str) -> Codec:
    with open(tokens_file, "rb") as f:
        return Codec(read_ranks(f), pattern)


def share_vocabulary(spark: SparkSession, vocabulary: str) -> str:
    """Sends a vocabulary file (size fixed by the tokenizer) to all executors; its name there."""
    spark.sparkContext.addFile(vocabulary)
    return vocabulary.rpartition("/")[2]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary, n_tokens, ids_sha256, decoded_sha256) for each row, whole texts.

    Null and empty texts have no ids. ids_sha256 is of the ids as little-endian unsigned 32-bit integers. Rows keep
    their ids, null or repeated; other columns aren't read. No shuffle.
    """
    return _encode(docs, vocabulary, pattern, id_col, text_col, True)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode without the ids and bytes themselves."""
    return _encode(docs, vocabulary, pattern, id_col, text_col, False)


def _encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, full: bool) -> DataFrame:
    name = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name), pattern)
        for rows, data in ts.blocks(batches, limit=1 << 22):
            ids = [own.ids(x.decode("utf-8", "surrogatepass")) for x in data]
            back = [own.decode(x) for x in ids]
            out = {"id": rows.column("id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]}
            if full:
                out |= {"ids": pa.array([memoryview(x).cast("I").tolist() for x in ids], pa.list_(pa.int32())), "decoded": pa.array(back, pa.binary())}
            yield ts.record(**out)

    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    more = ", ids array<int>, decoded binary" if full else ""
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("id", id_col)
