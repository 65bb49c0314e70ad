"""Legacy web archives: ARC records of both versions, their conversion to WARC, and WARC files that Spark writes and reads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightlights.llm import textscan as ts
from nightlights.llm.tables import quoted
from nightlights.runtime import materialize

#: Fields of an ARC record's header line by the version that the archive's first record declares.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "row string, type string, record_id string, refers_to string, url string, date string, payload_digest string, payload_bytes long, sound boolean, block binary"
#: Payloads from LARGE bytes on go to files of their own. A file holds about FILE_BYTES, counting small ones as LARGE and large
#: ones as 128 MiB.
LARGE = 1 << 16
FILE_BYTES = 1 << 30


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_block(payload: bytes, mime: str = "text/html; charset=UTF-8") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its blank line, body); without a blank line all is body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head + gap, body) if gap else (b"", block)


def arc_file(records: list[tuple[str | None, bytes]], version: int, date: str = "20000101000000", name: str = "pages.arc") -> bytes:
    """An archive of records (url, block): the version block, then each record after that version's header line."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 nightlights\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'mime': 'Content-type', 'status': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'file': 'Filename', 'length': 'Archive-length'}[x] for x in fields)}\n\n".encode()

    def line(**values) -> bytes:
        return (" ".join(str(values.get(x, "-")) for x in fields) + "\n").encode()

    out = [line(url=f"filedesc://{name}", ip="0.0.0.0", date=date, mime="text/plain", status=200, offset=0, file=name, length=len(about)) + about]
    at = len(out[0])
    for url, block in records:
        clean = "".join(f"%{b:02X}" if b <= 0x20 else chr(b) for b in (url or "").encode("utf-8", "surrogatepass")).encode("latin-1").decode("utf-8", "replace") or "-"
        out.append(b"\n" + line(url=clean, ip="0.0.0.0", date=date, mime="text/html", status=200, offset=at + 1, file=name, length=len(block)) + block)
        at += len(out[-1])
    return b"".join(out) + b"\n"


def arc_line(line: bytes, version: int) -> dict | None:
    """The fields of a version's header line by name, or None if it isn't one. Only the URL may hold spaces."""
    fields = ARC_FIELDS[version]
    parts = line.rstrip(b"\r").decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
    return dict(zip(fields, parts, strict=True)) if len(parts) == len(fields) and parts[0] and re.fullmatch("[0-9]{1,18}", parts[-1]) else None


def arc_records(content: bytes) -> Iterator[dict]:
    """What follows the version block of an ARC file: each record's fields by name, block and problem, which is None if it is whole.

    The version block says which header line follows; lengths are taken as declared. A block that the file's end cuts and a line
    that isn't a header line are records with a problem; after such a line the next one that names a scheme and a date goes
    on. A file without a version block is one such record. Blank lines between records are skipped.
    """
    at, version, lost = 0, 0, False
    while at < len(content):
        stop = content.find(b"\n", at)
        stop = len(content) if stop < 0 else stop
        line, after = content[at:stop], stop + 1
        if not line.strip(b"\r"):
            at = after
            continue
        if not version:
            length = line.split(b" ")[-1].rstrip(b"\r")
            body = content[after : after + int(length)] if re.fullmatch(b"[0-9]{1,18}", length) else b""
            found = re.match(b"([0-9]+) ", body)
            if not found or int(found[1]) not in ARC_FIELDS:
                yield {"problem": f"no version block: {line[:80].decode('utf-8', 'replace')}"}
                return
            version, at = int(found[1]), after + int(length)
            continue
        record = arc_line(line, version)
        if record is None or lost and not (re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", record["url"]) and arc_date(record["date"])):
            if not lost:
                yield {"problem": f"no header line of version {version}: {line[:80].decode('utf-8', 'replace')}"}
            at, lost = after, True
            continue
        block = content[after : after + int(record["length"])]
        at, lost, problem = after + int(record["length"]), False, None
        if len(block) < int(record["length"]):
            problem = f"cut: {len(block)} of {record['length']} bytes"
        elif not arc_date(record["date"]):
            problem = f"no date: {record['date'][:80]}"
        elif content[at : at + 1].strip(b"\r\n"):
            problem = f"more than {record['length']} bytes"
        yield record | {"block": block, "problem": problem}


def arc_date(digits: str) -> str | None:
    """A date of 14 digits, or of 12 without seconds, as WARC writes it; None if it isn't a time."""
    if not re.fullmatch("[0-9]{12}([0-9]{2})?", digits):
        return None
    try:
        return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return None


def kind_of(url: str, mime: str, block: bytes) -> tuple[str, str]:
    """(WARC type, content type) of an ARC record: what a server answered by HTTP is a response, all else is a resource of the
    ARC's own type; names looked up have theirs, and '-' or 'no-type' says nothing."""
    if url.startswith("dns:"):
        return "resource", "text/dns"
    if block.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return "resource", mime if re.fullmatch(r"[\w!#$&^.+-]+/[\w!#$&^.+-]+(;.*)?", mime or "") else "application/octet-stream"


def warc_record(arc: dict, row: str, first: str | None) -> bytes:
    """The WARC record that equals an ARC record, with the two line ends that close it; first: the row of the record that it
    revisits. Identifiers are name-based, so a task that runs again writes the same; blocks are taken byte for byte."""
    kind, content = kind_of(arc["url"], arc.get("mime", ""), arc["block"])
    head, body = split_http(arc["block"]) if kind == "response" else (b"", arc["block"])
    name = lambda r: uuid.uuid5(uuid.NAMESPACE_OID, f"warc/{r}")
    fields = {
        "WARC-Type": kind if first is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{name(row)}>",
        "WARC-Date": arc_date(arc["date"]),
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", arc["url"]),
        "WARC-IP-Address": arc["ip"],
        "WARC-Payload-Digest": f"sha1:{digest(body)}",
        "Content-Type": content,
        "Source-Row": row,
    }
    if first is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:uuid:{name(first)}>", "Refers-To-Row": first, "Payload-Length": str(len(body))}
    block = arc["block"] if first is None else head
    fields["Content-Length"] = str(len(block))
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in fields.items() if v), b"\r\n", block, b"\r\n\r\n"])


def member(record: bytes) -> bytes:
    """A gzip member of its own, the same each time."""
    return gzip.compress(record, mtime=0)


def unpacked(content: bytes) -> tuple[bytes, str | None]:
    """(what can be read of a file that may be gzipped, what is wrong with the rest): members one after the other."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    out, at = [], 0
    while content[at : at + 2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        while at < len(content) and not stream.eof:
            piece = content[at : at + (1 << 16)]
            try:
                out.append(stream.decompress(piece))
            except zlib.error as e:
                return b"".join(out), f"gzip: {e}"
            at += len(piece)
        if not stream.eof:
            return b"".join(out), "gzip: cut"
        at -= len(stream.unused_data)
    return b"".join(out), "gzip: other bytes follow" if content[at:].strip(b"\0") else None


def warc_records(stream) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of each record of a binary stream, by declared lengths; a cut block is as long as what is there.
    Anything but a record where one must begin raises ValueError."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(": ")
            fields[k] = v
        yield fields, stream.read(int(fields["Content-Length"]))


def first_of_equal_payloads(pages: DataFrame, id_col: str, payload: Column, min_bytes: int = 0) -> DataFrame:
    """pages with first: the smallest id of the rows with the same payload where there is one and it is another row's,
    null for responses. Payload digests are counted before anything is moved; only digests with several rows are joined,
    from a written table, so that Spark broadcasts it only if it is small and splits a digest that many rows share."""
    sha = F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload))
    several = materialize(pages.select(sha.alias("_sha"), F.col(id_col).alias("_id")).where("_sha IS NOT NULL").groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "payloads")
    return pages.withColumn("_sha", sha).join(several, "_sha", "left").withColumn("first", F.when(~F.col(id_col).eqNullSafe(F.col("_first")), F.col("_first"))).drop("_sha", "_first")


def _write(ready: DataFrame, size: Column, run, path: str) -> None:
    """Gzip members that run makes of ready, one a record, to files of bounded bytes: rows from LARGE bytes on go to files of few records.

    Spark's text writer, which commits each task's files once, puts any bytes of a string down as they are, and after each what it is
    told to: an empty member, so that a file is nothing but gzip members.
    """
    parts = [(size < LARGE, FILE_BYTES // LARGE, "error")]
    if (ready.agg(F.max(size)).first()[0] or 0) >= LARGE:
        parts.append((size >= LARGE, FILE_BYTES >> 27, "append"))
    for chosen, records, mode in parts:
        rows = ready.where(chosen).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
        rows.write.mode(mode).option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).option("maxRecordsPerFile", records).text(path)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Rows become ARC archives (version 1 or 2 by their URLs' checksum), a block of rows at a time; these are parsed, converted
    and written to gzipped WARC files under path by Spark's own committed writer.

    Null payloads are empty, null URLs '-'. Of rows with equal payloads of min_bytes or more, those of the smallest id
    are responses and the others revisits of it; null ids are larger than all others. Other columns aren't read.
    """
    rows = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).cast("string").alias("url"), F.coalesce(F.col(quoted(payload_col)).cast("string"), F.lit("")).alias("payload"))
    marked = first_of_equal_payloads(rows, "id", F.col("payload"), min_bytes)
    ready = marked.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("row"), "url", "payload", F.col("first").cast("string").alias("first"), (F.crc32(F.coalesce("url", F.lit(""))) % 2 + 1).cast("int").alias("version"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in ts.blocks(batches, "payload"):
            row, url, first, version = (rows.column(c).to_pylist() for c in ("row", "url", "first", "version"))
            out = []
            for v in ARC_FIELDS:
                own = [k for k in range(len(data)) if version[k] == v]
                if own:
                    archive = arc_file([(url[k], http_block(data[k])) for k in own], v)
                    out += [member(warc_record(arc, row[k], first[k])) for arc, k in zip(arc_records(archive), own, strict=True)]
            yield ts.record(value=pa.array(out, pa.binary()))

    _write(ready, F.octet_length("payload"), run, path)


_ARC_ROWS = pa.schema([("row", pa.string()), *((c, pa.string()) for c in ("url", "ip", "date", "mime")), ("block", pa.binary()), ("digest", pa.string()), ("size", pa.int64()), ("problem", pa.string())])


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """(row, url, ip, date, mime, block, the payload's digest and size, problem) of each record of the ARC files under path, of
    either version, plain or gzipped (one member or one a record); row is the file's path and the record's number.

    What isn't a whole record is a row with a problem, and the records before it, and after it where they can be found, are
    read all the same. A null or foreign mime is no problem. A file is held whole in its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                text, wrong = unpacked(content.as_py())
                out, size, k = [], 0, -1
                for k, r in enumerate(arc_records(text)):
                    known = {"row": f"{name}#{k}"} | {c: r.get(c) for c in ("url", "ip", "date", "mime", "block", "problem")}
                    if r["problem"] is None:
                        body = split_http(r["block"])[1] if kind_of(r["url"], r["mime"], r["block"])[0] == "response" else r["block"]
                        known |= {"digest": digest(body), "size": len(body)}
                    out.append(known)
                    size += len(r.get("block", b""))
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, _ARC_ROWS)
                        out, size = [], 0
                if wrong:
                    out.append({"row": f"{name}#{k + 1}", "problem": wrong})
                yield pa.RecordBatch.from_pylist(out, _ARC_ROWS)

    schema = "row string, url string, ip string, date string, mime string, block binary, digest string, size long, problem string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def convert_arcs(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> DataFrame:
    """ARC files to WARC files: of records with equal payloads of min_bytes or more that of the smallest row is a response or
    resource, others revisit it. Returns (row, url, problem) of what couldn't be converted; one bad record or file ends nothing."""
    known = materialize(read_arcs(spark, arc_path), "arcs")
    whole = known.where("problem IS NULL")
    several = materialize(whole.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("row").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    ready = whole.join(several, "digest", "left").withColumn("first", F.when((F.col("size") >= min_bytes) & (F.col("least") != F.col("row")), F.col("least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            yield ts.record(value=pa.array([member(warc_record(r, r["row"], r["first"])) for r in batch.to_pylist()], pa.binary()))

    _write(ready.select("row", "url", "ip", "date", "mime", "block", "first"), F.octet_length("block"), run, warc_path)
    return known.where("problem IS NOT NULL").select("row", "url", "problem")


def _described(f: dict, block: bytes, with_block: bool) -> dict:
    """A record's row of READ_SCHEMA."""
    kind, head, body = f.get("WARC-Type"), b"", block
    if f.get("Content-Type", "").startswith("application/http"):
        head, body = split_http(block)
    declared = head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0]
    given = f.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    n, sha, sound = len(body), digest(body), None
    if kind == "revisit":  # its payload is the response's
        bytes_ = f.get("Payload-Length", declared.decode("latin-1"))
        n, sha = int(bytes_) if re.fullmatch("[0-9]+", bytes_) else None, given
    else:
        sound = len(block) == int(f["Content-Length"]) and given in (None, sha) and (not declared.isdigit() or int(declared) == n)
    return {"row": f.get("Source-Row") or None, "type": kind, "record_id": f.get("WARC-Record-ID"), "refers_to": f.get("Refers-To-Row"), "url": f.get("WARC-Target-URI"), "date": f.get("WARC-Date"), "payload_digest": sha, "payload_bytes": n, "sound": sound, "block": block if with_block else None}


def read_archives(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """READ_SCHEMA's columns of each record of the WARC files under path; block is null unless with_block.

    payload_digest and payload_bytes are measured on the block; a revisit's are those that it declares of the response's
    payload, until check_revisits compares them. sound: length, digest and HTTP length are as declared; null for revisits.
    Files are gzipped or plain. Records of other writers have no row. What can't be read any further, a cut or foreign file, is one record of type unreadable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("sound", pa.bool_()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                out, size = [], 0
                raw = io.BytesIO(content.as_py())
                records = warc_records(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw)
                while True:
                    try:
                        f, block = next(records)
                        out.append(_described(f, block, with_block))
                    except StopIteration:
                        break
                    except (EOFError, OSError, ValueError, KeyError, zlib.error):
                        out.append({"type": "unreadable", "sound": False})
                        break
                    size += len(block) if with_block else 100
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, READ_SCHEMA)


def check_revisits(records: DataFrame) -> DataFrame:
    """records of read_archives with sound filled in for revisits: a sound response of the row that they refer to has the digest
    and the bytes that they declare. Equal declarations are compared once, so very many revisits of one response don't meet it."""
    records = materialize(records, "records")
    keys = ["refers_to", "payload_digest", "payload_bytes"]
    declared = records.where("type = 'revisit'").groupBy(*keys).agg(F.count("*").alias("n"))
    given = records.where("type IN ('response', 'resource') AND sound").select(F.col("row").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
    same = F.max((F.col("d").eqNullSafe(F.col("payload_digest")) & F.col("b").eqNullSafe(F.col("payload_bytes"))).cast("int"))
    wrong = declared.join(given, "refers_to", "left").groupBy(*keys).agg(same.alias("same")).where("same = 0").select(*[F.col(k).alias(f"w_{k}") for k in keys], F.lit(True).alias("wrong"))
    wrong = materialize(wrong, "wrong")
    on = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys]
    out = records.join(wrong, on[0] & on[1] & on[2], "left")
    return out.withColumn("sound", F.when(F.col("type") == "revisit", F.col("wrong").isNull()).otherwise(F.col("sound"))).select(*records.columns)
