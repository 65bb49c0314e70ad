"""ARC files as they are found: cut, malformed, of other types than text, and with other dates."""

from __future__ import annotations

import gzip
import io

import pytest
from nightlights.llm import warc

GIF = b"GIF89a\x01\x00\x01\x00\x80\xff\xfe\x00\x00;" + bytes(range(256))


def line(url="http://a/", date="20010203040506", mime="text/html", length=0, version=1):
    values = {"url": url, "ip": "1.2.3.4", "date": date, "mime": mime, "length": length}
    return (" ".join(str(values.get(x, "-")) for x in warc.ARC_FIELDS[version]) + "\n").encode()


def archive(*records, version=1):
    """records: bytes as they stand, or (block, fields of the line)."""
    head = warc.arc_file([], version)
    return head + b"".join(r if isinstance(r, bytes) else b"\n" + line(length=len(r[0]), version=version, **r[1]) + r[0] for r in records)


def converted(spark, tmp_path, files):
    (tmp_path / "in").mkdir()
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    problems = {(r.row.rpartition("/")[2], r.problem) for r in warc.convert_arcs(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    return problems, {r.url: r for r in warc.check_revisits(warc.read_archives(spark, str(tmp_path / "out"))).collect()}


def test_types_and_bytes(spark, tmp_path):
    http = warc.http_block(GIF, "image/gif")
    records = [(http, {"url": "http://a/x.gif", "mime": "image/gif"}), (b"20010203040506\na.example 10 IN A 1.2.3.4\n", {"url": "dns:a.example", "mime": "text/dns"}), (GIF, {"url": "ftp://a/y.gif", "mime": "image/gif"})]
    records += [(b"x", {"url": "http://a/no", "mime": "-"}), (b"y", {"url": "http://a/odd", "mime": "no-type"}), (GIF, {"url": "ftp://b/y.gif", "mime": "image/gif"}), (http, {"url": "http://a/again", "mime": "image/gif"}), (b"", {"url": "http://a/b c d", "date": "200102030405"})]
    problems, got = converted(spark, tmp_path, {"a.arc": archive(*records), "b.arc.gz": gzip.compress(archive((b"zip", {"url": "ftp://z"}), version=2))})
    assert not problems and all(r.sound for r in got.values())
    assert {k: r.type for k, r in got.items()} == {
        "http://a/x.gif": "response", "dns:a.example": "resource", "ftp://a/y.gif": "revisit", "http://a/no": "resource", "http://a/odd": "resource", "ftp://b/y.gif": "revisit", "http://a/again": "revisit", "http://a/b%20c%20d": "resource", "ftp://z": "resource",
    }
    assert got["http://a/x.gif"].block == http and got["ftp://b/y.gif"].payload_bytes == len(GIF) and got["ftp://b/y.gif"].refers_to == got["http://a/x.gif"].row
    assert got["http://a/b%20c%20d"].date == "2001-02-03T04:05:00Z"
    raw = [p.read_bytes() for p in (tmp_path / "out").glob("part-*")]
    types = {f["WARC-Target-URI"]: f["Content-Type"] for x in raw for f, _ in warc.warc_records(io.BytesIO(gzip.decompress(x)))}
    assert types["dns:a.example"] == "text/dns" and types["ftp://a/y.gif"] == "image/gif" and types["http://a/no"] == "application/octet-stream" and types["http://a/x.gif"].startswith("application/http")


def test_each_record_is_a_gzip_member(spark, tmp_path):
    converted(spark, tmp_path, {"a.arc": archive(*[(bytes([k]) * k, {"url": f"x:{k}"}) for k in range(1, 9)])})
    members = 0
    for p in (tmp_path / "out").glob("part-*"):
        rest = p.read_bytes()
        while rest:
            stream = warc.zlib.decompressobj(31)
            whole = stream.decompress(rest)
            assert stream.eof and (not whole or len(list(warc.warc_records(io.BytesIO(whole)))) == 1)
            members, rest = members + bool(whole), stream.unused_data
    assert members == 8


def test_bad_records_beside_good_ones(spark, tmp_path):
    good = lambda k: (b"good%d" % k, {"url": f"http://good/{k}"})
    cut = archive(good(1), good(2))
    files = {
        "cut.arc": cut[:-3],
        "line.arc": archive(good(3), b"\nnot a header\nnor this 1 2\n", good(4)),
        "length.arc": archive(good(5), b"\n" + line("http://bad/", length="12x") + b"body\n", good(6)),
        "short.arc": archive(b"\n" + line("http://short/", length=2) + b"longer than two", good(7)),
        "date.arc": archive((b"x", {"url": "http://bad/date", "date": "20011303040506"}), (b"x", {"url": "http://bad/date2", "date": "2001"}), good(8)),
        "foreign.arc": b"\x00\x01\x02 no archive at all",
        "empty.arc": b"",
        "cut.gz": gzip.compress(archive(good(9)))[:-9],
        "after.gz": gzip.compress(archive(good(10))) + b"more",
    }
    problems, got = converted(spark, tmp_path, files)
    assert set(got) == {f"http://good/{k}" for k in (1, 3, 4, 5, 6, 7, 8, 10)} | ({"http://good/9"} & set(got)) and all(r.sound and r.type == "resource" for r in got.values())
    told = {(name.split("#")[0], text.split(":")[0]) for name, text in problems}
    assert told >= {("cut.arc", "cut"), ("line.arc", "no header line of version 1"), ("length.arc", "no header line of version 1"), ("short.arc", "more than 2 bytes"), ("date.arc", "no date"), ("foreign.arc", "no version block"), ("cut.gz", "gzip"), ("after.gz", "gzip")}
    assert not any(name.startswith("empty") for name, _ in problems) and len([1 for name, _ in problems if name.startswith("date")]) == 2


@pytest.mark.parametrize("digits, want", [("20010203040506", "2001-02-03T04:05:06Z"), ("200102030405", "2001-02-03T04:05:00Z"), ("20010203", None), ("20010230000000", None), ("", None), ("2001020304050x", None), ("00010101000000", "0001-01-01T00:00:00Z")])
def test_dates(digits, want):
    assert warc.arc_date(digits) == want


def test_a_long_record(spark, tmp_path):
    long = warc.http_block(b"\xff\x00" * 3_000_000)
    problems, got = converted(spark, tmp_path, {"a.arc": archive((long, {"url": "http://long/"}), (b"s", {"url": "http://short/"}))})
    assert not problems and got["http://long/"].payload_bytes == 6_000_000 and got["http://long/"].sound
