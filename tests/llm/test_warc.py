import base64
import gzip
import hashlib
import io
import zlib
from pathlib import Path

import pytest
from fixtures_llm import FOLDER, given, have_given

from terrastat.llm import warc
from terrastat.llm.warc import archive_report, read_records, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, payload string, key string, head struct<a:int>"
LONG = "".join(f"<p>{i} é漢</p>\r\n\r\n" for i in range(200_000))


def awkward():
    rows = [
        (5, "http://a/1", "<p>x</p>"),
        (2, "http://a/2", "<p>x</p>"),
        (2, "http://a/2", "<p>x</p>"),
        (9, None, "<p>x</p>"),
        (None, "http://a b\r\nX: y", "<p>x</p>"),
        (1, "u", None),
        (3, "u", ""),
        (None, None, None),
        (None, "u", "only a missing id"),
        (None, "u", "only a missing id"),
        (7, "http://ü/漢", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
        (8, "l", LONG),
        (10, "l", LONG),
        (4, "z", "\x1f\x8b \x00 nul"),
    ]
    return [(*r, "p", "k", (1,)) for r in rows]


def plain(rows, least=0):
    by = {}
    for i, (page, url, html, *_) in enumerate(rows):
        data = (html or "").encode()
        by.setdefault(data, []).append((page is None, page or 0, url is None, url or "", i, page))
    out = []
    for data, own in by.items():
        own.sort()
        for j, o in enumerate(own):
            first = j == 0 or len(data) < least
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            out.append((o[5], len(data), digest, "response" if first else "revisit", None if first else own[0][5]))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_awkward_pages_come_back(spark, least):
    rows = awkward()
    assert found(archive_report(spark.createDataFrame(rows, SCHEMA), least)) == plain(rows, least)


def test_empty_table(spark):
    assert found(archive_report(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.skipif(not have_given(), reason="no tables")
def test_given_pages(spark):
    rows = [tuple(r) for r in given(spark, "pages").select("page_id", "url", "html").collect()]
    assert FOLDER and found(archive_report(given(spark, "pages"))) == plain(rows)


def test_a_payload_held_by_a_third_of_the_pages(spark):
    rows = [(i, "u", "same" if i % 3 == 0 else f"p{i}", None, None, None) for i in range(3000)]
    assert found(archive_report(spark.createDataFrame(rows, SCHEMA).repartition(7))) == plain(rows)


def test_archives_unpack_with_gzip_and_hold_payloads(spark, tmp_path):
    rows = awkward()
    write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    text = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    assert text.count(b"WARC-Type: response") + text.count(b"WARC-Type: revisit") == len(rows)
    back = read_warc(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload).decode() for r in back) == sorted({r[2] or "" for r in rows})
    assert all(r.offset >= 0 and r.record_id.startswith("<urn:page:") for r in back)


def member(*, length=None, digest=None, body=b"hello", end=b"\r\n\r\n", extra=b""):
    block = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n" + body
    digest = digest or base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
    return gzip.compress(head.encode() + block + end + extra, mtime=0)


def test_reader_takes_foreign_archives_and_reads_in_small_steps(monkeypatch):
    info = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    data = info + member() + warc.NOTHING + member(body=b"x" * 300_000)
    for step in (1 << 16, 7):
        monkeypatch.setattr(warc, "READ", step)
        got = list(read_records(data if step > 7 else info + member()))
        assert [r.size for r in got] == ([3, 5, 300_000] if step > 7 else [3, 5])
        assert got[0].headers["warc-type"] == "warcinfo" and got[1].payload == b"hello"


@pytest.mark.parametrize(
    "data, why",
    [
        (member(digest="A" * 32), "digest"),
        (member(length=500), "shorter"),
        (member(length=10), "does not end"),
        (member(extra=b"more"), "more than one"),
        (member()[:-9], "ends inside"),
        (member()[:40] + b"\x00\xff" + member()[42:], "member|digest|record"),
        (gzip.compress(b"<html>"), "no end"),
        (gzip.compress(b"<html>\r\n\r\n"), "no record"),
    ],
)
def test_damaged_archives_are_errors(data, why):
    with pytest.raises((ValueError, zlib.error), match=why):
        list(read_records(data))


def test_the_separator_is_an_empty_member():
    assert gzip.decompress(warc.NOTHING) == b"" and gzip.GzipFile(fileobj=io.BytesIO(member() + warc.NOTHING)).read().endswith(b"hello\r\n\r\n")
    assert Path(warc.__file__).exists()
