"""WARC archives: pages written as records, one gzip member each, and a sequential reader that checks every digest."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastat.session import shared_folder

#: An empty gzip member. Spark's text writer needs a line end; this one adds nothing to the unpacked bytes.
NOTHING = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 65_536
GZIP = 16 + zlib.MAX_WBITS
MEMBERS = 256

RECORDS = (
    "archive string, offset long, record_id string, record_type string, target_uri string, page_id string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ------------------------------------------------------------------ writing


def _urn(page_id: object, digest: str, copy: int) -> str:
    """Record id that carries the page: ``v`` and the id, or ``n`` for a missing one."""
    return f"<urn:page:{'n' if page_id is None else 'v' + quote(str(page_id), safe='')}:{digest}:{copy}>"


def _page_of(urn: str) -> str | None:
    kind = urn.strip("<>").split(":")[2] if urn.startswith("<urn:page:") else "n"
    return unquote(kind[1:]) if kind[0] == "v" else None


def _uri(url: str | None) -> str:
    """A header value: blanks and control characters become escapes."""
    return "urn:none" if not url else "".join(quote(c) if c <= " " or c == "\x7f" or c in "\x85  " else c for c in url)


def record(
    page_id: object, url: str | None, payload: bytes | None, size: int, sha1: str, key: str, copy: int, head: object, head_url: str | None, revisit: bool, date: str
) -> bytes:
    """One record as a gzip member; a revisit keeps the response's head, not its payload."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, key, copy)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_uri(url)}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(head, key, 0)}", f"WARC-Refers-To-Target-URI: {_uri(head_url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _head(df: DataFrame, *more: str | Column) -> DataFrame:
    """Smallest page of each payload: ids before missing ids, equal ids by address."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("nowhere"), "url", *more)
    return df.groupBy("key").agg(F.min(place).alias("head"))


def _plans(pages: DataFrame, least_bytes: int) -> DataFrame:
    """One row per record to write. The html of a payload travels once per map task; revisits are made from ids and digests alone."""
    text = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text.alias("payload")).withColumn("size", F.length("payload").cast("long"))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("sha1", F.sha1("payload"))
    of_page = ["page_id", "url"]
    shared = rows if not least_bytes else rows.where(F.col("size") >= least_bytes)
    first = _head(shared, "size", "sha1", "payload").select(
        "key", *[F.col(f"head.{c}").alias(c) for c in (*of_page, "payload", "size", "sha1")], F.lit(0).cast("long").alias("copy"),
        F.col("head.page_id").alias("head_id"), F.col("head.url").alias("head_url"), F.lit(False).alias("revisit"),
    )
    heads = _head(shared.select("key", *of_page)).select(F.col("key").alias("of"), F.col("head.page_id").alias("head_id"), F.col("head.url").alias("head_url"))
    counts = shared.groupBy("key", *of_page, "size", "sha1").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("page_id").eqNullSafe(F.col("head_id")) & F.col("url").eqNullSafe(F.col("head_url"))
    again = counts.join(heads, F.col("key") == F.col("of")).drop("of").withColumn("skip", own.cast("long")).where("n > skip")
    again = again.withColumn("copy", F.explode(F.sequence(F.col("skip"), F.col("n") - 1)))
    names = first.columns
    again = again.withColumn("payload", F.lit(None).cast("binary")).withColumn("revisit", F.lit(True)).select(names)
    plans = first.unionByName(again)
    if least_bytes:
        small = rows.where(F.col("size") < least_bytes).withColumn("copy", F.monotonically_increasing_id())
        small = small.withColumn("head_id", F.col("page_id")).withColumn("head_url", F.col("url")).withColumn("revisit", F.lit(False))
        plans = plans.unionByName(small.select(names))
    return plans


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write ``pages(page_id, url, html)`` as gzip WARC archives below ``folder``, which all executors must reach.

    The payload of a record is the html in UTF-8, a missing one empty. Of equal payloads of at least ``least_bytes`` bytes, that
    with the smallest ``page_id`` is a response and the others are revisits of it; missing ids come last, equal ids by address,
    and of wholly equal rows one is the response. Smaller payloads are all responses. Each record is one gzip member; Spark's writer
    commits the files, so lost tasks leave nothing behind. Between records stands an empty member, which unpacks to nothing.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, MEMBERS):
                rows = batch.slice(i, MEMBERS).to_pylist()
                packed = [
                    record(r["page_id"], r["url"], r["payload"], r["size"], r["sha1"], r["key"], r["copy"], r["head_id"], r["head_url"], r["revisit"], date)
                    for r in rows
                ]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["member"])

    packed = _plans(pages, least_bytes).mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(folder)


# ------------------------------------------------------------------ reading


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    size: int
    digest: str | None
    payload: bytes | None


class Members:
    """Unpacked bytes of consecutive gzip members, a few kilobytes at a time."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.buffer, self.unpack = data, 0, bytearray(), None
        self.given = 0

    def next_member(self) -> int | None:
        """Offset of the next member that holds anything; None at the end of the archive."""
        while self.at < len(self.data):
            start = self.at
            self.unpack, self.given = zlib.decompressobj(GZIP), start
            if self.more():
                return start
        return None

    def more(self) -> bool:
        """Unpack up to ``READ`` more bytes of this member into the buffer; False at its end."""
        while not self.unpack.eof:
            tail = self.unpack.unconsumed_tail
            if not tail:
                if self.given >= len(self.data):
                    raise ValueError(f"archive ends inside the member at {self.at}")
                tail = bytes(self.data[self.given : self.given + READ])
                self.given += len(tail)
            try:
                out = self.unpack.decompress(tail, READ)
            except zlib.error as wrong:
                raise ValueError(f"damaged member at {self.at}: {wrong}") from None
            if self.unpack.eof:
                self.at = self.given - len(self.unpack.unused_data)
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``."""
        seen = 0
        while (found := self.buffer.find(mark, max(0, seen - len(mark) + 1))) < 0:
            seen = len(self.buffer)
            if not self.more():
                raise ValueError(f"record before {self.at} has no end of its head")
        out = bytes(self.buffer[: found + len(mark)])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError(f"record before {self.at} is shorter than its Content-Length")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def _checked(said: str | None, sha: hashlib._Hash, what: str, at: int) -> None:
    if said and said.startswith("sha1:") and said[5:] != base64.b32encode(sha.digest()).decode():
        raise ValueError(f"{what} digest of the record at {at} is {said}, its bytes say otherwise")


def read_records(data: bytes | memoryview, with_payload: bool = True) -> Iterator[Record]:
    """Records of one archive in order, each framed by its Content-Length; digests that differ from the bytes are errors."""
    members = Members(memoryview(data))
    while (at := members.next_member()) is not None:
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        fields = _fields(head)
        block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
        is_http = fields.get("content-type", "").replace(" ", "").startswith("application/http")
        http, size = (bytearray() if is_http else None), 0
        inner: dict[str, str] = {}
        for piece in members.take(int(fields["content-length"])):
            block.update(piece)
            if http is not None:
                seen = len(http)
                http += piece
                end = http.find(b"\r\n\r\n", max(0, seen - 3))
                if end < 0:
                    continue
                inner, piece, http = _fields(bytes(http[:end])), bytes(http[end + 4 :]), None
            payload.update(piece)
            size += len(piece)
            if with_payload:
                kept.append(piece)
        if b"".join(members.take(4)) != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end after its Content-Length")
        if members.buffer or members.more():
            raise ValueError(f"member at {at} holds more than one record")
        _checked(fields.get("warc-block-digest"), block, "block", at)
        digest = fields.get("warc-payload-digest")
        if fields.get("warc-type") == "revisit":  # the payload is elsewhere: its length is what the response's head says
            yield Record(at, fields, int(inner.get("content-length", size)), digest, None)
            continue
        _checked(digest, payload, "payload", at)
        if "content-length" in inner and int(inner["content-length"]) != size:
            raise ValueError(f"response at {at} has {size} bytes, its head says {inner['content-length']}")
        digest = digest or "sha1:" + base64.b32encode(payload.digest()).decode()
        yield Record(at, fields, size, digest, b"".join(kept) if with_payload else None)


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives below ``folder``: place, id, type, address, page and payload (see ``RECORDS``).

    One task reads an archive from its first member to its last, a few kilobytes unpacked at a time; the packed archive is one value, so
    archives of up to 2 GB can be read. An archive that is cut off, framed wrongly or differs from its digests is an error. Other
    record types come out as they are; an empty folder gives no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(c, pa.string()) for c in ("archive",)], ("offset", pa.int64()), *[(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "page_id", "refers_to")], ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                try:
                    for r in read_records(memoryview(content.as_buffer()), with_payload):
                        h, revisit = r.headers, r.headers.get("warc-refers-to")
                        page = _page_of(h.get("warc-record-id", ""))
                        rows.append((path.as_py(), r.offset, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), page, revisit and _page_of(revisit), r.size, r.digest and r.digest.removeprefix("sha1:"), r.payload))
                        held += len(r.payload or b"")
                        if len(rows) == 4096 or held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                except ValueError as wrong:
                    raise ValueError(f"{path}: {wrong}") from None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(folder)
    return files.where("length > 0").select("path", "content").mapInArrow(parse, RECORDS)


def archive_report(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives to the shared folder and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    One row per page; missing html is an empty payload, missing ids stay missing (also in ``refers_to``), repeated rows are records of their
    own, other columns are ignored and an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}/warc"
    write_warc(pages, folder, least_bytes)
    kind = pages.schema["page_id"].dataType
    rows = read_warc(spark, folder, with_payload=False)
    return rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
