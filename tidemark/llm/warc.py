"""Legacy ARC archives to WARC: parse by version, synthesise what ARC lacks, link equal payloads.

``write_arc`` makes ARC archives of versions 1 and 2, ``read_arc`` parses them by
the header line of their version and the declared lengths, ``convert``
synthesises WARC ids, timestamps, types and payload digests and turns records
with a payload that another record has into revisits, ``write_warc`` and
``read_warc`` write and parse WARC/1.1 archives.

Archives are written by Spark's text writer, a row for each file, and read by its
binary reader, so they can be on any file system that Spark knows.  Every WARC
record is a gzip member of its own, so readers can seek to it; an ARC file is one
member.  A file begins with its version or warcinfo record and ends at
``ARCHIVE_BYTES`` of content, or with the one record that is longer.

Record ids come from the conversion, the file and the place in it: a task that
runs twice gives the same ids, two conversions share none.

Defined results: a null payload is empty; a null url is ``-`` in ARC and blanks
in urls are percent-encoded; a null id is written as none and read as null; of
equal payloads the record with the largest id answers (null ids come last, rows
that repeat the id in the order of their record ids) and payloads under
``min_bytes`` are never revisits; a bad timestamp becomes 1970-01-01; an empty
table makes no archives and an empty result.  Damage costs only what it hit: a
record that ends before its declared length is marked truncated by ``length``; a
stretch from a header line that can't be read to the next one that can becomes a
resource without page id, marked ``unspecified``; an unknown ARC version is read
by the field line that it brings, or as version 1; a WARC record without a usable
length ends where the next one begins; of a broken gzip member what can be
inflated counts, and reading goes on at the next member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import bound_batches, materialize, new_path, read_table, scratch
from .textblock import bytes_of, column

ARCHIVE_BYTES = 16 << 20
OUT_BYTES = 8 << 20
GZIP_LEVEL = 3

# The field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, url string, ip string, date string, mime string, type string, http binary, payload binary, payload_bytes long, digest string, truncated string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gunzip(data: bytes) -> bytes:
    """The content of a gzip file of one or more members; other data as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while at >= 0 and data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            for lo in range(at, len(data), 1 << 16):
                out.append(member.decompress(data[lo : lo + (1 << 16)]))
                if member.eof:
                    break
            at = min(lo + (1 << 16), len(data)) - len(member.unused_data) if member.eof else -1
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", at + 2)
    return b"".join(out)


class _Archive:
    """One file: records with the format's separator after each, in a gzip member each or in one."""

    def __init__(self, separator: bytes, seekable: bool):
        self.separator, self.seekable, self.parts, self.size, self.member = separator, seekable, [], 0, None

    def add(self, record: bytes) -> None:
        self.member = self.member or zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        self.parts += [self.member.compress(record), self.member.compress(self.separator)]
        self.size += len(record) + len(self.separator)
        if self.seekable:
            self._end()

    def _end(self) -> None:
        if self.member:
            self.parts.append(self.member.flush())
        self.member = None

    def rows(self) -> Iterator[tuple[bytes]]:
        self._end()
        if self.parts:
            yield (b"".join(self.parts),)
        self.parts, self.size = [], 0


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``OUT_BYTES``."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


_BYTES = pa.schema([("value", pa.binary())])


def _write(archives: DataFrame, path: str) -> None:
    """A file for each row.  The writer ends it with a line feed, which comes after the last gzip member."""
    archives.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def _payloads(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    buf, offs = bytes_of(column(batch, name))
    return (buf[a:b].tobytes() for a, b in zip(offs, offs[1:]))


# ARC


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n".encode()
    fields = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    if version == 2:
        fields += f" 200 - - 0 {name}"
    return f"{fields} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, mime: str, content: bytes) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
    fields = f"{url} 0.0.0.0 {date} {mime}"
    if version == 2:
        fields += f" 200 - - {offset} {name}"
    return f"{fields} {len(content)}\n".encode() + content


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20000101000000") -> None:
    """One ARC record per row, with HTTP headers before the payload; archives of versions 1 and 2 by turns."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes]]:
            part, number, version, name, archive = TaskContext.get().partitionId(), 0, 1, "", _Archive(b"\n", False)
            for batch in batches:
                for page, url, payload in zip(column(batch, "page_id").to_pylist(), column(batch, "url").to_pylist(), _payloads(batch, "payload")):
                    if not archive.size:
                        version, name = 1 + (part + number) % 2, f"part{part:06d}-{number:06d}.arc"
                        number += 1
                        archive.add(arc_version_block(version, name, date))
                    known = f"X-Page-Id: {page}\r\n" if page is not None else ""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n"
                    archive.add(arc_record(version, name, archive.size, url, date, "text/html", head.encode() + payload))
                    if archive.size >= ARCHIVE_BYTES:
                        yield from archive.rows()
            yield from archive.rows()

        return _batches(rows(), _BYTES, lambda r: len(r[0]))

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    _write(rows.mapInArrow(run, "value binary"), path)


#: A line that can be an ARC header: url, address, timestamp, other fields, length.
_HEADER = re.compile(rb"^(?:[A-Za-z][A-Za-z0-9+.-]*:[^ \n]*|-) [^ \n]+ \d{8,14} [^\n]*\d\r?$", re.M)


def parse_arc(data: bytes) -> Iterator[tuple]:
    """(archive, offset, fields, content, truncated) of every record but the version block.

    ``truncated`` is empty, ``length`` for a record that ends too early, or
    ``unspecified`` for a stretch without a header, which has no fields.
    """
    at, fields, archive = 0, ARC_FIELDS[1].lower().split(), ""
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : max(end, 0)].rstrip(b"\r").decode("utf-8", "replace")
        length = line.rsplit(" ", 1)[-1]
        known = end >= 0 and length.isascii() and length.isdigit()
        if known and line.startswith("filedesc://"):
            size = int(length)
            body = data[end + 1 : end + 1 + size].decode("utf-8", "replace").split("\n")
            own = body[1].strip().lower().split() if len(body) > 1 else []
            version = body[0].split(" ")[0]
            fields = own if own[:1] == ["url"] and len(own) > 1 else ARC_FIELDS[2 if version == "2" else 1].lower().split()
            archive = line.split(" ", 1)[0].removeprefix("filedesc://")
        else:
            values = line.rsplit(" ", len(fields) - 1)
            if not known or len(values) < len(fields):
                found = _HEADER.search(data, end + 1) if end >= 0 else None
                size = (found.start() if found else len(data)) - at
                yield archive, at, {}, data[at : at + size], "unspecified"
                at += size
                continue
            size = int(length)
            content = data[end + 1 : end + 1 + size]
            yield archive, at, dict(zip(fields, values)), content, "length" if len(content) < size else ""
        at = end + 1 + size


def warc_date(date: str) -> str:
    """The WARC form of an ARC timestamp of 8 to 14 digits."""
    if not re.fullmatch(r"\d{8,14}", date):
        return "1970-01-01T00:00:00Z"
    d = (date + "000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def synthesise(run: str, archive: str, offset: int, fields: dict[str, str], content: bytes, truncated: str) -> tuple:
    """A row of ``RECORD_SCHEMA`` for one ARC record; ``run`` tells conversions apart."""
    number = uuid.uuid5(uuid.NAMESPACE_URL, f"arc:{run}:{archive}:{offset}")
    url = fields.get("url") or f"urn:uuid:{number}"
    if fields and content.startswith(b"HTTP/"):
        head, found, payload = content.partition(b"\r\n\r\n")
        kind, head = "response", head + found
    else:
        kind, head, payload = "resource", b"", content
    return (f"urn:uuid:{number}", url, fields.get("ip-address", "0.0.0.0"), warc_date(fields.get("archive-date", "")), fields.get("content-type", "application/octet-stream"), kind, head, payload, len(payload), payload_digest(payload), truncated or None)


_ARC_ROWS = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("type", pa.string()), ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("truncated", pa.string())])


def _packed(row: tuple) -> tuple:
    return (*row[:7], zlib.compress(row[7], 1), *row[8:])


def read_arc(spark: SparkSession, path: str, packed: bool = False, run_id: str | None = None) -> DataFrame:
    """The records of the ARC archives in a folder, in WARC terms; with ``packed`` payloads deflated, for a shuffle to come.

    Record ids hold for one conversion, named ``run_id`` or by a new random one.
    """
    bound_batches(spark)
    conversion = run_id or uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (synthesise(f"{conversion}:{file}", *r) for batch in batches for file, data in zip(column(batch, "path").to_pylist(), _payloads(batch, "content")) for r in parse_arc(_gunzip(data)))
        rows = map(_packed, rows) if packed else rows
        return _batches(rows, _ARC_ROWS, lambda r: len(r[7]) + 500)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def _page_id(http: str) -> F.Column:
    return F.expr(f"try_cast(nullif(regexp_extract(cast({http} AS string), 'X-Page-Id: (-?[0-9]+)', 1), '') AS bigint)")


# Conversion


def convert(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with equal payloads linked: type is revisit for all but one of them, refers_to its record id, url and date.

    Only ids, digests and lengths meet by payload; payloads themselves are dealt
    out by record id, so a payload that many records have makes no large task.
    """
    known = materialize(records.select("record_id", "url", "date", "type", "payload_bytes", "digest", _page_id("http").alias("page_id")), "digests")
    answer = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "record_id", "url", "date"))
    heads = known.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(answer.alias("head"))
    verdicts = known.select("record_id", "digest", "payload_bytes").join(heads, ["digest", "payload_bytes"]).where("record_id <> head.record_id")
    verdicts = verdicts.select("record_id", F.col("head.record_id").alias("refers_to"), F.col("head.url").alias("refers_to_url"), F.col("head.date").alias("refers_to_date"))
    linked = records.join(verdicts, "record_id", "left")
    return linked.withColumn("type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise(F.col("type")))


# WARC


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def write_warc(records: DataFrame, path: str, packed: bool = False) -> None:
    """One WARC record per row of a converted table, ``packed`` if its payloads are; every file begins with a warcinfo record."""
    bound_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes]]:
            part, number, archive = TaskContext.get().partitionId(), 0, _Archive(b"\r\n\r\n", True)
            for batch in batches:
                names = ("record_id", "url", "ip", "date", "mime", "type", "payload_bytes", "digest", "truncated", "refers_to", "refers_to_url", "refers_to_date")
                fields = zip(*(column(batch, c).to_pylist() for c in names))
                for f, http, payload in zip(fields, _payloads(batch, "http"), _payloads(batch, "payload")):
                    if not archive.size:
                        info = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo:{path}:{part}:{number}")
                        number += 1
                        archive.add(warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{info}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    rid, url, ip, date, mime, kind, size, digest, cut, ref, ref_url, ref_date = f
                    block = http if kind == "revisit" else http + (zlib.decompress(payload) if packed else payload)
                    headers = [("WARC-Record-ID", f"<{rid}>"), ("WARC-Target-URI", url), ("WARC-IP-Address", ip), ("WARC-Date", date), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size), ("Content-Type", "application/http; msgtype=response" if http else mime)]
                    if cut:
                        headers.append(("WARC-Truncated", cut))
                    if kind == "revisit":
                        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ref}>"), ("WARC-Refers-To-Target-URI", ref_url), ("WARC-Refers-To-Date", ref_date)]
                    archive.add(warc_record(kind, headers, block))
                    if archive.size >= ARCHIVE_BYTES:
                        yield from archive.rows()
            yield from archive.rows()

        return _batches(rows(), _BYTES, lambda r: len(r[0]))

    _write(records.mapInArrow(run, "value binary"), path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record; damage is marked in ``warc-truncated``."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = headers.get("content-length", "")
        if length.isascii() and length.isdigit():
            block = data[end + 4 : end + 4 + int(length)]
            at = end + 4 + int(length)
            if len(block) < int(length):
                headers.setdefault("warc-truncated", "length")
        else:
            found = data.find(b"\r\n\r\nWARC/", end + 2)
            at = found + 4 if found >= 0 else len(data)
            block = data[end + 4 : at].removesuffix(b"\r\n\r\n")
            headers["warc-truncated"] = "unspecified"
        yield headers, block


_WARC_ROWS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("truncated", pa.string()), ("http", pa.binary()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the WARC archives in a folder but warcinfo; digest and length are of the payload read, for a revisit as declared."""
    bound_batches(spark)

    def row(h: dict[str, str], block: bytes) -> tuple:
        kind = h.get("warc-type", "resource")
        head, found, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        if kind == "revisit":
            length = h.get("x-payload-length", "")
            payload, size, digest = None, int(length) if length.isdigit() else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        else:
            size, digest = len(payload), payload_digest(payload)
        strip = lambda x: x and x.strip("<>")
        return strip(h.get("warc-record-id")), kind, h.get("warc-target-uri"), h.get("warc-date"), digest, size, strip(h.get("warc-refers-to")), h.get("warc-truncated"), head + found, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(h, block) for batch in batches for data in _payloads(batch, "content") for h, block in parse_warc(_gunzip(data)) if h.get("warc-type") != "warcinfo")
        return _batches(rows, _WARC_ROWS, lambda r: len(r[9] or b"") + 500)

    schema = "record_id string, type string, url string, date string, digest string, payload_bytes long, refers_to string, truncated string, http binary, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Pages through ARC and WARC archives in the shared folder and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    with scratch(spark):
        arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
        write_arc(pages, arc, **columns)
        write_warc(convert(read_arc(spark, arc, packed=True), min_bytes), warc, packed=True)
        back = materialize(read_warc(spark, warc, with_payload=False).select(_page_id("http").alias("page_id"), "record_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"), "warc-index", outer=True)
    revisits = back.where("refers_to IS NOT NULL")
    answers = back.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_answer"))
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    found = revisits.join(answers, "refers_to", "left").select(*shown, F.col("_answer").alias("refers_to"))
    return found.unionAll(back.where("refers_to IS NULL").select(*shown, F.lit(None).cast("long").alias("refers_to")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages"))
