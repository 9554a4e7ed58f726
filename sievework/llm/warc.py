r"""Web archives: legacy ARC files read, converted to WARC records, written, and read back.

Method.  An ARC file starts with a version block, whose lines name the version and the columns of the header
lines that follow: version 1 has five (address, IP, date, type, length), version 2 ten (with result code, checksum,
location, offset and file name before the length).  A header line is taken from both ends, as addresses and types
of real files hold spaces, and the declared length alone says where a record ends.  The converter makes of each
record what a WARC record needs and an ARC record lacks: an identifier (a UUID of the file's name and the record's offset,
so a rerun makes the same), an ISO date from digits of any declared length, a type (``warcinfo`` for the version
block, ``response`` for HTTP, ``resource`` else), and SHA-1 digests of block and payload in base 32.  Of records with
equal payloads the one with the largest key is a ``response``, the others are ``revisit`` records, which keep their HTTP
head and name the record they refer to.

How it runs.  A file is a row while it is read or written, of ``ARCHIVE_BYTES`` before compression (or of one larger
record).  Spark's text writer writes it, gzipped, with the line break that ends a record.  Who is a
response is decided on narrow rows (digest, key, file, offset) by one aggregate with partial sums; files, compressed,
meet the decisions of their own records.  No task holds the records of a common payload.

Defined results: a null text is an empty payload; a null address becomes ``urn:page:<id>``, white space and control
characters in one are percent-encoded.  A null id is smaller than any other; of rows of one id and payload the one that is
read last is the response.  A record whose header line can't be read is skipped to the next that can, and given as
``damaged`` by ``read_arc``; a record cut short by its file's end is kept as far as it goes and marked truncated.
Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import give_back
from .store import new_path, written

#: Bytes of an archive before compression, about.
ARCHIVE_BYTES = 8 << 20
#: The capture time given to records of pages, which have none.
CAPTURED = "20000101000000"
#: The column lines of the two versions, and names of header fields.
COLUMNS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_FIELD, REFERS_KEY = "X-Page-Id", "WARC-X-Refers-To-Page-Id"
ARC = "file string, start long, version int, url string, ip string, date string, type string, status string, checksum string, location string, length long, truncated boolean, damaged boolean, block binary"
RECORD = "file string, start long, type string, fields map<string,string>, block binary"
_SPACE = re.compile(rb"[\x00-\x20\x7f]")
#: Version 1 and 2 header lines: the address may hold spaces, and so may the type; dates have 8 to 14 digits.
_LINE = {
    1: re.compile(rb"(?P<url>\S.*?) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>\d{8,14}|-) (?P<type>.*?) (?P<length>\d+)$"),
    2: re.compile(rb"(?P<url>\S.*?) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>\d{8,14}|-) (?P<type>.*?) (?P<status>\d+|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)$"),
}
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(content: bytes) -> bytes:
    """A file's bytes, with its gzip members (one, or one for each record) opened; a torn member gives what it has."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out += [member.decompress(content), member.flush()]
        except zlib.error:
            break
        content = member.unused_data
    return b"".join(out)


# ARC files


class ArcRecord(NamedTuple):
    start: int
    version: int
    url: str
    ip: str
    date: str
    type: str
    status: str | None
    checksum: str | None
    location: str | None
    length: int
    truncated: bool
    damaged: bool
    block: bytes


def arc_line(version: int, url: bytes, ip: str, date: str, kind: str, length: int, status: str = "200", location: str = "-", offset: int = 0, file: str = "-", checksum: str = "-") -> bytes:
    middle = [kind] if version == 1 else [kind, status, checksum, location, str(offset), file]
    return b" ".join([url, *(x.encode() for x in (ip, date, *middle, str(length)))])


def arc_start(version: int, name: str, date: str = CAPTURED, origin: str = "sievework") -> bytes:
    """The version block of a file."""
    body = f"{version} 0 {origin}\n".encode() + COLUMNS[version] + b"\n\n"
    return arc_line(version, f"filedesc://{name}".encode(), "0.0.0.0", date, "text/plain", len(body), file=name) + b"\n" + body


def arc_records(raw: bytes) -> Iterator[ArcRecord]:
    """Records of a file, its version block first; lengths, not line ends, part them."""
    version = int(m[1]) if (m := re.match(rb"[^\n]*\n([12]) ", raw)) else 1
    at, line = 0, _LINE[version]

    def parsed(at: int):
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        return end, line.match(raw[at:end].rstrip(b"\r"))

    while True:
        while raw[at : at + 1] in (b"\n", b"\r"):  # records end with an empty line
            at += 1
        if at >= len(raw):
            return
        end, m = parsed(at)
        if m is None:
            lost = at
            while m is None and end < len(raw):
                at = end + 1
                end, m = parsed(at)
            at = len(raw) if m is None else at
            yield ArcRecord(lost, version, "", "", "", "", None, None, None, at - lost, False, True, raw[lost:at])
            continue
        f = {k: v.decode("utf-8", "replace") for k, v in m.groupdict().items() if v is not None}
        length, block = int(f["length"]), raw[end + 1 : end + 1 + int(f["length"])]
        blank = lambda k: None if f.get(k, "-") == "-" else f[k]
        yield ArcRecord(at, version, f["url"], f["ip"], f["date"], f["type"], blank("status"), blank("checksum"), blank("location"), length, len(block) < length, False, block)
        at = end + 1 + length


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """Head (with the empty line that ends it) and payload of an HTTP message; None for other blocks."""
    if not block.startswith(b"HTTP/"):
        return None
    m = _HEAD_END.search(block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def _key(head: bytes) -> int | None:
    value = http_field(head, KEY_FIELD)
    return int(value) if value and re.fullmatch(r"-?\d{1,18}", value) else None


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Pages as HTTP responses in gzipped ARC files, whose versions take turns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            start = arc_start(versions[(part + k) % len(versions)], f"pages-{part:06d}-{k:06d}.arc")
            return pa.RecordBatch.from_arrays([pa.array([b"\n".join([start[:-1], *parts])], pa.binary())], names=["value"])

        for batch in batches:
            for i, url, html in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                version = versions[(part + k) % len(versions)]
                payload = html.as_py().encode("utf-8", "surrogatepass") if html.is_valid else b""
                named = f"{KEY_FIELD}: {i}\r\n" if i is not None else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload
                address = _SPACE.sub(lambda m: b"%%%02X" % m[0][0], url.as_py().encode()) if url.is_valid else b""
                address = address or f"urn:page:{'' if i is None else i}".encode()
                parts.append(arc_line(version, address, "0.0.0.0", CAPTURED, "text/html", len(block), offset=size, file=f"pages-{part:06d}-{k:06d}.arc") + b"\n" + block)
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield out()
                    k, parts, size = k + 1, [], 0
        if parts:
            yield out()
        give_back()

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(pack, "value binary")
    _write_files(rows, path, "\n")


def _write_files(rows: DataFrame, path: str, end: str) -> None:
    """Each row's bytes as a gzipped file, closed by ``end``.  Level 1 costs a third of the time and a fifth more room."""
    how = {"lineSep": end, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 1}
    rows.select(F.col("value").cast("string")).write.options(**how).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name, which Spark makes unique) and content of each file in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _empty(path: str, spark: SparkSession) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path + "/part-*")
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there)
    return not found


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC files in a folder, gzipped or not, of either version (see ARC)."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("version", pa.int32()), *[(k, pa.string()) for k in ("url", "ip", "date", "type", "status", "checksum", "location")], ("length", pa.int64()), ("truncated", pa.bool_()), ("damaged", pa.bool_()), ("block", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [{"file": file} | r._asdict() for r in arc_records(plain(content.as_py()))]
                yield pa.RecordBatch.from_pylist(rows, schema)
        give_back()

    return _files(spark, path).mapInArrow(read, ARC)


# Conversion


def iso_date(digits: str) -> str:
    """ISO time of 8 to 14 digits, missing ones as zeros; what is no time is the epoch."""
    try:
        return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(file: str, start: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{start}')}>"


def _facts(file: str, r: ArcRecord) -> dict:
    """What decides between response and revisit."""
    parts = http_parts(r.block)
    return {"file": file, "start": r.start, "key": _key(parts[0]) if parts else None, "url": r.url, "date": iso_date(r.date), "size": len(parts[1]) if parts else None, "digest": digest32(parts[1]) if parts else None}


def warc_record(file: str, r: ArcRecord, refers: dict | None) -> bytes:
    """The record's WARC form without the two line breaks that end it; refers: the response it revisits."""
    parts = http_parts(r.block)
    kind = "warcinfo" if r.url.startswith("filedesc:") else "response" if parts else "resource"
    block, fields = r.block, {"WARC-Type": kind, "WARC-Record-ID": record_id(file, r.start), "WARC-Date": iso_date(r.date)}
    if kind == "warcinfo":
        fields["WARC-Filename"] = r.url.removeprefix("filedesc://")
        block = f"software: sievework\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {r.version}\r\n".encode()
    else:
        fields["WARC-Target-URI"] = r.url
        if r.ip not in ("-", "0.0.0.0"):
            fields["WARC-IP-Address"] = r.ip
        fields["WARC-Payload-Digest"] = "sha1:" + digest32(parts[1] if parts else block)
    if refers:
        fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers["file"], refers["start"]), "WARC-Refers-To-Target-URI": refers["url"], "WARC-Refers-To-Date": refers["date"]}
        if refers["key"] is not None:
            fields[REFERS_KEY] = str(refers["key"])
        block = parts[0]
    if r.truncated:
        fields["WARC-Truncated"] = "unspecified"
    fields["WARC-Block-Digest"] = "sha1:" + digest32(block)
    fields["Content-Type"] = {"warcinfo": "application/warc-fields", "resource": r.type or "application/octet-stream"}.get(kind, "application/http; msgtype=response")
    fields["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n" + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """The ARC files of a folder as gzipped WARC files, one for each.

    HTTP payloads of ``least_bytes`` or more that occur more than once are kept in one response.
    """
    refers = pa.schema([("file", pa.string()), ("start", pa.int64()), ("key", pa.int64()), ("url", pa.string()), ("date", pa.string())])
    schema = pa.schema([*refers, ("size", pa.int64()), ("digest", pa.string())])

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([_facts(file, r) for r in arc_records(plain(content.as_py())) if not r.damaged], schema)
        give_back()

    narrow = _files(spark, arc_path).mapInArrow(facts, "file string, start long, key long, url string, date string, size long, digest string")
    narrow = written(narrow.where(F.col("size") >= least_bytes), "payloads")
    last = F.max(F.struct(F.col("key").isNotNull(), "key", "file", "start", "url", "date"))
    kept = narrow.groupBy("digest").agg(last.alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept.key", "kept.file", "kept.start", "kept.url", "kept.date")
    kept = kept.select("digest", F.struct("file", "start", "key", "url", "date").alias("refers"))
    # a common payload's rows are narrow, and its one row on the other side lets Spark split them
    revisits = narrow.select("file", "start", "digest").join(kept, "digest").where("file <> refers.file OR start <> refers.start").select("file", "start", "refers")

    def make(files: pa.Table, known: pa.Table) -> pa.Table:
        refers = {r["start"]: r["refers"] for r in known.select(["start", "refers"]).to_pylist()}
        rows = []
        for file, content in zip(files.column("file").to_pylist(), files.column("content"), strict=True):
            rows.append(b"\r\n\r\n".join(warc_record(file, r, refers.get(r.start)) for r in arc_records(plain(content.as_py())) if not r.damaged))
        return pa.table({"value": pa.array(rows, pa.binary())})

    files = _files(spark, arc_path).groupBy("file").cogroup(revisits.groupBy("file")).applyInArrow(make, "value binary")
    _write_files(files, warc_path, "\r\n\r\n")


# WARC files


def warc_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Start, header fields and block of each record; what isn't a record is skipped."""
    at = raw.find(b"WARC/")
    while at >= 0:
        m = _HEAD_END.search(raw, at)
        if m is None:
            return
        lines = raw[at : m.start()].decode("utf-8", "replace").splitlines()[1:]
        fields = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = fields.get("Content-Length", "")
        if not length.isdigit():
            at = raw.find(b"\nWARC/", at) + 1 or -1
            continue
        end = m.end() + int(length)
        yield at, fields, raw[m.end() : end]
        at = raw.find(b"WARC/", end)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files in a folder, gzipped or not (see RECORD)."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(warc_records(plain(content.as_py())))
                columns = [[file] * len(rows), [s for s, _, _ in rows], [f.get("WARC-Type") for _, f, _ in rows], [list(f.items()) for _, f, _ in rows], [b for _, _, b in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
        give_back()

    return _files(spark, path).mapInArrow(read, RECORD)


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string"


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each page's record in the WARC files of a folder; the payload of a response is held against its digest."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, fields, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                fields, (head, payload) = dict(fields), http_parts(block.as_py())
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = len(payload) if kind == "response" else int(http_field(head, "Content-Length"))
                if kind == "response" and digest32(payload) != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                refers = fields.get(REFERS_KEY)
                rows.append({"page_id": _key(head), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "record_id": fields["WARC-Record-ID"], "target_uri": fields["WARC-Target-URI"], "date": fields["WARC-Date"]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return read_warc(spark, path).where("type IN ('response', 'revisit')").select("type", "fields", "block").mapInArrow(read, PAGES)


def archived(pages: DataFrame, least_bytes: int = 0, arc_path: str | None = None, warc_path: str | None = None, **how) -> DataFrame:
    """Pages written as ARC files, converted, and read back from the WARC files (see PAGES)."""
    spark = pages.sparkSession
    arc_path, warc_path = arc_path or new_path(spark, "arc"), warc_path or new_path(spark, "warc")
    write_arc(pages, arc_path, **how)
    if _empty(arc_path, spark):
        return spark.createDataFrame([], PAGES)
    convert(spark, arc_path, warc_path, least_bytes)
    return archived_pages(spark, warc_path)


def op12_warc(spark, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS kept, list_transform(range(0, 8), lambda g: ('0x' || h[g * 5 + 1:g * 5 + 5])::BIGINT) AS groups FROM p)
SELECT page_id, payload_bytes,
 list_aggregate(list_transform(groups, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INTEGER + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM d
"""
