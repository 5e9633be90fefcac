"""WARC: conversion of legacy ARC archives, with payload deduplication.

An ARC file starts with a version block whose second line names the version; a
record is a header line of that version's fields (version 1: five, version 2: ten, the last
is the length), that many bytes, and a line feed. The converter reads the declared
lengths and synthesises what ARC lacks: record identifiers (name-based UUIDs), ISO dates,
record types from the content, and SHA-1 block and payload digests. Records are written
as gzip members, one each, and verified when they are read back.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.frames import written
from meridian.llm.words import by_size

# The header fields of the two ARC versions.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
FIELD_LINES = {
    1: b"URL IP-address Archive-date Content-type Archive-length\n",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ARCHIVE_BYTES = 8 << 20
FEW = 50_000


class ArchiveError(ValueError):
    """An archive is damaged."""


class ArcRecord(NamedTuple):
    """A record of an ARC file; ``fields`` are those of its version."""

    fields: dict[str, str]
    body: bytes


def write_arc(records: list[tuple[str, str, str, bytes]], version: int, name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    """An ARC file of (url, ip, content type, body) records."""
    about = b"%d 0 Meridian\n" % version + FIELD_LINES[version]
    clean = lambda x: re.sub(r"\s", lambda m: quote(m[0], safe=""), x) or "-"

    def line(url: str, ip: str, kind: str, size: int) -> bytes:
        values = {"url": clean(url), "ip": ip, "date": date, "type": clean(kind), "status": "200", "checksum": "-", "location": "-", "offset": "0", "file": name, "length": str(size)}
        return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n"

    # a version block always has version 1 or 2 fields of its own version
    parts = [line(f"filedesc://{name}", "0.0.0.0", "text/plain", len(about)), about, b"\n"]
    for url, ip, kind, body in records:
        parts += (line(url, ip, kind, len(body)), body, b"\n")
    return b"".join(parts)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, after its version block, by declared lengths."""
    at, version = 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError("a header line does not end")
        line = data[at:end].decode("utf-8", "surrogateescape")
        if not line.strip():
            at = end + 1
            continue
        if not version:
            found = re.match(rb"(\d+) \d+ [^\n]*\n", data[end + 1 :])
            if not line.startswith("filedesc:") or not found or int(found[1]) not in FIELDS:
                raise ArchiveError("no version block")
            version, first = int(found[1]), True
        else:
            first = False
        values = line.rsplit(" ", len(FIELDS[version]) - 1)
        if len(values) != len(FIELDS[version]) or not values[-1].isdigit():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        size = int(values[-1])
        if end + 1 + size > len(data):
            raise ArchiveError("a record is cut off")
        if not first:
            yield ArcRecord(dict(zip(FIELDS[version], values)), data[end + 1 : end + 1 + size])
        at = end + 1 + size


def digest(data: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def iso_date(date: str) -> str:
    """A 14-digit ARC date as WARC has it; shorter ones are filled up, others are the epoch."""
    if not re.fullmatch(r"\d{4,14}", date):
        return "1970-01-01T00:00:00Z"
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP headers, with their blank line, and the payload; no headers if the body is not HTTP."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def to_warc(record: ArcRecord, name: str | None, refers_to: str | None) -> bytes:
    """The WARC record of an ARC record. ``name`` identifies its row (null: none); with ``refers_to`` (another row) it is a revisit.

    Row names are percent-encoded in their headers; a row without a name has no such header.
    """
    http, payload = split_http(record.body)
    key, code = "" if name is None else "row " + name, digest(payload)
    kind = "revisit" if refers_to is not None else "response" if http else "resource"
    block = http if kind == "revisit" else record.body
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(f"{key}:{code}")), ("WARC-Date", iso_date(record.fields["date"])),
        ("WARC-Target-URI", record.fields["url"]), ("WARC-IP-Address", record.fields["ip"]),
        ("WARC-Payload-Digest", f"sha1:{code}"), ("WARC-Payload-Length", str(len(payload))), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response" if http else record.fields["type"]), ("Content-Length", str(len(block))),
    ]
    if name is not None:
        headers.append(("WARC-Source-Row", quote(name, safe="")))
    if refers_to is not None:
        headers[2:2] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"row {refers_to}:{code}")), ("WARC-Refers-To-Row", quote(refers_to, safe=""))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member of one record."""
    tool = zlib.compressobj(1, zlib.DEFLATED, 31)
    return tool.compress(record) + tool.flush()


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a gzipped WARC file; digests are verified."""
    while data:
        tool = zlib.decompressobj(31)
        raw = tool.decompress(data)
        if not tool.eof:
            raise ArchiveError("a record is cut off")
        data = tool.unused_data
        end = raw.find(b"\r\n\r\n")
        first, *lines = raw[:end].decode("utf-8", "surrogateescape").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        if not first.startswith("WARC/") or raw[end + 4 + size :] != b"\r\n\r\n":
            raise ArchiveError("bad record")
        if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ArchiveError("a block's digest differs")
        if headers["WARC-Type"] != "revisit":
            payload = split_http(block)[1]
            if headers["WARC-Payload-Digest"] != f"sha1:{digest(payload)}" or headers["WARC-Payload-Length"] != str(len(payload)):
                raise ArchiveError("a payload's digest or length differs")
        yield headers, block


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """ARC records of ``pages``, converted: a written table of ``name`` and ``body`` (a gzipped WARC file).

    Of rows with equal payloads (by SHA-256) of at least ``least`` bytes those with the largest id are responses, all others revisit it;
    rows with smaller payloads are responses. Null payloads are empty, null urls are written as ``-``; a null id
    is smaller than any other, and rows that repeat the largest id stay responses. An empty table gives no archive.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    groups = rows.where("same IS NOT NULL").groupBy("same").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1").select("same", "top")
    groups = written(groups, "payload-groups")
    # sent to all executors only while there are few groups; else both sides are sorted by the digest, and AQE splits a hot one
    groups = F.broadcast(groups) if groups.count() <= FEW else groups.hint("merge")
    rows = rows.join(groups, "same", "left").select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(b for raw in batches for b in by_size(iter([raw]), "payload", ARCHIVE_BYTES)):
            html, records = batch.column("payload").to_pylist(), []
            for url, body in zip(batch.column("url").to_pylist(), html):
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
                records.append((url, "0.0.0.0", "text/html", head + body))
            arc = write_arc(records, 1 + n % 2)
            del html, records
            ids, tops = batch.column("id").to_pylist(), batch.column("refers_to").to_pylist()
            out = [member(to_warc(r, None if i is None else str(i), None if t is None else str(t))) for r, i, t in zip(parse_arc(arc), ids, tops)]
            body = b"".join(out)
            yield pa.RecordBatch.from_pydict({"name": pa.array([f"{hashlib.sha1(body).hexdigest()}.warc.gz"]), "body": pa.array([body], pa.binary())})

    return written(rows.mapInArrow(convert, "name string, body binary"), "archives")


def read_archives(archives: DataFrame, id_col: str = "page_id", id_type: str = "bigint") -> DataFrame:
    """One row per archived record: ``id_col``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Digests and lengths of stored payloads are verified; a revisit, which stores none, has those of the payload that it refers to. A damaged archive raises ``ArchiveError``.
    """
    row = lambda x: None if x is None else unquote(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                heads = [headers for headers, _ in read_warc(body.as_py())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row(h.get("WARC-Source-Row")) for h in heads], pa.string()),
                    pa.array([int(h["WARC-Payload-Length"]) for h in heads], pa.int64()),
                    pa.array([h["WARC-Payload-Digest"].removeprefix("sha1:") for h in heads], pa.string()),
                    pa.array([h["WARC-Type"] for h in heads], pa.string()), pa.array([row(h.get("WARC-Refers-To-Row")) for h in heads], pa.string()),
                ], ["row", "payload_bytes", "payload_digest", "record_type", "top"])

    found = archives.select("body").mapInArrow(run, "row string, payload_bytes long, payload_digest string, record_type string, top string")
    return found.select(F.col("row").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("top").cast(id_type).alias("refers_to"))


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages), "page_id", pages.schema["page_id"].dataType.simpleString())


#: Base32 digests are built from the hexadecimal SHA-1, five bits at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS same, '0x' || sha1(h) AS hex FROM p),
bits AS (SELECT page_id, n, same, array_to_string(list_transform(range(3, 43), lambda i: right('000' || bin(('0x' || substr(hex, i::INT, 1))::INT), 4)), '') AS b FROM d),
code AS (SELECT page_id, n, same, array_to_string(list_transform(range(1, 161, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_sum(list_transform(range(0, 5), lambda k: (substr(b, (i + k)::INT, 1))::INT * (16 >> k)))::INT) + 1, 1)), '') AS payload_digest FROM bits),
top AS (SELECT same, max(page_id) AS top FROM code GROUP BY same)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM code JOIN top USING (same)
"""
