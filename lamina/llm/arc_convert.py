"""Legacy archive converter: ARC to WARC (operator 5).

An ARC file opens with a ``filedesc:`` record whose block names the version and
the fields of the record header lines. ``read_arc`` takes the fields from there,
cuts blocks by their declared length and splits off the HTTP headers. ``convert``
gives every record a WARC identifier from its file and offset, a timestamp, a type
and digests; records with an equal payload become revisits of the first. Files are
read with ``binaryFile`` and written with the text writer, so any store that Spark
reads will do; a text value may hold any bytes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LAST_ID, new_path, table, written

LEAST = 100  # bytes of payload from which an equal one is a revisit
# The header fields of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SOURCE = "X-Page-Id"  # HTTP header that carries the row's id
YIELD = 4 << 20
MAX_HEAD = 1 << 16  # bytes of a header line


def _payload(html: str | None) -> bytes:
    return (html or "").encode()


def _arc_writer(version: int | None, date: str, ip: str):
    """Rows (page_id, url, html) -> one ARC file a partition, as (record) values without their last newline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, offset, held, size = version, True, 0, [], 0
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first:
                    own = own or (1 + (page or 0) % 2)  # both versions occur
                    block = f"{own} 0 lamina\n{ARC_FIELDS[own]}\n".encode()
                    held.append(f"filedesc://lamina-{page}.arc 0.0.0.0 {date} text/plain {'200 - - 0 - ' if own == 2 else ''}{len(block)}\n".encode() + block)
                    first = False
                body = _payload(html)
                mark = "" if page is None else f"{SOURCE}: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode() + body
                target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "about:blank"
                more = f"200 {hashlib.md5(block, usedforsecurity=False).hexdigest()} - {offset} lamina.arc " if own == 2 else ""
                record = f"{target} {ip} {date} text/html {more}{len(block)}\n".encode() + block
                held.append(record)
                offset += len(record) + 1
                size += len(record)
                if size >= YIELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    return run


def write_arc(pages: DataFrame, path: str, *, version: int | None = None, date: str = "20240101000000", ip: str = "0.0.0.0") -> None:
    """Write (page_id, url, html) as gzipped ARC files; a null version alternates between 1 and 2."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    values = rows.mapInArrow(_arc_writer(version, date, ip), "value binary").select(F.col("value").cast("string"))
    values.write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _inflate(raw: bytes) -> bytes:
    """The content of a gzip file of one or more members, up to where it is broken; other
    bytes as they are."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        one = zlib.decompressobj(31)
        try:
            for k in range(0, len(raw), YIELD):
                out.append(one.decompress(raw[k : k + YIELD]))
                if one.eof:
                    raw = one.unused_data + raw[k + YIELD :]
                    break
            else:
                out.append(one.flush())
                break
        except zlib.error:
            break
        raw = raw.lstrip(b"\0")
        if raw[:2] != b"\x1f\x8b":
            break
    return b"".join(out)


_HEAD = re.compile(rb"[^\s]\S* .*\d{4,14} .*?(\d+)\r?$")


class Arc(NamedTuple):
    """A record of an ARC file. ``defect``: null, ``short`` (the file ends within the block)
    or ``damaged`` (bytes in which no record header could be read, kept as the block)."""

    offset: int
    head: dict[str, str]
    block: bytes
    defect: str | None


def _header(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """The fields of a header line, or None if it isn't one. The length is always the last
    field; a URL with spaces keeps them, since the others are counted from the right."""
    if len(line) > MAX_HEAD or not _HEAD.match(line):
        return None
    parts = line.rstrip(b"\r").decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
    if len(parts) != len(fields) or not parts[-1].isdigit():
        return None
    return dict(zip((f.lower() for f in fields), parts, strict=True))


def arc_records(data: bytes) -> Iterator[Arc]:
    """Every record of a file, ``filedesc`` included, by declared lengths.

    Where a header line can't be read, the bytes up to the next readable one are one
    ``damaged`` record; a block that the file's end cuts off is ``short``. A file without
    a ``filedesc`` record is read as version 1.
    """
    at, fields, lost = 0, ARC_FIELDS[1].split(), None
    while at < len(data):
        if data[at : at + 1] in b"\r\n" and lost is None:
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:] if end < 0 else data[at:end]
        own = fields
        if line.startswith(b"filedesc:") and len(line) <= MAX_HEAD and (length := _HEAD.match(line)):
            named = data[end + 1 : end + 1 + int(length[1])].decode("utf-8", "replace").split("\n") if end >= 0 else []
            if len(named) > 1 and named[1].strip():
                fields = named[1].split()
            elif named and named[0][:1] == "2":
                fields = ARC_FIELDS[2].split()
            own = fields
        head = _header(line, own) if end >= 0 else None
        if head is None:
            lost = at if lost is None else lost
            at = len(data) if end < 0 else end + 1
            continue
        if lost is not None:
            yield Arc(lost, {"url": ""}, data[lost:at], "damaged")
            lost = None
        length = int(head[fields[-1].lower()])
        block = data[end + 1 : end + 1 + length]
        yield Arc(at, head, block, "short" if len(block) < length else None)
        at = end + 1 + length
    if lost is not None and data[lost:].strip():
        yield Arc(lost, {"url": ""}, data[lost:], "damaged")


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the blank line, payload); no headers: (b'', block)."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[: end + 4], block[end + 4 :]
    return b"", block


def header_of(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if colon and k.strip().lower() == name.lower().encode():
            return v.strip().decode("utf-8", "replace")
    return None


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a prefix of it, as the W3C form of WARC-Date."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14] if arc_date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


RECORD = "record_id string, source long, url string, ip string, date string, type string, http binary, payload binary, digest string, size long, defect string"
_RECORD = pa.schema([("record_id", pa.string()), ("source", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("type", pa.string()), ("http", pa.binary()), ("payload", pa.binary()), ("digest", pa.string()), ("size", pa.int64()), ("defect", pa.string())])


def _parse_arc(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size, name = [], 0, path.rsplit("/", 1)[-1]
                for at, head, block, defect in arc_records(_inflate(content.as_py())):
                    http, payload = http_parts(block)
                    info = head["url"].startswith("filedesc:")
                    if not info or with_payload:
                        mark = header_of(http, SOURCE)
                        mark = mark if mark and mark.lstrip("-").isdigit() else None
                        held.append((
                            f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}')}>", int(mark) if mark else None, head["url"], head.get("ip-address", ""), warc_date(head.get("archive-date", "")),
                            "damaged" if defect == "damaged" else "warcinfo" if info else "response" if http else "resource", http if with_payload else None, payload if with_payload else None, hashlib.sha256(payload).hexdigest(), len(payload), defect,
                        ))
                        size += len(block)
                    if size >= YIELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _RECORD, strict=True)], schema=_RECORD)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _RECORD, strict=True)], schema=_RECORD)

    return run


def read_arc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """The records of ARC files, gzipped or plain; without ``payload`` only what deduplication
    needs. ``defect`` says ``short`` where a file ends within a record, and ``damaged`` for
    bytes without a readable header, which come as records of type ``damaged``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,arc}").load(path).select("path", "content")
    return files.mapInArrow(_parse_arc(payload), RECORD)


def _crlf(*lines) -> F.Column:
    return F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in lines])


def convert(spark: SparkSession, arc: str, warc: str, *, least: int = LEAST, broadcast_rows: int = 200_000) -> None:
    """Convert the ARC files under ``arc`` to gzipped WARC files under ``warc``.

    Of records with equal payloads of ``least`` bytes or more, the one with the
    smallest source id (then record id; ids that are null come last) stays what it
    is, and the others become revisits without payload. Payloads are shuffled only
    when more than ``broadcast_rows`` payloads are repeated. A short record is written with
    what there is of it, marked as truncated, and never a revisit; damaged bytes become a
    resource record of their own, so nothing is lost silently.
    """
    rank = F.struct(F.coalesce("source", F.lit(LAST_ID)).alias("source"), F.col("record_id"))
    whole = F.col("defect").isNull() & (F.col("size") >= least)
    seen = read_arc(spark, arc, payload=False).filter(whole)
    by = seen.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    firsts = written(by.filter("n > 1").select(F.col("digest").alias("_digest"), F.col("first.record_id").alias("_first")), "firsts")
    side = F.broadcast(firsts) if firsts.count() <= broadcast_rows else firsts
    rows = read_arc(spark, arc).join(side, (F.col("digest") == F.col("_digest")) & whole & (F.col("type") != "warcinfo"), "left")
    revisit = F.col("_first").isNotNull() & (F.col("_first") != F.col("record_id"))
    kind = F.when(revisit, "revisit").when(F.col("type") == "damaged", "resource").otherwise(F.col("type"))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    media = F.when(F.col("type") == "warcinfo", "application/warc-fields").when(F.col("type").isin("resource", "damaged"), "application/octet-stream").otherwise("application/http; msgtype=response")
    head = _crlf(
        "WARC/1.0\r\nWARC-Type: ", kind, "\r\nWARC-Record-ID: ", F.col("record_id"), "\r\nWARC-Date: ", F.col("date"), "\r\n",
        F.when(F.col("type") == "warcinfo", "").otherwise(_crlf("WARC-Target-URI: ", F.when(F.col("url") == "", "about:blank").otherwise(F.col("url")), "\r\nWARC-IP-Address: ", F.coalesce("ip", F.lit("")), "\r\nWARC-Payload-Digest: sha256:", F.col("digest"), "\r\n")),
        F.when(revisit, _crlf("WARC-Refers-To: ", F.col("_first"), "\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Truncated: length\r\n")).otherwise(""),
        F.when(F.col("defect") == "short", "WARC-Truncated: disconnect\r\n").otherwise(""),
        "WARC-Block-Digest: sha256:", F.sha2(block, 256), "\r\nContent-Type: ", media, "\r\nContent-Length: ", F.length(block).cast("string"), "\r\n\r\n",
    )
    value = F.concat(head.cast("binary"), block).cast("string").alias("value")
    rows.select(value).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(warc)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of every record, by declared lengths."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        start, at = end + 4, end + 4 + int(head["content-length"])
        yield head, data[start:at]


FOUND = "record_id string, type string, source long, url string, date string, refers string, digest string, size long"
_FOUND = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("source", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("size", pa.int64())])


def _parse_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            held = []
            for head, block in warc_records(_inflate(content.as_py())):
                if head["warc-type"] == "warcinfo":
                    continue
                http, payload = http_parts(block)
                mark, declared = header_of(http, SOURCE), head.get("warc-payload-digest", "").removeprefix("sha256:")
                if head["warc-type"] == "revisit":
                    digest, size = declared, int(header_of(http, "Content-Length") or 0)
                else:
                    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    if digest != declared:
                        raise ValueError(f"digest of {head['warc-record-id']} differs from its payload")
                held.append((head["warc-record-id"], head["warc-type"], int(mark) if mark else None, head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"), digest, size))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _FOUND, strict=True)], schema=_FOUND)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; digests of full payloads are checked on the way."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse_warc, FOUND)


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ARC, convert to WARC and read that back.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Defined cases: a null html is an empty payload; payloads below 100 bytes are all
    responses; of equal rows with one page_id a single one is the response; a null
    page_id stays null and ranks last; a null or empty url reads ``about:blank``,
    characters that an ARC line can't hold are percent-encoded; an empty table gives
    an empty table; other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    found = read_warc(spark, warc)
    kept = written(found, "records")
    # only revisits look for what they refer to
    again = kept.filter("type = 'revisit'")
    first = kept.filter("type <> 'revisit'").select(F.col("record_id").alias("refers"), F.col("source").alias("refers_to"))
    out = again.join(first, "refers", "left").unionByName(kept.filter("type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")))
    return out.select(F.col("source").alias("page_id"), "url", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM page),
ranked AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM ranked
"""
