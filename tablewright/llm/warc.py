"""WARC archives: a writer on Spark's text sink and a salvage reader.

Writing. One record per row. Records with equal payloads become one ``response`` (the smallest id) and ``revisit`` records
that name it. Each record is a gzip member of its own. Spark's committed text sink puts the members into files, so a lost
executor leaves no half-written archive; the sink's line separator is an empty gzip member, which any gzip reader skips.

Reading. Members are checked one by one (gzip checksum, version line, header block, block length, payload digest). After a
failed check the reader searches for the next valid member, or in plain archives for the next version line that starts a
valid record, goes on from there, and logs the byte gap it left out with the reason. Nothing in a gap is returned.

Rules: null payload counts as empty. Rows that repeat the smallest id with an equal payload are all responses. A null id is
written as an empty id, larger than any other, and read back as null. Extra columns are not written. An empty table gives
no archive records. Long payloads are read whole within one task, file by file; ``RECORDS_PER_FILE`` keeps files small.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import small_side, stored
from tablewright.session import scratch_dir

RECORDS_PER_FILE = 5000
_FEED = 1 << 14
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"[0-9]{1,18}")
_END = b"\r\n\r\n"
#: An empty gzip member: what the text sink puts after each record.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
RECORD_SCHEMA = (
    "file string, start long, bytes long, reason string, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hex digits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_record_types(pages: DataFrame, page_id: str, payload: str, url: str | None, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses). Payloads below ``least`` bytes are never revisits."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        (F.col(url) if url else F.lit(None)).cast("string").alias("url"),
        body.alias("payload"),
    ).withColumns({"digest": base32_sha1(F.col("payload")), "size": F.length("payload")})
    shared = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    shared = stored(shared.filter((F.col("n") > 1) & (F.col("size") >= least)).drop("n"), "warc-shared")
    return rows.join(small_side(shared), ["digest", "size"], "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    )


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record_bytes(rows: DataFrame) -> Column:
    """One WARC record as binary, without compression."""
    revisit = F.col("refers_to").isNotNull()
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(VERSION.decode()),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), ident, F.lit(">"))),
        _line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1f]+", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(""),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(head.cast("binary"), block, F.lit(_END))


def _gzip_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = []
        for record in batch.column(0):
            packer = zlib.compressobj(4, zlib.DEFLATED, 31)
            members.append(packer.compress(record.as_py()) + packer.flush())
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", payload: str = "html", url: str | None = "url",
    least: int = 0, per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write gzip archives of at most ``per_file`` records each below ``path``."""
    rows = with_record_types(pages, page_id, payload, url, least)
    members = rows.select(record_bytes(rows).alias("record")).mapInArrow(_gzip_members, "member binary")
    (
        members.select(F.col("member").cast("string"))
        .write.option("maxRecordsPerFile", per_file)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .text(path)
    )


@dataclass
class Found:
    """A record (reason None) or a quarantined gap of a file."""

    start: int
    end: int
    reason: str | None = None
    head: dict[bytes, bytes] | None = None
    block: bytes = b""


def parse_record(data: bytes, start: int) -> tuple[Found | None, str]:
    """The record that starts here, or why there is none."""
    if not _VERSION_LINE.match(data, start):
        return None, "no version line"
    end = data.find(_END, start)
    if end < 0:
        return None, "header block has no end"
    head = {}
    for line in data[start:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, "header line without colon"
        head[name.strip().lower()] = value.strip()
    if not _LENGTH.fullmatch(head.get(b"content-length", b"")):
        return None, "no content length"
    first = end + len(_END)
    last = first + int(head[b"content-length"])
    if data[last : last + len(_END)] != _END:
        return None, "block length does not lead to a record end"
    block = data[first:last]
    told = head.get(b"warc-payload-digest", b"")
    if head.get(b"warc-type") == b"response" and told.startswith(b"sha1:"):
        if base64.b32encode(hashlib.sha1(block).digest()) != told[5:]:
            return None, "payload digest differs"
    return Found(start, last + len(_END), None, head, block), ""


def _salvage_plain(data: bytes) -> Iterator[Found]:
    at = 0
    while at < len(data):
        found, reason = parse_record(data, at)
        begin = at
        while found is None:
            mark = _VERSION_LINE.search(data, at + 1)
            if mark is None:
                yield Found(begin, len(data), reason)
                return
            at = mark.start()
            found, _ = parse_record(data, at)
        if at > begin:
            yield Found(begin, at, reason)
        yield found
        at = found.end


def _member(data: bytes, start: int) -> tuple[bytes, int] | None:
    """The checked content of the gzip member at ``start`` and the position after it."""
    reader, view, at, content = zlib.decompressobj(31), memoryview(data), start, []
    try:
        while not reader.eof and at < len(data):
            content.append(reader.decompress(view[at : at + _FEED]))
            at = min(at + _FEED, len(data))
    except zlib.error:
        return None
    return (b"".join(content), at - len(reader.unused_data)) if reader.eof else None


def _salvage_gzip(data: bytes) -> Iterator[Found]:
    at, gap, reason = 0, None, ""
    while at < len(data):
        found, why, end = None, "not a valid gzip member", -1
        if data.startswith(MAGIC, at) and (got := _member(data, at)):
            content, end = got
            if not content:  # a separator
                if gap is None:
                    at = end
                    continue
                found = Found(at, end)
            else:
                found, why = parse_record(content, 0)
                if found and found.end != len(content):
                    found, why = None, "bytes after the record"
        if found is None:
            if gap is None:
                gap, reason = at, why
            # a member whose own checks passed is skipped whole; otherwise the next magic number may start one
            at = end if end > at else data.find(MAGIC, at + 1)
            if at < 0:
                break
            continue
        if gap is not None:
            yield Found(gap, at, reason)
            gap = None
        if found.head is not None:
            found.start, found.end = at, end
            yield found
        at = end
    if gap is not None:
        yield Found(gap, len(data), reason)


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of one archive, in order; gzip or plain is told by whichever valid start comes first."""
    zipped, plain = data.find(MAGIC), _VERSION_LINE.search(data)
    if zipped >= 0 and (plain is None or zipped < plain.start()):
        return _salvage_gzip(data)
    return _salvage_plain(data)


def _urn(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?[0-9]{1,19})>", value or b"")
    return int(found[1]) if found else None


def _reader(payloads: bool):
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in RECORD_SCHEMA.split(", ")])

    def row(path: str, x: Found) -> tuple:
        at = (path, x.start, x.end - x.start, x.reason)
        if x.head is None:
            return (*at, *[None] * 7)
        size = x.head.get(b"x-payload-length") or x.head[b"content-length"]
        return (
            *at,
            _urn(x.head.get(b"warc-record-id")),
            x.head.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
            x.head.get(b"warc-type", b"").decode("utf-8", "replace"),
            len(x.block) if x.head.get(b"warc-type") == b"response" else int(size) if _LENGTH.fullmatch(size) else None,
            x.head.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:"),
            _urn(x.head.get(b"warc-refers-to")),
            x.block if payloads else None,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for found in salvage(content.as_py()):
                    rows.append(row(path.as_py(), found))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return read


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (reason is null) and quarantined gaps (reason says which check failed) of all archives below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(payloads), RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_archives(pages, path, least=least)
    records = read_archives(spark, path, payloads=False).filter("reason IS NULL")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
