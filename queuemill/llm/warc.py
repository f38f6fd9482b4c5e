"""WARC archives: a writer of per-record gzip members, and a reader that salvages what damage leaves.

The writer makes one record per page. Of pages with equal payloads of ``MIN_REVISIT`` bytes or more, those with
the smallest id are ``response`` records, the others ``revisit`` records without payload that refer to it. A
record's block has HTTP headers whose Content-Length is that of the full payload.

The reader checks every record: gzip member, version line, header fields, lengths, and the block's digest. After
a failed check it searches for the next gzip member (or, in plain archives, the next version line), goes on from
there, and logs the bytes between as quarantined, with the reason. A record is never half returned.

A gzip member may hold many records. After a failed check inside it the search goes on at the next version line of what
it unpacks to, also of what a damaged or cut off member unpacks to before its damage. Of these only records with a
block digest that fits are taken; where a checksum of the whole member fails, their header fields are not proved by it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.llm.storage import write_file
from queuemill.session import scratch_path

MIN_REVISIT = 100
#: Bytes after which a task begins the next archive.
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
#: Bytes given to the unpacker at a time.
FEED = 1 << 14

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
DAMAGED = "gzip member is damaged"
VERSION_LINE = re.compile(rb"^WARC/\d+\.\d+\r?$", re.M)

RECORDS = (
    "archive string, offset bigint, length bigint, record_type string, record_id string, page_id bigint, "
    "url string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, reason string"
)


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One uncompressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    name = hashlib.sha256(f"{page_id}\n{url}\n{digest}\n{refers_to}".encode()).hexdigest()[:32]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"\s", "%20", url) if url else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-X-Page-ID", page_id),
        ("WARC-X-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{key}: {value}\r\n" for key, value in fields if value is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(content: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


class Damage(ValueError):
    """Why a record was not accepted."""


def parse_record(content: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Fields, block and end of the record that begins at ``at``; raises ``Damage``."""
    head_end = content.find(b"\r\n\r\n", at)
    if not re.match(rb"WARC/\d+\.\d+\r\n", content[at : at + 16]):
        raise Damage("no version line")
    if head_end < 0:
        raise Damage("header without end")
    try:
        lines = content[at:head_end].decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        raise Damage("header is not UTF-8") from None
    fields = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon:
            raise Damage("header line without a colon")
        fields[key.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise Damage("length or type is missing")
    begin = head_end + 4
    end = begin + int(fields["content-length"])
    if end + 4 > len(content):
        raise Damage("block is cut off")
    if content[end : end + 4] != b"\r\n\r\n":
        raise Damage("length does not fit the block")
    block = content[begin:end]
    if digest_fits(fields, block) is False:
        raise Damage("block digest differs")
    return fields, block, end + 4


def digest_fits(fields: dict, block: bytes) -> bool | None:
    """None without a SHA-1 or SHA-256 digest; it may be in base 16 or 32."""
    named, _, digest = fields.get("warc-block-digest", "").partition(":")
    if named.lower() not in ("sha1", "sha256"):
        return None
    own = hashlib.new(named.lower(), block).digest()
    return digest.lower().rstrip("=") in (own.hex(), base64.b32encode(own).decode().lower().rstrip("="))


def _member_at(content: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds, where it ends, and None or its damage: what was unpacked before that."""
    unpacker, view, fed, parts = zlib.decompressobj(31), memoryview(content), at, []
    try:
        while not unpacker.eof and fed < len(content):
            parts.append(unpacker.decompress(view[fed : fed + FEED]))
            fed += FEED
    except zlib.error:
        return *_before_damage(view, at, fed), DAMAGED
    if not unpacker.eof:
        return b"".join(parts), len(content), "gzip member is cut off"
    return b"".join(parts), min(fed, len(content)) - len(unpacker.unused_data), None


def _before_damage(view: memoryview, at: int, failed: int) -> tuple[bytes, int]:
    """The member at ``at`` up to its damage, which is in the bytes fed at ``failed``: these are fed one by one."""
    unpacker, parts = zlib.decompressobj(31), []
    for fed in range(at, failed, FEED):
        parts.append(unpacker.decompress(view[fed : fed + FEED]))
    end = failed
    try:
        while True:
            parts.append(unpacker.decompress(view[end : end + 1]))
            end += 1
    except zlib.error:
        return b"".join(parts), end


def _records(data: bytes, damage: str | None) -> tuple[list[tuple[dict, bytes]], list[str]]:
    """Sound records of an unpacked member, and a reason for each gap. With ``damage`` only those whose digest fits; as no
    digest covers a header, those right before damage are not taken then, unless the member is just cut off."""
    at, records, gaps, sound = 0, [], [], True
    while at < len(data):
        try:
            fields, block, end = parse_record(data, at)
            if damage and not digest_fits(fields, block):
                raise Damage("record of a damaged member without a digest")
            records.append((fields, block))
            at, sound = end, True
        except Damage as why:
            if sound:
                gaps.append(str(why))
                if damage == DAMAGED and records:
                    records.pop()
            sound = False
            line = VERSION_LINE.search(data, at + 1)
            at = line.start() if line else len(data)
    return records[:-1] if damage == DAMAGED and sound else records, gaps


def salvage(content: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str | None]]:
    """Begin, end, fields, block and None for each sound record; begin, end, None, b"" and the reason for
    each gap. Offsets are those of the archive file. Together they cover every byte. Records of one member have its
    offsets, and so has a gap inside it; a damaged member is part of a gap as a whole, also where records came from it."""
    packed = content.startswith(MEMBER) or (MEMBER in content and not VERSION_LINE.match(content))
    at, gap, reason = 0, 0, ""

    def next_start(begin: int) -> int:
        if packed:
            found = content.find(MEMBER, begin)
        else:
            line = VERSION_LINE.search(content, begin)
            found = line.start() if line else -1
        return len(content) if found < 0 else found

    while at < len(content):
        try:
            if packed:
                data, end, damage = _member_at(content, at)
                records, gaps = _records(data, damage)
                if damage:
                    for fields, block in records:
                        yield at, end, fields, block, None
                    raise Damage(damage)
                if gaps and not records:
                    raise Damage(gaps[0])
            else:
                fields, block, end = parse_record(content, at)
                records, gaps = [(fields, block)], []
        except Damage as why:
            reason = reason or str(why)
            at = next_start(at + 1)
            continue
        if gap < at:
            yield gap, at, None, b"", reason
        for fields, block in records:
            yield at, end, fields, block, None
        for why in gaps:
            yield at, end, None, b"", why
        at = gap = end
        reason = ""
    if gap < at:
        yield gap, at, None, b"", reason


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _described(archive: str, found: tuple, with_payload: bool) -> dict:
    begin, end, fields, block, reason = found
    row = {"archive": archive, "offset": begin, "length": end - begin, "reason": reason}
    if fields is None:
        return row
    head, _, payload = block.partition(b"\r\n\r\n")
    full = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    revisit = fields["warc-type"] == "revisit"
    return row | {
        "record_type": fields["warc-type"],
        "record_id": fields.get("warc-record-id"),
        "page_id": _number(fields.get("warc-x-page-id")),
        "url": fields.get("warc-target-uri"),
        "refers_to": _number(fields.get("warc-x-refers-to-page-id")),
        "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2].lower()
        if revisit
        else hashlib.sha256(payload).hexdigest(),
        "payload_bytes": int(full[1]) if revisit and full else len(payload),
        "payload": payload if with_payload and not revisit else None,
    }


SCHEMA = pa.schema(
    [
        (name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[kind])
        for name, kind in (field.split() for field in RECORDS.split(", "))
    ]
)
BATCH = 256


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every sound record of the archives below ``path``, and every quarantined gap.

    Gaps are the rows with a ``reason``; they have offset and length only. Digests and lengths of responses are
    those of the payload read, not those that the header claims. Archives are read whole, one at a time; they
    should be of some hundred megabytes at most, as the writer's are.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for found in salvage(content.as_py()):
                    rows.append(_described(name, found, with_payload))
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "content").mapInArrow(read, RECORDS)


def with_references(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html`` with ``digest`` of the payload and ``first_id``: for payloads of ``min_bytes``
    or more that several pages have, the smallest page id. NULL ids are never referred to."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(payload, 256))
    large = pages.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select(F.col("digest").alias("_digest"), "first_id")
    return pages.join(firsts, F.col("digest") == F.col("_digest"), "left").drop("_digest")


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html; others are left out) and return one row per
    archive. A NULL html is an empty payload; all rows of the smallest page id of a group are responses."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, members = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal number, held, members
            name = f"part-{task:08d}-{number:06d}.warc.gz"
            write_file(folder, name, b"".join(members))
            row = pa.RecordBatch.from_pydict(
                {"archive": [name], "records": pa.array([len(members)], pa.int64()), "bytes": pa.array([held], pa.int64())}
            )
            number, held, members = number + 1, 0, []
            return row

        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
                revisit = first is not None and first != page_id
                content = record(page_id, url, (html or "").encode(), digest, first if revisit else None, revisit)
                members.append(_member(content))
                held += len(members[-1])
                if held >= archive_bytes:
                    yield flush()
        if members:
            yield flush()

    rows = with_references(pages, min_bytes).select("page_id", "url", "html", "digest", "first_id")
    done = rows.mapInArrow(write, "archive string, records bigint, bytes bigint")
    done.write.parquet(f"{folder}-archives")
    return pages.sparkSession.read.schema("archive string, records bigint, bytes bigint").parquet(f"{folder}-archives")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages, read the archives back; one row per sound record, without payloads."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    written = write_warc(pages, folder)
    if written.isEmpty():
        return spark.createDataFrame([], RECORDS)
    return read_warc(spark, folder, with_payload=False).filter(F.col("reason").isNull())


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when first_id <> coalesce(page_id, first_id + 1) then 'revisit' else 'response' end as record_type,
       case when first_id <> coalesce(page_id, first_id + 1) then first_id end as refers_to
from f
"""
