"""WARC archives with a salvage reader.

archives() writes a record per page, each a gzip member of its own. Of pages
with equal payloads the smallest page_id is a response; the others are revisit
records that refer to it and carry no payload. read_archives() checks every
record. After a failed check it searches for the next valid member (or, in
plain archives, the next version line with a valid header), goes on there, and
logs the bytes between as a quarantined gap.

archives() can put damage between records, seeded by page: the head of a torn
copy, a copy whose checksum does not hold, or stray bytes that look like the
begin of a member or of a version line. Each page still comes back, by way of
the search, and gap_log() has what lay between.

Edge cases: null html counts as an empty payload, a null url as an empty one.
Rows that share page_id and payload are all responses if that page_id is the
smallest. Rows without page_id are responses, unless another page has their
payload. An empty table gives no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import stored

#: Fixed values of the format.
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
#: Bytes of payload after which an archive is closed.
ARCHIVE_BYTES = 8_000_000
#: One in so many records of the query is followed by damage, on average.
DAMAGE_EVERY = 8
#: Bytes of a member that are inflated at once.
INFLATE_BYTES = 1 << 14


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pack(headers: list[tuple[str, str]], block: bytes, compress: bool = True) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    record = b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return record
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, compress: bool = True) -> bytes:
    """The record of a page; first is the page that it revisits, None for a response."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
        ("WARC-Block-Digest", "sha1:" + digest32(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if first is not None:
        headers += [("WARC-Refers-To", name(first)), ("WARC-Profile", REVISIT)]
    return pack(headers, block, compress)


@dataclass
class Record:
    offset: int
    length: int  # in the archive
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Bytes that belong to no valid record."""

    offset: int
    length: int
    reason: str


class Damaged(Exception):
    pass


def _parse(data: bytes, start: int, ends_with_data: bool) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at start; every check that fails raises Damaged."""
    if data[start : start + len(VERSION)] not in VERSIONS:
        raise Damaged("no version line")
    cut = data.find(b"\r\n\r\n", start)
    if cut < 0:
        raise Damaged("header has no end")
    headers = {}
    for line in data[start:cut].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise Damaged("no content length")
    begin, end = cut + 4, cut + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n" or ends_with_data and end + 4 != len(data):
        raise Damaged("block does not end where it should")
    block = data[begin:end]
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha1:") and named[5:] != digest32(block):
        raise Damaged("block digest differs")
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").startswith("sha1:"):
        if headers["warc-payload-digest"][5:] != digest32(block.partition(b"\r\n\r\n")[2]):
            raise Damaged("payload digest differs")
    return headers, block, end + 4


def _record_at(data: bytes, at: int) -> Record:
    if data[at : at + 3] == MAGIC:
        z, parts, end = zlib.decompressobj(31), [], at
        try:
            while not z.eof and end < len(data):
                parts.append(z.decompress(data[end : end + INFLATE_BYTES]))
                end += INFLATE_BYTES
        except zlib.error as e:
            raise Damaged("member does not inflate") from e
        if not z.eof:
            raise Damaged("member is cut off")
        headers, block, _ = _parse(b"".join(parts), 0, True)
        return Record(at, min(end, len(data)) - len(z.unused_data) - at, headers, block)
    headers, block, end = _parse(data, at, False)
    return Record(at, end - at, headers, block)


def _candidates(data: bytes, at: int) -> Iterator[int]:
    """Places from at on where a member or a version line may begin, in order."""
    marks = (MAGIC, b"WARC/1.")
    found = {m: data.find(m, at) for m in marks}
    while places := [p for p in found.values() if p >= 0]:
        place = min(places)
        yield place
        for m in marks:
            if 0 <= found[m] <= place:
                found[m] = data.find(m, place + 1)


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive in their order; together they cover all of its bytes."""
    at = 0
    while at < len(data):
        try:
            record = _record_at(data, at)
        except Damaged as e:
            reason, begin, record = str(e), at, None
            for place in _candidates(data, at + 1):
                try:
                    record = _record_at(data, place)
                    break
                except Damaged:
                    continue
            yield Gap(begin, (record.offset if record else len(data)) - begin, reason)
            if record is None:
                return
        yield record
        at = record.offset + record.length


def with_firsts(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and first: the page that has the same payload and comes first, null for itself.

    Payloads of fewer than least bytes are never compared. Pages meet by key without their html; just the ids of later
    pages meet the pages again, so a payload that very many have moves no html.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("key"))
    slim = keyed.where(F.octet_length(payload) >= least).select("page_id", "key")
    firsts = stored(slim.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"))
    later = slim.join(firsts, "key").where(~F.col("first").eqNullSafe(F.col("page_id")))
    later = stored(later.select(F.col("page_id").alias("own"), F.col("key").alias("same"), "first").distinct())
    joined = keyed.join(later, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("same")), "left")
    return joined.select("page_id", "url", "html", "first")


def damage(page_id: int | None, record: bytes, every: int) -> bytes:
    """What stands behind a record: nothing, or bytes that are no record. The same for the same page."""
    dealt = zlib.crc32(f"damage {page_id}".encode())
    if not every or dealt % every:
        return b""
    kind = dealt // every % 3
    if kind == 0:  # torn: its deflate stream breaks off
        return record[: len(record) // 2]
    if kind == 1:  # the checksum in the last eight bytes of a member is another
        return record[:-8] + bytes(b ^ 0x55 for b in record[-8:-4]) + record[-4:]
    return MAGIC + b"stray" + VERSION + b"\r\nWARC-Type: response\r\n\r\n" + dealt.to_bytes(4, "big")


def archives(pages: DataFrame, least: int = 0, damage_every: int = 0) -> DataFrame:
    """Archives (content) with a record for every row of pages (page_id, url, html)."""
    schema = pa.schema([("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = pack([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", DATE)], b"format: WARC/1.1\r\n")
        parts, size = [info], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], schema=schema)

        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "first"))):
                payload = (html or "").encode()
                record = page_record(page_id, url, payload, first)
                parts += [record, damage(page_id, record, damage_every)]
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield out()
                    parts, size = [info], 0
        if len(parts) > 1:
            yield out()

    return with_firsts(pages, least).mapInArrow(run, "content binary")


READ = """kind string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long,
 at long, length long, reason string"""


def _row(x: Record | Gap) -> tuple | None:
    if isinstance(x, Gap):
        return ("gap", None, None, None, None, None, x.offset, x.length, x.reason)
    kind = x.headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    number = lambda v: int(v[10:-1]) if v.startswith("<urn:page:") and v[10:-1].lstrip("-").isdigit() else None
    head, _, payload = x.block.partition(b"\r\n\r\n")
    size = len(payload)
    if kind == "revisit":  # the HTTP header still tells the payload's size
        told = [line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = int(told[0].partition(b":")[2]) if told else None
    digest = x.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    refers = number(x.headers.get("warc-refers-to", ""))
    return ("record", number(x.headers.get("warc-record-id", "")), size, digest, kind, refers, x.offset, x.length, None)


def read_archives(df: DataFrame) -> DataFrame:
    """A row for each page record and each gap of the archives of df (content)."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip([c.split()[0] for c in READ.split(",")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [r for x in read_archive(content.as_py() or b"") if (r := _row(x))]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select("content").mapInArrow(run, READ)


def gap_log(df: DataFrame) -> DataFrame:
    """at, length and reason of every quarantined gap of the archives of df (content)."""
    return read_archives(df).where("kind = 'gap'").select("at", "length", "reason")
