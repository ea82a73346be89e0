"""Media columns: MPEG transport streams that carry a payload losslessly.

write_streams() packs a payload into access units: each is one elementary
packet (PES) with a time stamp, cut into 188-byte transport packets. Program
tables (PAT, PMT) stand before every random-access point. read_streams() parses
the tables, checks continuity counters and table checksums, reassembles the
elementary packets and stores time stamps with random-access points.

Edge cases: a null text counts as empty and its payload is one block of spaces;
equal texts give equal streams; repeated rows give equal rows; an empty table
gives an empty table; other columns are not read. In a stream with lost, damaged
or foreign bytes the next three packets in a row are searched for and faults are
counted; of other streams than program maps name, packets are counted as skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilwork.llm.common import utf8_of

PACKET = 188
SYNC = 0x47
BLOCK = 192  # a payload is a positive multiple of so many bytes
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0x0000, 0x0100, 0x0101, 0x1FFF
PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 1, 0x06, 0xBD
PES_HEADER = 14
FIRST_ROOM = PACKET - 12 - PES_HEADER  # data in a unit's first packet, beside its clock reference
UNIT_PACKETS = 17
UNIT = FIRST_ROOM + (UNIT_PACKETS - 1) * (PACKET - 4)  # bytes of data in a full access unit
UNIT_TICKS = 3600  # of the 90 kHz clock: 25 units a second
FIRST_TICKS = 90_000
ACCESS_EVERY = 8  # units from one random-access point to the next


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


def crc32_mpeg(data: bytes) -> int:
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big")
    section = head + b"\xc1\x00\x00" + body
    return section + crc32_mpeg(section).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet.ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pid = (0xE000 | DATA_PID).to_bytes(2, "big")
    pmt = _section(0x02, PROGRAM, pid + b"\xf0\x00" + bytes([PRIVATE_DATA]) + pid + b"\xf0\x00")
    both = _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)
    return np.frombuffer(both, np.uint8).reshape(2, PACKET)


def _unit_start(unit: int, size: int) -> tuple[bytes, bytes]:
    """Adaptation field with clock reference, and PES header, of an access unit that has size bytes of data."""
    ticks = FIRST_TICKS + unit * UNIT_TICKS
    clock = (ticks << 15 | 0x3F << 9).to_bytes(6, "big")
    stamp = (0x2100010001 | (ticks >> 30 & 7) << 33 | (ticks >> 15 & 0x7FFF) << 17 | (ticks & 0x7FFF) << 1).to_bytes(5, "big")
    flags = 0x50 if unit % ACCESS_EVERY == 0 else 0x10
    header = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (size + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp
    return bytes([flags]) + clock, header


def _last_unit(data: bytes, unit: int) -> np.ndarray:
    """Packets of a unit that is not full; stuffing in adaptation fields fills them."""
    field_, header = _unit_start(unit, len(data))
    body, out, first = header + data, [], True
    while body:
        most = PACKET - 4 - (1 + len(field_) if first else 0)
        take, body = body[:most], body[most:]
        spare = most - len(take)
        control = bytes([SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 0xFF])
        if first:
            packet = control + b"\x30" + bytes([len(field_) + spare]) + field_ + b"\xff" * spare + take
        elif spare:
            stuffing = b"" if spare == 1 else b"\x00" + b"\xff" * (spare - 2)
            packet = control + b"\x30" + bytes([spare - 1]) + stuffing + take
        else:
            packet = control + b"\x10" + take
        out.append(packet)
        first = False
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, PACKET)


def _full_units(data: np.ndarray) -> np.ndarray:
    """Packets of full units; data has a row for each."""
    n = len(data)
    packets = np.empty((n, UNIT_PACKETS, PACKET), np.uint8)
    packets[:, :, :4] = (SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x10)
    packets[:, 0, 1] |= 0x40
    packets[:, 0, 3] = 0x30
    packets[:, 0, 4] = 7
    starts = b"".join(b"".join(_unit_start(u, UNIT)) for u in range(n))
    packets[:, 0, 5 : 12 + PES_HEADER] = np.frombuffer(starts, np.uint8).reshape(n, 7 + PES_HEADER)
    packets[:, 0, 12 + PES_HEADER :] = data[:, :FIRST_ROOM]
    packets[:, 1:, 4:] = data[:, FIRST_ROOM:].reshape(n, UNIT_PACKETS - 1, PACKET - 4)
    return packets


def write_stream(payload: bytes) -> bytes:
    n_full, rest = divmod(len(payload), UNIT)
    full = _full_units(np.frombuffer(payload, np.uint8, n_full * UNIT).reshape(n_full, UNIT))
    last = _last_unit(payload[n_full * UNIT :], n_full) if rest or not n_full else None
    parts = []
    for unit in range(0, n_full, ACCESS_EVERY):
        parts += [_tables(), full[unit : unit + ACCESS_EVERY].reshape(-1, PACKET)]
    if last is not None:
        parts += [_tables(), last] if n_full % ACCESS_EVERY == 0 else [last]
    stream = np.concatenate(parts)
    pids = (stream[:, 1].astype(np.int32) & 0x1F) << 8 | stream[:, 2]
    for pid in (PAT_PID, PMT_PID, DATA_PID):
        own = np.flatnonzero(pids == pid)
        stream[own, 3] |= (np.arange(len(own)) & 15).astype(np.uint8)
    return stream.tobytes()


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, int] = field(default_factory=dict)  # program number: PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # PID: stream type
    packets: int = 0
    lost_sync: int = 0
    table_errors: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    short_units: int = 0
    skipped: int = 0  # packets of PIDs that no table names, but for null packets
    payload: bytes = b""
    #: (time stamp, place of the unit in the payload, is a random-access point) of every unit
    units: list[tuple[int | None, int, bool]] = field(default_factory=list)


def _read_tables(packets: np.ndarray, begins: np.ndarray, own: np.ndarray, table_id: int, out: Stream) -> Iterator[bytes]:
    """Bodies of the distinct sections in the packets own that pass their checksum; a section may go on over packets."""
    seen: dict[bytes, bytes | None] = {}

    def section(data: bytes) -> None:
        if data not in seen:
            size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF) if len(data) >= 3 else 0
            good = 12 <= size <= len(data) and data[0] == table_id and crc32_mpeg(data[:size]) == 0
            seen[data] = data[:size] if good else None
        out.table_errors += seen[data] is None

    open_section = None
    for i in own.tolist():
        data = packets[i, begins[i] :].tobytes()
        if packets[i, 1] & 0x40:
            pointer = data[0] if data else 0
            if open_section is not None:
                section(open_section + data[1 : 1 + pointer])
            open_section = data[1 + pointer :]
        elif open_section is not None:
            open_section += data
    if open_section is not None:
        section(open_section)
    yield from (s[8:-4] for s in seen.values() if s is not None)


def _packets(media: bytes, out: Stream) -> np.ndarray:
    """Whole packets; where one has no packet behind it, the next place is searched where three begin in a row."""
    data = np.frombuffer(media, np.uint8)
    whole = len(data) // PACKET * PACKET
    if whole == len(data) and (data[::PACKET] == SYNC).all():
        return data.reshape(-1, PACKET)
    sync = np.r_[data == SYNC, np.ones(2 * PACKET, bool)]  # behind the end all is well
    n = max(0, len(data) - PACKET + 1)
    two = sync[:n] & sync[PACKET : PACKET + n]
    three = np.flatnonzero(two & sync[2 * PACKET : 2 * PACKET + n])
    starts, at = [], 0
    while at < n:
        # as far as packets follow each other
        row = two[at::PACKET]
        run = int(np.argmin(row)) if not row.all() else len(row)
        starts.append(at + PACKET * np.arange(run))
        at += PACKET * run
        if at >= n:
            break
        out.lost_sync += 1
        k = int(np.searchsorted(three, at + 1))
        at = int(three[k]) if k < len(three) else len(data)
    out.lost_sync += at < len(data)
    found = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return data[found[:, None] + np.arange(PACKET)]


def read_stream(media: bytes) -> Stream:
    out = Stream()
    packets = _packets(media, out)
    out.packets = len(packets)
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    has_field, has_data = (packets[:, 3] & 0x20) > 0, (packets[:, 3] & 0x10) > 0
    begins = np.where(has_field, 5 + packets[:, 4].astype(np.int32), 4)
    begins = np.where(has_data, np.minimum(begins, PACKET), PACKET)

    def of_pid(pid: int) -> np.ndarray:
        """Packets with data of a PID without repeated ones; counts breaks of the counter."""
        own = np.flatnonzero((pids == pid) & has_data)
        if len(own) > 1:
            counter = packets[own, 3] & 15
            step = (counter[1:] - counter[:-1]) & 15
            again = step == 0
            out.duplicates += int(again.sum())
            jump = (packets[own[1:], 4] > 0) & has_field[own[1:]] & ((packets[own[1:], 5] & 0x80) > 0)
            out.continuity_errors += int((~again & (step != 1) & ~jump).sum())
            own = own[np.r_[True, ~again]]
        return own

    for body in _read_tables(packets, begins, of_pid(PAT_PID), 0x00, out):
        for k in range(0, len(body) - 3, 4):
            if number := int.from_bytes(body[k : k + 2], "big"):
                out.programs[number] = int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF
    for pid in dict.fromkeys(out.programs.values()):
        for body in _read_tables(packets, begins, of_pid(pid), 0x02, out):
            k = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while k + 5 <= len(body):
                out.streams[int.from_bytes(body[k + 1 : k + 3], "big") & 0x1FFF] = body[k]
                k += 5 + (int.from_bytes(body[k + 3 : k + 5], "big") & 0xFFF)
    known = np.array([PAT_PID, NULL_PID, *out.programs.values(), *out.streams])
    out.skipped = int((~np.isin(pids, known)).sum())
    data, at = [], 0
    for pid in out.streams:
        own = of_pid(pid)
        mine = packets[own]
        bytes_ = mine[np.arange(PACKET) >= begins[own][:, None]].tobytes()
        ends = np.cumsum(PACKET - begins[own])
        heads = np.flatnonzero((mine[:, 1] & 0x40) > 0)
        starts = (ends - (PACKET - begins[own]))[heads].tolist()
        access = (has_field[own] & (mine[:, 4] > 0) & ((mine[:, 5] & 0x40) > 0))[heads].tolist()
        for a, b, point in zip(starts, [*starts[1:], len(bytes_)], access):
            unit = bytes_[a:b]
            if unit[:3] != b"\x00\x00\x01" or len(unit) < 9:
                out.short_units += 1
                continue
            size = 6 + int.from_bytes(unit[4:6], "big") if any(unit[4:6]) else len(unit)  # 0: up to the next one
            out.short_units += size > len(unit)
            stamp = None
            if unit[7] & 0x80 and len(unit) >= PES_HEADER:
                x = int.from_bytes(unit[9:14], "big")
                stamp = (x >> 33 & 7) << 30 | (x >> 17 & 0x7FFF) << 15 | x >> 1 & 0x7FFF
            out.units.append((stamp, at, point))
            data.append(unit[9 + unit[8] : size])
            at += len(data[-1])
    out.payload = b"".join(data)
    return out


def feature_of(s: Stream) -> str:
    stamps = [t for t, _, _ in s.units if t is not None]
    steps = len({b - a for a, b in zip(stamps, stamps[1:])})
    points = ";".join(f"{t}@{at}" for t, at, point in s.units if point)
    programs = ",".join(f"{n}:{p}" for n, p in sorted(s.programs.items()))
    streams = ",".join(f"{p}:{k}" for p, k in sorted(s.streams.items()))
    span = f"{min(stamps)}-{max(stamps)}" if stamps else "-"
    return (
        f"programs={programs} streams={streams} packets={s.packets} units={len(s.units)} stamps={span} steps={steps} "
        f"lost_sync={s.lost_sync} table_errors={s.table_errors} continuity_errors={s.continuity_errors} "
        f"duplicates={s.duplicates} short_units={s.short_units} skipped={s.skipped} access={zlib.crc32(points.encode()):08x}/{points.count('@')}"
    )


def padded(text: bytes) -> bytes:
    """The payload of a text: spaces fill it up to a positive multiple of BLOCK bytes."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def write_streams(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary): the text of every row of df (doc_id, text) as a transport stream."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_of(batch)
            media = pa.array([write_stream(padded(t)) for t in texts], pa.binary())
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, media], schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = """doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,
 media_sha256 string, feature string, access_points array<struct<stamp: long, place: long>>"""


def read_streams(df: DataFrame) -> DataFrame:
    """Digests, features and random-access points of every stream of df (doc_id, n_bytes, media)."""
    point = pa.struct([("stamp", pa.int64()), ("place", pa.int64())])
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.list_(point)]
    names = [c.split()[0] for c in READ.replace("array<struct<stamp: long, place: long>>", "points").split(",")]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                s = read_stream(media)
                rows.append(
                    (
                        len(s.payload),
                        hashlib.sha256(s.payload).hexdigest(),
                        zlib.crc32(s.payload[-16:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        feature_of(s),
                        [{"stamp": t, "place": at} for t, at, access in s.units if access],
                    )
                )
            columns = [batch.column("doc_id"), batch.column("n_bytes")]
            columns += [pa.array([r[k] for r in rows], kinds[2 + k]) for k in range(7)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)
