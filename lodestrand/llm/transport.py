"""Media columns: MPEG transport streams.

`multiplex` stores a payload in a transport stream of one program: a program association table, a
program map, and a private elementary stream whose packetised units carry presentation times and
random-access marks. `demultiplex` reads any transport stream: it parses the program tables, checks
continuity counters, reassembles elementary packets and lists their times and access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, id_text, materialise

PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0, 0x1000, 0x0100, 0x1FFF
PRIVATE_STREAM = 0xBD
PRIVATE_DATA = 0x06
#: Bytes of one access unit, ticks between two (25 a second of a 90 kHz clock), units to a random access.
UNIT_BYTES, UNIT_TICKS, UNITS_PER_ACCESS = 4096, 3600, 8
FIRST_TICK = 90_000
BLOCK = 64


class TransportError(ValueError):
    """Bytes that are no transport stream."""


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        high = (table >> np.uint64(31)) & np.uint64(1)
        table = ((table << np.uint64(1)) ^ (high * np.uint64(0x04C11DB7))) & np.uint64(0xFFFFFFFF)
    return table


_CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its own CRC."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big")
    data = head + extension.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return data + section_crc(data).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(
    PMT_PID,
    _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _clock(marker: int, ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes([marker << 4 | (ticks >> 30) << 1 | 1]) + ((ticks >> 15 & 0x7FFF) << 1 | 1).to_bytes(2, "big") + ((ticks & 0x7FFF) << 1 | 1).to_bytes(2, "big")


def _read_clock(data: bytes, at: int) -> int:
    return (data[at] >> 1 & 7) << 30 | (int.from_bytes(data[at + 1 : at + 3], "big") >> 1) << 15 | int.from_bytes(data[at + 3 : at + 5], "big") >> 1


def multiplex(payload: bytes, unit_bytes: int = UNIT_BYTES, access_every: int = UNITS_PER_ACCESS) -> bytes:
    """Store bytes in a transport stream; the program tables are repeated before each access point."""
    out: list[bytes] = []
    counter = tables = 0
    for k, at in enumerate(range(0, max(len(payload), 1), unit_bytes)):
        ticks = FIRST_TICK + k * UNIT_TICKS
        access = k % access_every == 0
        if access:
            for packet in (_PAT, _PMT):
                out.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
            tables += 1
        unit = payload[at : at + unit_bytes]
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _clock(2, ticks) + unit
        # The first packet has the clock reference; the last is stuffed to its full length.
        reference = (ticks & (1 << 33) - 1) << 15 | 0x3F << 9
        field_ = bytes([0x50 if access else 0x10]) + reference.to_bytes(6, "big")
        first, place = True, 0
        while place < len(data):
            room = PACKET - 4 - (8 if first else 0)
            part = data[place : place + room]
            short = room - len(part)
            if first:
                adaptation = bytes([7 + short]) + field_ + b"\xff" * short
            elif short:
                adaptation = bytes([short - 1]) + (b"\x00" + b"\xff" * (short - 2) if short > 1 else b"")
            else:
                adaptation = b""
            flags = (0x30 if adaptation else 0x10) | counter & 15
            out.append(bytes([SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 0xFF, flags]) + adaptation + part)
            counter += 1
            place += len(part)
            first = False
    return b"".join(out)


@dataclass
class Unit:
    """One reassembled elementary packet."""

    pid: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    packet: int
    payload: bytes


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    lost_sync: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    bad_sections: int = 0
    transport_errors: int = 0
    gaps: int = 0
    repeats: int = 0
    broken_units: int = 0
    clocks: list[int] = field(default_factory=list)
    units: list[Unit] = field(default_factory=list)

    def payload(self, pid: int | None = None) -> bytes:
        return b"".join(u.payload for u in self.units if pid is None or u.pid == pid)


def _aligned(data: bytes) -> tuple[np.ndarray, int]:
    """The packets as rows, and the bytes skipped to find them."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) // PACKET
    if len(raw) == n * PACKET and n and (raw[::PACKET] == SYNC).all():
        return raw.reshape(n, PACKET), 0
    rows, at, skipped = [], 0, 0
    while at + PACKET <= len(raw):
        if raw[at] == SYNC and (at + PACKET == len(raw) or at + PACKET > len(raw) - 1 or raw[at + PACKET] == SYNC):
            rows.append(raw[at : at + PACKET])
            at += PACKET
        else:
            step = np.flatnonzero(raw[at + 1 :] == SYNC)
            hop = int(step[0]) + 1 if len(step) else len(raw) - at
            skipped += hop
            at += hop
    if not rows:
        raise TransportError("no sync bytes at the distance of packets")
    return np.stack(rows), skipped + len(raw) - at


def _sections(parts: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    held = b""
    for begins, part in parts:
        if begins and part:
            tail, fresh = part[1 : 1 + part[0]], part[1 + part[0] :]
            held += tail
            yield from _whole_sections(held)
            held = fresh
        else:
            held += part
    yield from _whole_sections(held)


def _whole_sections(held: bytes) -> Iterator[bytes]:
    while len(held) >= 3 and held[0] != 0xFF:
        n = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
        if len(held) < n:
            return
        yield held[:n]
        held = held[n:]


def demultiplex(data: bytes) -> Stream:
    """Parse a transport stream; damage is counted, not raised, unless nothing is readable."""
    rows, skipped = _aligned(data)
    found = Stream(packets=len(rows), lost_sync=skipped)
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    begins = rows[:, 1] & 0x40 != 0
    broken = rows[:, 1] & 0x80 != 0
    control = rows[:, 3] >> 4 & 3
    count = rows[:, 3] & 15
    has_field = control & 2 != 0
    size = np.where(has_field, rows[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(has_field & (size > 1), rows[:, 5], 0)
    offset = 4 + size
    has_payload = (control & 1 != 0) & (offset < PACKET) & ~broken
    found.transport_errors = int(broken.sum())
    for i in np.flatnonzero((flags & 0x10 != 0) & (size >= 8)):
        found.clocks.append(int.from_bytes(rows[i, 6:12].tobytes(), "big") >> 15)
    raw = rows.tobytes()
    usable: dict[int, list[int]] = {}
    for p in np.unique(pid):
        if p == NULL_PID:
            continue
        at = np.flatnonzero((pid == p) & has_payload)
        if not len(at):
            continue
        step = (count[at][1:].astype(np.int64) - count[at][:-1]) & 15
        jump = flags[at][1:] & 0x80 != 0
        same = np.array([raw[a * PACKET + 4 : (a + 1) * PACKET] == raw[b * PACKET + 4 : (b + 1) * PACKET] if s == 0 else False for a, b, s in zip(at[:-1], at[1:], step, strict=True)], bool)
        found.repeats += int(same.sum())
        found.gaps += int(((step != 1) & ~jump & ~same).sum())
        usable[int(p)] = [int(a) for a in at[np.concatenate([[True], ~same])]]

    def part(i: int) -> bytes:
        return raw[i * PACKET + int(offset[i]) : (i + 1) * PACKET]

    def tables(p: int, table_id: int) -> Iterator[bytes]:
        for section in _sections([(bool(begins[i]), part(i)) for i in usable.get(p, [])]):
            if len(section) < 12 or section_crc(section):
                found.bad_sections += 1
            elif section[0] == table_id and section[5] & 1:
                yield section

    for section in tables(PAT_PID, 0):
        for at in range(8, len(section) - 4, 4):
            number, target = int.from_bytes(section[at : at + 2], "big"), int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
            if number:
                found.programs[number] = target
    for number, target in sorted(found.programs.items()):
        for section in tables(target, 2):
            if int.from_bytes(section[3:5], "big") != number:
                continue
            at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while at + 5 <= len(section) - 4:
                found.streams[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
                at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)
    for p in sorted(found.streams):
        held: list[bytes] = []
        start = -1
        for i in [*usable.get(p, []), -1]:
            if i < 0 or begins[i]:
                if start >= 0:
                    unit = _unit(p, b"".join(held), bool(flags[start] & 0x40), start)
                    if unit is None:
                        found.broken_units += 1
                    else:
                        found.units.append(unit)
                held, start = [], i
            if i >= 0 and start >= 0:
                held.append(part(i))
    return found


def _unit(pid: int, data: bytes, access: bool, packet: int) -> Unit | None:
    if len(data) < 9 or data[:3] != b"\x00\x00\x01" or data[6] & 0xC0 != 0x80:
        return None
    declared = int.from_bytes(data[4:6], "big")
    if declared and len(data) < 6 + declared:
        return None
    marks = data[7] >> 6
    pts = _read_clock(data, 9) if marks & 2 else None
    dts = _read_clock(data, 14) if marks == 3 else pts
    return Unit(pid, data[3], pts, dts, access, packet, data[9 + data[8] : 6 + declared if declared else len(data)])


def describe(stream: Stream) -> str:
    """The features of a stream in one line; `marks` is a digest of all units' time stamps, packets and access."""
    times = [u.pts for u in stream.units if u.pts is not None]
    access = [u.pts for u in stream.units if u.random_access]
    marks = hashlib.sha256(repr([(u.pts, u.packet, u.random_access) for u in stream.units]).encode()).hexdigest()
    streams = ",".join(f"{p:#06x}:{kind:#04x}" for p, kind in sorted(stream.streams.items()))
    return (
        f"packets={stream.packets};programs={len(stream.programs)};streams={streams};units={len(stream.units)};"
        f"gaps={stream.gaps};repeats={stream.repeats};bad_sections={stream.bad_sections};broken_units={stream.broken_units};"
        f"pts={times[0] if times else ''}-{times[-1] if times else ''};access={len(access)}:{','.join(map(str, access))};marks={marks}"
    )


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """Zeros up to a positive multiple of `block`."""
    return data + bytes(max(block, -(-len(data) // block) * block) - len(data))


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of transport streams, one for each row: doc_id, n_bytes, media.

    A null text is empty; equal texts give equal streams. Extra columns go.
    """
    bounded_batches(docs.sparkSession)

    def make(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = text.encode("utf-8")
            yield doc_id, len(data), multiplex(pad(data))

    return id_text(docs, id_col, text_col).mapInArrow(arrow_rows(make, STORED, 512), "doc_id long, n_bytes long, media binary")


FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def features(stored: DataFrame) -> DataFrame:
    """Read stored streams back: digests of payload and stream, and what the stream holds."""
    bounded_batches(stored.sparkSession)

    def make(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            stream = demultiplex(media)
            payload = stream.payload()
            yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), describe(stream)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        arrow_rows(make, FEATURES), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


UNITS = pa.schema(
    [("doc_id", pa.int64()), ("pid", pa.int32()), ("unit", pa.int32()), ("stream_id", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("first_packet", pa.int64()), ("n_bytes", pa.int64())]
)


def units(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The index of a column of transport streams: a row for each elementary packet.

    Null or unreadable streams have no rows.
    """
    bounded_batches(stored.sparkSession)

    def make(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                found = demultiplex(media or b"").units
            except TransportError:
                continue
            for k, u in enumerate(found):
                yield doc_id, u.pid, k, u.stream_id, u.pts, u.dts, u.random_access, u.packet, len(u.payload)

    return stored.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{media_col}`")).mapInArrow(
        arrow_rows(make, UNITS), "doc_id long, pid int, unit int, stream_id int, pts long, dts long, random_access boolean, first_packet long, n_bytes long"
    )


def round_trip(docs: DataFrame) -> DataFrame:
    """Store all texts as transport streams in the shared folder, read them back, describe them."""
    return features(materialise(store(docs), "transport"))
