"""Byte payloads kept as MPEG transport streams (ISO/IEC 13818-1), and the parser that reads them back.

A stream has a program association table, a program map table for one private-data stream, and one packetised
elementary packet for each block of the payload. Each elementary packet carries a presentation timestamp; every
`RANDOM_ACCESS`-th one is a random-access point and has a clock reference. Parsing follows the tables to the
elementary stream, checks the continuity counter of each PID and the checksums of the tables, reassembles the
packets and returns timestamps, random-access points and counted errors.

Defined results: a null text is empty, and an empty one is 64 zero bytes. Rows are stored and read one by one: null and
repeated ids stay as they are, repeated rows and equal texts give equal values. An empty table gives an empty table;
other columns take no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .wordhash import text_buffers

PACKET, BODY = 188, 184
PMT_PID, DATA_PID = 0x1000, 0x0100
#: Payload bytes of one elementary packet, the step of its timestamp at 90 kHz, random-access distance.
BLOCK, STEP, RANDOM_ACCESS = 8192, 3600, 4
UNIT = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def mpeg_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + mpeg_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
_PMT = _table_packet(PMT_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, 0x06, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0])))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out = [_PAT, _PMT]
    counter = 0
    for k, at in enumerate(range(0, len(payload), BLOCK)):
        block = payload[at : at + BLOCK]
        pes = b"\x00\x00\x01\xbd" + (len(block) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * STEP) + block
        # first packet: the adaptation field with the random-access flag and, there, the clock
        access = k % RANDOM_ACCESS == 0
        field_ = b"\x50" + (k * STEP << 15 | 0x7E00).to_bytes(6, "big") if access else b""
        head = [0x47, 0x40 | DATA_PID >> 8, DATA_PID & 255]
        room = BODY - (len(field_) + 1 if field_ else 0)
        if len(pes) < room:
            if not field_:
                field_ = b"\x00" if room - len(pes) > 1 else b""
            size = BODY - len(pes) - 1
            field_ = field_.ljust(size, b"\xff") if size else b""
            out.append(bytes([*head, 0x30 | counter, size]) + field_ + pes)
            counter = counter + 1 & 15
            continue
        out.append(bytes([*head, 0x30 | counter, len(field_)]) + field_ + pes[:room] if field_ else bytes([*head, 0x10 | counter]) + pes[:room])
        counter = counter + 1 & 15
        rest = len(pes) - room
        whole, left = divmod(rest, BODY)
        if whole:
            body = np.empty((whole, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
            body[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            body[:, 4:] = np.frombuffer(pes, np.uint8, whole * BODY, room).reshape(whole, BODY)
            out.append(body.tobytes())
            counter = counter + whole & 15
        if left:
            size = BODY - left - 1
            stuff = b"\x00".ljust(size, b"\xff") if size else b""
            out.append(bytes([0x47, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter, size]) + stuff + pes[-left:])
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Parsed:
    payload: bytes = b""
    packets: int = 0
    timestamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # timestamps of the access points
    clocks: list[int] = field(default_factory=list)
    continuity_errors: int = 0
    table_errors: int = 0
    sync_errors: int = 0
    broken_packets: int = 0  # elementary packets that were cut short

    def feature(self) -> str:
        first = self.timestamps[0] if self.timestamps else ""
        last = self.timestamps[-1] if self.timestamps else ""
        return f"packets={self.packets};pes={len(self.timestamps)};pts={first}..{last};rap={len(self.random_access)};pcr={len(self.clocks)};cc={self.continuity_errors};crc={self.table_errors};sync={self.sync_errors};broken={self.broken_packets}"


def _table(body: bytes, table: int) -> bytes | None:
    at = 1 + body[0] if body else 1
    if len(body) < at + 12 or body[at] != table:
        return None
    end = at + 3 + ((body[at + 1] & 15) << 8 | body[at + 2])
    section = body[at:end]
    return section[8:-4] if len(section) == end - at and mpeg_crc(section[:-4]) == int.from_bytes(section[-4:], "big") else None


def read_stream(stream: bytes) -> Parsed:
    """Parse a transport stream. Damaged packets are counted and left out; nothing raises."""
    out = Parsed()
    pieces: list[bytes] = []
    n = len(stream) // PACKET
    out.packets = n
    out.sync_errors = int(len(stream) % PACKET != 0)
    if not n:
        return out
    p = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    sync = p[:, 0] == 0x47
    out.sync_errors += int((~sync).sum())
    p = p[sync]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    has_field, has_body = p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0
    begin = 4 + np.where(has_field, p[:, 4].astype(np.int32) + 1, 0)
    # the tables lead to the elementary streams
    maps, wanted = [], []
    for i in np.flatnonzero((pid == 0) & (p[:, 1] & 0x40 > 0)):
        t = _table(p[i, begin[i] :].tobytes(), 0)
        out.table_errors += t is None
        maps += [(t[j + 2] & 0x1F) << 8 | t[j + 3] for j in range(0, len(t) - 3, 4) if t[j] or t[j + 1]] if t else []
    for i in np.flatnonzero(np.isin(pid, maps) & (p[:, 1] & 0x40 > 0)):
        t = _table(p[i, begin[i] :].tobytes(), 2)
        out.table_errors += t is None
        at = 4 + ((t[2] & 15) << 8 | t[3]) if t else 0
        while t and at + 5 <= len(t):
            wanted.append((t[at + 1] & 0x1F) << 8 | t[at + 2])
            at += 5 + ((t[at + 3] & 15) << 8 | t[at + 4])
    for stream_pid in dict.fromkeys(wanted):
        mine = np.flatnonzero((pid == stream_pid) & has_body)
        if not len(mine):
            continue
        q, start = p[mine], begin[mine]
        counter = q[:, 3] & 15
        out.continuity_errors += int(((counter[1:].astype(np.int32) - counter[:-1]) & 15 != 1).sum())
        flags = np.where(has_field[mine] & (q[:, 4] > 0), q[:, 5], 0)
        heads = np.flatnonzero(q[:, 1] & 0x40 > 0)
        for a, b in zip(heads, [*heads[1:], len(q)], strict=True):
            part = q[a:b]
            s = start[a:b]
            if len(part) > 2 and not (s[1:-1] != 4).any():
                pes = part[0, s[0] :].tobytes() + part[1:-1, 4:].tobytes() + part[-1, s[-1] :].tobytes()
            else:
                pes = b"".join(x[i:].tobytes() for x, i in zip(part, s, strict=True))
            size = int.from_bytes(pes[4:6], "big") if pes[:3] == b"\x00\x00\x01" and len(pes) > 8 else -1
            if size < 3 or len(pes) < size + 6:
                out.broken_packets += 1
                continue
            if pes[7] & 0x80:
                x = pes[9:14]
                pts = (x[0] & 0x0E) << 29 | x[1] << 22 | (x[2] & 0xFE) << 14 | x[3] << 7 | x[4] >> 1
                out.timestamps.append(pts)
                if flags[a] & 0x40:
                    out.random_access.append(pts)
            if flags[a] & 0x10:
                out.clocks.append(int.from_bytes(part[0, 6:12].tobytes(), "big") >> 15)
            pieces.append(pes[9 + pes[8] : 6 + size])
    out.payload = b"".join(pieces)
    return out


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes and the stream `media` of its padded text (null: empty)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            step = 256
            for lo in range(0, batch.num_rows, step):
                hi = min(lo + step, batch.num_rows)
                media = [write_stream(padded(data[off[i] : off[i + 1]].tobytes())) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off[lo : hi + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(write, "doc_id long, n_bytes long, media binary")


PARSED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>, continuity_errors long"


def parsed(media: DataFrame) -> DataFrame:
    """Read streams back (columns doc_id, n_bytes, media): digests of payload and stream, feature, timestamps,
    random-access points, continuity errors. A null or damaged stream gives what can be read of it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x in batch.column(2):
                stream = x.as_py() or b""
                r = read_stream(stream)
                out.append((len(r.payload), hashlib.sha256(r.payload).hexdigest(), zlib.crc32(r.payload[-UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), r.feature(), r.timestamps, r.random_access, r.continuity_errors))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            names = [x.split()[0] for x in PARSED.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, PARSED)
