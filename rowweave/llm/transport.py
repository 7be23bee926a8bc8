"""Media columns: MPEG transport streams.

mux() packs a payload into 188-byte packets: a program association table, a program map table, and one elementary stream of
packets with timestamps, of which every RANDOM_ACCESS-th starts a random-access point. demux() parses the tables, follows
the continuity counters, puts the elementary packets together again and lists timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
#: Private data in PES packets; no decoder is meant to touch the payload.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Payload bytes of an elementary packet, clock ticks (90 kHz) between two, packets from one random-access point to the next.
ELEMENTARY, TICKS, RANDOM_ACCESS = 8192, 3600, 8
ALIGN = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        table = np.where(table >> np.uint32(31) != 0, (table << np.uint32(1)) ^ np.uint32(0x04C11DB7), table << np.uint32(1))
    return table


_CRC = _crc_table().tolist()


def section_crc(data: bytes) -> int:
    """CRC-32 as in the sections of program tables (most significant bit first, no final inversion)."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    size = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | size >> 8, size & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0]))
)


def _timestamp(ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 0x01 | ticks << 1 & 0xFE])


def _read_timestamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """The transport stream that holds payload; without payload, the tables alone."""
    parts, counter = [TABLES], 0
    for k, i in enumerate(range(0, len(payload), ELEMENTARY)):
        body = payload[i : i + ELEMENTARY]
        random_access, ticks = k % RANDOM_ACCESS == 0, k * TICKS
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (8 + len(body)).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(ticks) + body
        # the first packet of a random-access point says so, with a program clock reference
        flags = bytes([0x50]) + (ticks << 15 | 0x7E00).to_bytes(6, "big") if random_access else b""
        first_room = 184 - (1 + len(flags) if flags else 0)
        rest = max(0, len(pes) - first_room)
        n = 1 + -(-rest // 184)
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
        counter = (counter + n) & 0x0F
        bytes_of = np.frombuffer(pes, np.uint8)
        if n == 1:
            _padded(out[0], flags, bytes_of)
        else:
            _padded(out[0], flags, bytes_of[:first_room])
            whole = (len(pes) - first_room) // 184
            out[1 : 1 + whole, 4:] = bytes_of[first_room : first_room + 184 * whole].reshape(whole, 184)
            if 1 + whole < n:
                _padded(out[n - 1], b"", bytes_of[first_room + 184 * whole :])
        parts.append(out.tobytes())
    return b"".join(parts)


def _padded(packet: np.ndarray, flags: bytes, body: np.ndarray) -> None:
    """Put body at the end of a packet, after an adaptation field with flags and as much stuffing as is needed."""
    gap = 184 - len(body)
    if gap:
        packet[3] |= 0x20
        packet[4] = gap - 1
        if gap > 1:
            field_bytes = (flags or b"\0").ljust(gap - 1, b"\xff")
            packet[5 : 4 + gap] = np.frombuffer(field_bytes, np.uint8)
    packet[4 + gap :] = body


@dataclass
class Stream:
    """What a transport stream holds. programs: stream types by number and PID; timestamps: one an elementary packet (-1: none);
    random_access: where in the payload such a point is; bad_counters: packets out of turn; errors: what is wrong."""

    payload: bytes = b""
    packets: int = 0
    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    timestamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    bad_counters: int = 0
    errors: list[str] = field(default_factory=list)

    def feature(self) -> str:
        streams = ",".join(f"{p}:{pid}/{kind}" for p, x in sorted(self.programs.items()) for pid, kind in sorted(x.items()))
        ends = f"{self.timestamps[0]}-{self.timestamps[-1]}" if self.timestamps else "none"
        return f"packets={self.packets};streams={streams};pes={len(self.timestamps)};pts={ends};rap={len(self.random_access)};cc_errors={self.bad_counters};errors={len(self.errors)}"


def demux(media: bytes | None) -> Stream:
    """Parse a stream; null is an empty one. Damage is listed, never raised: what can be read is."""
    out = Stream()
    media = media or b""
    n = len(media) // PACKET
    if len(media) % PACKET:
        out.errors.append("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    out.packets = n
    good = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)
    if not good.all():
        out.errors.append(f"{int((~good).sum())} packets without sync or with an error flag")
        packets = packets[good]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    start = packets[:, 1] & 0x40 != 0
    has_payload, has_field = packets[:, 3] & 0x10 != 0, packets[:, 3] & 0x20 != 0
    body_at = np.where(has_field, 5 + packets[:, 4].astype(np.int32), 4)
    maps = {}

    def bodies(of: int) -> Iterator[tuple[bool, bytes]]:
        return ((bool(start[i]), packets[i, body_at[i] :].tobytes()) for i in np.flatnonzero((pid == of) & has_payload))

    for _, body in _sections(bodies(PAT_PID), 0, out):
        for j in range(0, len(body) - 3, 4):
            if number := int.from_bytes(body[j : j + 2], "big"):  # 0 names the network table
                maps[int.from_bytes(body[j + 2 : j + 4], "big") & 0x1FFF] = number
    for map_pid in maps:
        for number, body in _sections(bodies(map_pid), 2, out):
            j, found = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF), {}
            while j + 5 <= len(body):
                found[int.from_bytes(body[j + 1 : j + 3], "big") & 0x1FFF] = body[j]
                j += 5 + (int.from_bytes(body[j + 3 : j + 5], "big") & 0xFFF)
            out.programs[number] = found
    parts, offset = [], 0
    for media_pid in sorted({p for x in out.programs.values() for p in x}):
        own = np.flatnonzero((pid == media_pid) & has_payload)
        own = own[~_repeated(packets[own], body_at[own])]
        counters = packets[own, 3] & 0x0F
        out.bad_counters += int(((counters[1:] - counters[:-1]) & 0x0F != 1).sum())
        begins = np.flatnonzero(start[own])
        if len(own) and (not len(begins) or begins[0]):
            out.errors.append("packets before the first start")
        for a, b in zip(begins, [*begins[1:], len(own)]):  # noqa: B905 none if nothing begins
            rows, first = packets[own[a:b]], body_at[own[a:b]]
            if b - a > 2 and (first[1:-1] == 4).all():  # the usual case: only the ends have an adaptation field
                pes = rows[0, first[0] :].tobytes() + rows[1:-1, 4:].tobytes() + rows[-1, first[-1] :].tobytes()
            else:
                pes = b"".join(row[f:].tobytes() for row, f in zip(rows, first, strict=True))
            head = 9 + pes[8] if len(pes) > 8 else 9
            if len(pes) < head or pes[:3] != b"\0\0\1":
                out.errors.append("not an elementary packet")
                continue
            size = int.from_bytes(pes[4:6], "big")
            if size and size != len(pes) - 6:
                out.errors.append("an elementary packet of another size than it says")
            timed = pes[7] & 0x80 and pes[8] >= 5
            if pes[7] & 0x80 and not timed:
                out.errors.append("no room for the timestamp that is announced")
            out.timestamps.append(_read_timestamp(pes[9:14]) if timed else -1)
            at = own[a]
            if has_field[at] and packets[at, 4] and packets[at, 5] & 0x40:
                out.random_access.append(offset)
            parts.append(pes[head:])
            offset += len(parts[-1])
    out.payload = b"".join(parts)
    return out


def _repeated(packets: np.ndarray, body_at: np.ndarray) -> np.ndarray:
    """Which packets of one stream are the one before again: the same counter and payload, once at most."""
    out = np.zeros(len(packets), bool)
    same = np.flatnonzero((packets[1:, 3] & 0x0F == packets[:-1, 3] & 0x0F) & (body_at[1:] == body_at[:-1])) + 1
    for i in same:
        out[i] = not out[i - 1] and np.array_equal(packets[i, body_at[i] :], packets[i - 1, body_at[i] :])
    return out


def _sections(bodies: Iterator[tuple[bool, bytes]], table_id: int, out: Stream) -> Iterator[tuple[int, bytes]]:
    """(number, body) of the sections in the payloads of one PID (with whether a section begins there) whose CRC holds; a section
    may go on in the packets after, and several may stand in one."""

    def whole(data: bytes) -> Iterator[bytes]:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if len(data) < size:
                break
            yield data[:size]
            data = data[size:]
        rest.append(b"" if data[:1] == b"\xff" else data)

    data, rest = b"", []
    for begins, body in bodies:
        parts = [data + body] if not begins else [data + body[1 : 1 + body[0]], body[1 + body[0] :]] if body else []
        if not begins and not data:
            continue  # stuffing, or what began before the first packet
        for k, part in enumerate(parts):
            for section in whole(part):
                if section[0] != table_id or len(section) < 12 or section_crc(section):
                    out.errors.append("a bad program table")
                else:
                    yield int.from_bytes(section[3:5], "big"), section[8:-4]
            data = rest.pop()
            if data and k < len(parts) - 1:  # another section begins before this one's end
                out.errors.append("a bad program table")
    if data:
        out.errors.append("a bad program table")


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text (null: empty) with zeros up to a positive multiple of ALIGN, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0"), len(raw)


def encode(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, n_bytes and media: each whole text as a transport stream."""
    docs = common.pick(docs, *dict.fromkeys((*keep, "text")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _runs(batch.column(at), 4 << 20):
                media, sizes = [], []
                for text in batch.column(at)[i:j]:
                    payload, n = padded(text.as_py())
                    media.append(mux(payload))
                    sizes.append(n)
                own = [batch.column(batch.schema.get_field_index(c))[i:j] for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    return docs.mapInArrow(run, docs.select(*keep).schema.add("n_bytes", "long").add("media", "binary"))


def _runs(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes."""
    n = len(column)
    step = max(1, int(n * limit / max(column.nbytes, 1)))
    return ((i, min(n, i + step)) for i in range(0, n, step))


def features(media: DataFrame, *keep: str) -> DataFrame:
    """keep and what is read back from media (null: an empty stream): payload digests, timestamps, random-access points."""
    media = common.pick(media, *dict.fromkeys((*keep, "media")))
    at = media.columns.index("media")
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>"
    schema = media.select(*keep).schema
    names = [x.split()[0] for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(at):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                found = demux(raw)
                rows.append((len(found.payload), hashlib.sha256(found.payload).hexdigest(), zlib.crc32(found.payload[-ALIGN:]), len(raw), hashlib.sha256(raw).hexdigest(), found.feature(), found.timestamps, found.random_access))
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], [*keep, *names])

    for f in StructType.fromDDL(added).fields:
        schema = schema.add(f)
    return media.mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a transport stream and what is read back from it. Null and empty texts are 64 zeros; repeated rows and
    null ids are rows like any other; equal texts give equal values."""
    media = encode(common.table(spark, sf_dir, "documents"), "doc_id")
    out = features(media, "doc_id", "n_bytes")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("timestamps").alias("n_timestamps"), F.size("random_access").alias("n_random_access"))
