"""MPEG transport streams as a media column.

``mux`` stores bytes losslessly as one private elementary stream: program tables, then packets with
timestamps, random-access points and continuity counters. ``demux`` reads any such stream
back: it parses PAT and PMT sections, and for the streams that these name checks continuity, reassembles elementary packets
and returns their units with timestamps and random-access points. Both work on one value at a time, in pieces of a packet.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import batch, bound_batches, text_of

PACKET, SYNC = 188, 0x47
PMT_PID, STREAM_PID, PRIVATE = 0x1000, 0x100, 0x06
#: Payload bytes of a unit, its length in the 90 kHz clock, and units from one random-access point to the next.
UNIT, TICKS, GROUP = 576 * 16, 3600, 8
BLOCK = 576  # texts are padded to a positive multiple of it
_CLOCK = 1 << 33


def crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    out = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return out + b"\xff" * (PACKET - len(out))


TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _head(start: bool, adaptation: bool, counter: int) -> bytes:
    return bytes([SYNC, 0x40 * start | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x10 | 0x20 * adaptation | counter])


_PLAIN = [_head(False, False, c) for c in range(16)]


def mux(payload: bytes) -> bytes:
    out, counter = [TABLES], 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        pts = n * TICKS % _CLOCK
        data = payload[at : at + UNIT]
        data = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        flags = 0x10 | 0x40 * (n % GROUP == 0)
        clock = pts.to_bytes(5, "big")
        field_ = bytes([flags]) + (int.from_bytes(clock, "big") << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 5 - len(field_)
        first = data[:room]
        field_ += b"\xff" * (room - len(first))
        out += [_head(True, True, counter), bytes([len(field_)]), field_, first]
        counter = counter + 1 & 15
        whole = len(first) + (len(data) - len(first)) // 184 * 184
        for i in range(len(first), whole, 184):
            out += (_PLAIN[counter], data[i : i + 184])
            counter = counter + 1 & 15
        if rest := data[whole:]:
            stuffing = 183 - len(rest)
            out += [_head(False, True, counter), bytes([stuffing]), (b"\x00" + b"\xff" * (stuffing - 1)) if stuffing else b"", rest]
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Unit:
    """One elementary packet: its stream, timestamp (or None), random-access flag, place of its first packet, data."""

    pid: int
    pts: int | None
    random_access: bool
    position: int
    data: bytes


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)  # program number to the PID of its table
    streams: dict[int, int] = field(default_factory=dict)  # PID to stream type
    units: list[Unit] = field(default_factory=list)
    gaps: int = 0  # continuity errors
    repeats: int = 0  # packets sent twice, as the standard allows
    broken: int = 0  # packets, sections or units that can't be read
    other: int = 0  # packets of streams that no program table names

    def payload(self, pid: int | None = None) -> bytes:
        """The bytes of one elementary stream, that of the lowest PID where none is named."""
        pid = min(self.streams, default=-1) if pid is None else pid
        return b"".join(u.data for u in self.units if u.pid == pid)


def _sections(held: bytearray):
    """Takes whole sections from the front; None for one whose checksum is wrong. Behind the last one is stuffing."""
    while len(held) >= 3 and held[0] != 0xFF:
        n = 3 + ((held[1] & 0x0F) << 8 | held[2])
        if len(held) < n:
            return
        data = bytes(held[:n])
        del held[:n]
        yield data if n >= 12 and crc_mpeg(data) == 0 else None
    if held[:1] == b"\xff":
        held.clear()


def _unit(pid: int, random: bool, position: int, data: bytes) -> Unit | None:
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        return None
    size, flags, extra = int.from_bytes(data[4:6], "big"), data[7], data[8]
    pts = None
    if flags & 0x80 and extra >= 5:
        a = data[9:14]
        pts = (a[0] >> 1 & 7) << 30 | a[1] << 22 | a[2] >> 1 << 15 | a[3] << 7 | a[4] >> 1
    end = 6 + size if size else len(data)
    return Unit(pid, pts, random, position, data[9 + extra : end]) if len(data) >= end else None


def demux(media: bytes) -> Stream:
    out = Stream()
    counters: dict[int, tuple[int, bytes]] = {}
    tables: dict[int, bytearray] = {}
    open_: dict[int, list] = {}  # PID to [random, position, parts...]

    def close(pid: int, holed: bool = False) -> None:
        """Ends a unit; before a hole only one whose stated size is all there is whole."""
        if held := open_.pop(pid, None):
            data = b"".join(held[2:])
            unit = None if holed and data[4:6] == b"\0\0" else _unit(pid, held[0], held[1], data)
            out.broken += unit is None
            if unit:
                out.units.append(unit)

    def read_table(pid: int) -> None:
        for s in _sections(tables[pid]):
            if s is None:
                out.broken += 1
            elif pid == 0 and s[0] == 0:
                for i in range(8, len(s) - 4, 4):
                    if number := int.from_bytes(s[i : i + 2], "big"):
                        out.programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
            elif s[0] == 2:
                i = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
                while i + 5 <= len(s) - 4:
                    out.streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)

    for at in range(0, len(media), PACKET):
        if len(media) - at < PACKET or media[at] != SYNC or media[at + 1] & 0x80:
            out.broken += 1
            continue
        flags, control = media[at + 1], media[at + 3]
        pid = (flags & 0x1F) << 8 | media[at + 2]
        if pid == 0x1FFF or not control & 0x10:
            continue
        begin, random, jump = at + 4, False, False
        if control & 0x20:
            if n := media[begin]:
                random, jump = bool(media[begin + 1] & 0x40), bool(media[begin + 1] & 0x80)
            begin += 1 + n
        body, counter = media[begin : at + PACKET], control & 15
        if pid in counters and not jump:
            last, old = counters[pid]
            if counter == last and body == old:
                out.repeats += 1
                continue
            if counter != last + 1 & 15:
                out.gaps += 1
                close(pid, holed=True)
        counters[pid] = counter, body
        start = flags & 0x40
        if pid == 0 or pid in out.programs.values():
            if start:  # the pointer tells where a section begins; what lies before it ends the one before
                if pid in tables:
                    tables[pid] += body[1 : 1 + body[0]]
                    read_table(pid)
                tables[pid] = bytearray(body[1 + body[0] :])
            elif pid in tables:
                tables[pid] += body
            if pid in tables:
                read_table(pid)
        elif pid not in out.streams:  # no program has it
            out.other += 1
        elif start:
            close(pid)
            open_[pid] = [random, at, body]
        elif pid in open_:
            open_[pid].append(body)
    for pid in list(open_):
        close(pid)
    return out


def mux_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes (null: none), padded by bytes 255 to a positive
    multiple of ``block``, as a transport stream. Equal texts give equal streams; rows keep their number, repeated ones and
    those with a null id too. A text of any length is worked on whole. An empty table gives no rows; ids must be integers."""
    bound_batches(df.sparkSession)
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch(schema, [b.column(0), [len(t) for t in texts], [mux(t + b"\xff" * (-len(t) % block if t else block)) for t in texts]])

    rows = df.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


UNITS = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("position", pa.int64()), ("size", pa.int64())])


def demux_column(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, programs, streams, gaps, broken, units) of
    the streams in column media, units being an array of (pid, pts, random_access, position, size). A null media is an
    empty one; a null id stays null, repeated rows are worked on each. An empty table gives no rows."""
    bound_batches(df.sparkSession)
    names = [(id_col, pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    names += [("programs", pa.int64()), ("streams", pa.string()), ("gaps", pa.int64()), ("broken", pa.int64()), ("units", pa.list_(UNITS))]
    schema = pa.schema(names)

    def run(batches):
        for b in batches:
            rows = []
            for i, n, media in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = demux(media)
                p = s.payload()
                kinds = ",".join(f"{pid}:{kind}" for pid, kind in sorted(s.streams.items()))
                units = [(u.pid, u.pts, u.random_access, u.position, len(u.data)) for u in s.units]
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(s.programs), kinds, s.gaps, s.broken, units))
            if rows:
                yield batch(schema, [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)])

    spark_names = f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, programs long, streams string, gaps long, broken long, units array<struct<pid: int, pts: long, random_access: boolean, position: long, size: long>>"
    return df.select(F.col(id_col).cast("long").alias(id_col), "n_bytes", F.coalesce("media", F.lit(b"")).alias("media")).mapInArrow(run, spark_names)


def feature() -> Column:
    """A stream's programs and streams, and its timestamps and random-access points, as text of the columns of ``demux_column``."""
    stamps = F.filter(F.transform("units", lambda u: u["pts"]), lambda p: p.isNotNull())
    points = F.size(F.filter("units", lambda u: u["random_access"]))
    told = {"programs": "programs", "streams": "streams", "units": F.size("units"), "points": points, "first": F.coalesce(F.array_min(stamps), F.lit(-1)), "last": F.coalesce(F.array_max(stamps), F.lit(-1)), "gaps": "gaps", "broken": "broken"}
    return F.concat_ws(";", *[F.concat(F.lit(f"{k}="), (F.col(v) if isinstance(v, str) else v).cast("string")) for k, v in told.items()])


def unit_table(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per elementary packet: id, unit, pid, pts, random_access, position, size."""
    rows = demux_column(df.withColumn("n_bytes", F.lit(None).cast("long")), id_col)
    return rows.select(id_col, F.posexplode("units").alias("unit", "u")).select(id_col, F.col("unit").cast("long").alias("unit"), "u.*")
