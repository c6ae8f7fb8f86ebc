"""Media columns: byte payloads in MPEG transport streams (ISO/IEC 13818-1).

``mux`` wraps bytes in a single-program stream: a program association table, a program map
table, and one private elementary stream cut in access units. Every unit is a PES packet with
a presentation timestamp; every ``GOP``-th unit is a random-access point, which repeats both
tables and carries a clock reference. ``demux`` reads such a stream: it parses the tables,
checks the continuity counters of each PID, reassembles the PES packets, and lists timestamps
and random-access points with their packet numbers. It also reads streams of other writers: several programs and
elementary streams, tables that span packets, packets sent twice, PES packets of open length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import fresh, map_batches, materialize, q, without

# Fixed values of the standard.
PACKET, SYNC, PAT_PID, STREAM_ID, STREAM_TYPE = 188, 0x47, 0x0000, 0xBD, 0x06
CRC_POLY, NULL_PID = 0x04C11DB7, 0x1FFF
#: Stream ids whose PES packets have no optional header.
BARE_IDS = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))

# Choices of this writer.
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT, GOP, TICKS = 2048, 8, 3600
ALIGN = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ CRC_POLY if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return b"\0" + head + crc_mpeg(head).to_bytes(4, "big")


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
_PSI = [(0x4000 | PAT_PID).to_bytes(2, "big"), _PAT.ljust(PACKET - 4, b"\xff"), (0x4000 | PMT_PID).to_bytes(2, "big"), _PMT.ljust(PACKET - 4, b"\xff")]
_MARK = b"\x47"
_ES_START, _ES_MORE = (0x4000 | ES_PID).to_bytes(2, "big"), ES_PID.to_bytes(2, "big")
_PLAIN = [bytes([0x10 | c]) for c in range(16)]
_ADAPT = [bytes([0x30 | c]) for c in range(16)]


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _filled(want: int, flags: int = 0, extra: bytes = b"") -> bytes:
    """An adaptation field of exactly ``want`` bytes."""
    if want == 1:
        return b"\0"
    return bytes([want - 1, flags]) + extra + b"\xff" * (want - 2 - len(extra))


def mux(payload: bytes) -> bytes:
    """``payload`` as a transport stream; empty payloads give one empty access unit."""
    out, cc, psi = [], 0, 0
    for n, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        unit, pts, rap = payload[at : at + UNIT], (n * TICKS) & 0x1FFFFFFFF, n % GOP == 0
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        if rap:
            for k in (0, 2):
                out += [_MARK, _PSI[k], _PLAIN[psi], _PSI[k + 1]]
            psi = (psi + 1) & 15
            pcr = ((pts << 15) | 0x7E00).to_bytes(6, "big")
            room = PACKET - 4 - 8
            took = min(room, len(pes))
            out += [_MARK, _ES_START, _ADAPT[cc], _filled(PACKET - 4 - took, 0x50, pcr), pes[:took]]
        elif len(pes) >= PACKET - 4:
            took = PACKET - 4
            out += [_MARK, _ES_START, _PLAIN[cc], pes[:took]]
        else:
            took = len(pes)
            out += [_MARK, _ES_START, _ADAPT[cc], _filled(PACKET - 4 - took), pes]
        cc = (cc + 1) & 15
        while took < len(pes):
            part = pes[took : took + PACKET - 4]
            took += len(part)
            out += [_MARK, _ES_MORE, _PLAIN[cc], part] if len(part) == PACKET - 4 else [_MARK, _ES_MORE, _ADAPT[cc], _filled(PACKET - 4 - len(part)), part]
            cc = (cc + 1) & 15
    return b"".join(out)


@dataclass
class Program:
    """What a stream holds of one program. ``payload``, ``pts`` and the random-access points are those of its first elementary stream."""

    payload: bytes = b""
    n_packets: int = 0
    cc_errors: int = 0
    n_duplicates: int = 0
    number: int = -1
    pts: list[int] = field(default_factory=list)
    rap_pts: list[int] = field(default_factory=list)
    rap_packets: list[int] = field(default_factory=list)
    streams: dict[int, int] = field(default_factory=dict)
    payloads: dict[int, bytes] = field(default_factory=dict)
    stamps: dict[int, list[int]] = field(default_factory=dict)


class _Sections:
    """Puts the sections of a PID together, which may begin anywhere in a packet and span several."""

    def __init__(self) -> None:
        self.held: bytes | None = None

    def feed(self, part: bytes, start: bool) -> list[bytes]:
        out: list[bytes] = []
        if start:
            at = 1 + part[0]
            if self.held is not None:
                self.held += part[1:at]
                out = self._whole()
            self.held = part[at:]
        elif self.held is not None:
            self.held += part
        return out + self._whole()

    def _whole(self) -> list[bytes]:
        out, held = [], self.held or b""
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := ((held[1] & 0x0F) << 8 | held[2]) + 3):
            out.append(held[:size])
            held = held[size:]
        if self.held is not None:
            self.held = b"" if held[:1] == b"\xff" else held  # stuffing goes to the packet's end
        return out


def _table(section: bytes, table_id: int) -> bytes | None:
    """The body of a section of this table; None for another table's."""
    if section[0] != table_id:
        return None
    if len(section) < 12 or crc_mpeg(section):
        raise ValueError("a program table is damaged")
    return section[8:-4]


def _unit(parts: list[bytes]) -> tuple[bytes, int | None]:
    """Data and presentation timestamp of a PES packet. A length of 0 means: up to the next one."""
    pes = b"".join(parts)
    if pes[:3] != b"\0\0\1" or len(pes) < 6:
        raise ValueError("a PES packet has no start code")
    length = int.from_bytes(pes[4:6], "big")
    end = 6 + length if length else len(pes)
    if pes[3] in BARE_IDS:
        return pes[6:end], None
    pts = None
    if pes[7] & 0x80:
        s = pes[9:14]
        pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
    return pes[9 + pes[8] : end], pts


def demux(media: bytes, number: int | None = None) -> Program:
    """Parse a transport stream: the program of this number, by default the first that the association table names.

    Every elementary stream of the program is put together. A packet sent twice counts once, as the standard allows;
    a jump of a PID's counter is an error unless the packet announces a discontinuity. Program 0 is the network's table.
    """
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    out, pmt_pid = Program(n_packets=len(media) // PACKET), -1
    last: dict[int, tuple[int, bytes]] = {}
    sections = {PAT_PID: _Sections()}
    units: dict[int, list[list[bytes]]] = {}
    raps: list[tuple[int, int]] = []
    seen: set[bytes] = set()
    first = -1
    for n, at in enumerate(range(0, len(media), PACKET)):
        if media[at] != SYNC:
            raise ValueError(f"packet {n} has no sync byte")
        b1, b3 = media[at + 1], media[at + 3]
        pid, start, cc, begin, flags = (b1 & 0x1F) << 8 | media[at + 2], b1 & 0x40, b3 & 15, at + 4, 0
        if b3 & 0x20:
            size = media[begin]
            flags = media[begin + 1] if size else 0
            begin += 1 + size
        if not b3 & 0x10 or pid == NULL_PID:
            continue
        part = media[begin : at + PACKET]
        if pid in last and not flags & 0x80:
            if last[pid] == (cc, part):
                out.n_duplicates += 1
                last[pid] = (cc, b"")  # a third one would be an error
                continue
            if (last[pid][0] + 1) & 15 != cc:
                out.cc_errors += 1
        last[pid] = (cc, part)
        if pid in units:
            if start:
                units[pid].append([])
                if flags & 0x40 and pid == first:
                    raps.append((n, len(units[pid]) - 1))
            if units[pid]:
                units[pid][-1].append(part)
        elif pid in sections:
            for section in sections[pid].feed(part, bool(start)):
                if section in seen:
                    continue
                seen.add(section)
                if pid == PAT_PID and (body := _table(section, 0)) is not None:
                    for k in range(0, len(body), 4):
                        named = body[k] << 8 | body[k + 1]
                        if pmt_pid < 0 and named and number in (None, named):
                            out.number, pmt_pid = named, (body[k + 2] & 0x1F) << 8 | body[k + 3]
                            sections[pmt_pid] = _Sections()
                elif pid == pmt_pid and (body := _table(section, 2)) is not None and section[3] << 8 | section[4] == out.number:
                    k = 4 + ((body[2] & 0x0F) << 8 | body[3])
                    while k + 5 <= len(body):
                        es = (body[k + 1] & 0x1F) << 8 | body[k + 2]
                        out.streams[es] = body[k]
                        units.setdefault(es, [])
                        k += 5 + ((body[k + 3] & 0x0F) << 8 | body[k + 4])
                    first = next(iter(out.streams), -1)
    for pid, packets in units.items():
        got = [_unit(parts) for parts in packets]
        out.payloads[pid] = b"".join(data for data, _ in got)
        out.stamps[pid] = [pts for _, pts in got if pts is not None]
        if pid == first:
            out.payload, out.pts = out.payloads[pid], out.stamps[pid]
            out.rap_packets = [n for n, _ in raps]
            out.rap_pts = [got[k][1] for _, k in raps if got[k][1] is not None]
    return out


def padded(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0")


def feature(p: Program) -> str:
    """What the stored stream shows: packets, units, random-access points, counter errors, last timestamp, byte sum."""
    return f"packets={p.n_packets};units={len(p.pts)};raps={len(p.rap_pts)};cc_errors={p.cc_errors};last_pts={p.pts[-1] if p.pts else -1};sum={zlib.adler32(p.payload)}"


def _appended(df: DataFrame, add: list[T.StructField], row) -> DataFrame:
    """``df`` with the columns ``add``, which ``row`` makes of each batch's arrays."""
    schema = T.StructType([*df.schema.fields, *add])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, *row(part)], names=schema.names)

    return map_batches(df, run, schema)


def encode_media(df: DataFrame, text_col: str = "text", media_col: str = "media", n_bytes_col: str = "n_bytes", keep_text: bool = True) -> DataFrame:
    """Add the text's transport stream and its unpadded length in bytes.

    Null is the empty text. Rows, order in a partition, repeated rows and all other columns stay; columns by
    the new names are replaced.
    """
    df = without(df, media_col, n_bytes_col)
    at = df.columns.index(text_col)

    def row(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column(at).to_pylist()
        return [pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())]

    out = _appended(df, [T.StructField(n_bytes_col, T.LongType()), T.StructField(media_col, T.BinaryType())], row)
    return out if keep_text else out.drop(q(text_col))


def decode_media(df: DataFrame, media_col: str = "media", with_payload: bool = True) -> DataFrame:
    """Add ``payload``, ``pts``, ``rap_pts``, ``rap_packets``, ``cc_errors``, ``feature`` and digests of a stored stream.

    Columns of ``df`` by those names are replaced; a null stream gives nulls.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "cc_errors", "pts", "rap_pts", "rap_packets", "payload"]
    df = without(df, *names)
    at = df.columns.index(media_col)
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.LongType(), *[T.ArrayType(T.LongType())] * 3, T.BinaryType()]
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
    n = len(names) if with_payload else len(names) - 1

    def row(part: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for media in part.column(at).to_pylist():
            if media is None:
                rows.append((None,) * n)
                continue
            p = demux(media)
            rows.append((len(p.payload), hashlib.sha256(p.payload).hexdigest(), zlib.crc32(p.payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature(p), p.cc_errors, p.pts, p.rap_pts, p.rap_packets, p.payload)[:n])
        columns = list(zip(*rows, strict=True)) if rows else [()] * n
        return [pa.array(c, t) for c, t in zip(columns, arrow, strict=False)]

    return _appended(df, [T.StructField(a, k) for a, k in list(zip(names, kinds, strict=True))[:n]], row)


def store_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The media table: every column but the text, with ``n_bytes`` and ``media``, written to the shared folder and read back."""
    return materialize(encode_media(df, text_col, keep_text=False), "media")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every document's text as a transport stream, then describe what is stored.

    An empty table gives an empty result, equal texts give equal values, a null text counts as empty and a
    null or repeated doc_id is kept as it is.
    """
    stored = store_media(docs.select("doc_id", "text"))
    seen = decode_media(stored, with_payload=False)
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "cc_errors", F.size("pts").alias("n_pts"), F.size("rap_pts").alias("n_raps"))
