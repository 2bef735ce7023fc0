"""Media columns: MPEG transport streams.

The writer stores a payload as the elementary stream of one program: a program
association table, a program map table, then one elementary packet per access
unit, cut into transport packets of 188 bytes.  The first transport packet of a
unit carries the random-access flag and a clock reference; elementary packets
carry a presentation timestamp of the 90 kHz clock.

The reader follows the tables, whose sections may span packets, to the
elementary streams of all programs, counts unreadable tables, checks sync bytes and
continuity counters, reassembles the elementary packets, and stores each unit's
timestamp, its place in the payload, whether a decoder can start there, and
whether it is whole.  Counters stand still in packets without payload and in
one repeated packet, and may jump where the stream says so; any other jump is an
error, and the unit it falls into isn't whole, nor is one that is shorter than
it says.

Cases: a null text is the empty text and becomes 64 zero bytes; equal texts
give equal bytes, so repeated rows and rows of one id are rows of their own;
texts of any length are cut into units; null media gives null payload and units; damaged media gives
the payload that can be reassembled and counts its errors; empty tables and
extra columns pass (only the named columns are read).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

PACKET = 188
PMT_PID, STREAM_PID = 0x100, 0x101
#: Private data in elementary packets, and its stream id.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT = 32_768
#: Clock ticks from one unit to the next, and the first timestamp.
TICKS, FIRST = 3_600, 90_000
HEADER = 14


def crc_mpeg(data: bytes) -> int:
    """CRC-32 of table sections: polynomial 0x04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """One transport packet that holds a whole table section."""
    section = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    section += struct.pack(">I", crc_mpeg(section))
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


def tables() -> bytes:
    """Program association table and program map table."""
    program = struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, STREAM_TYPE, 0xE000 | STREAM_PID, 0xF000)
    return section_packet(0, 0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)) + section_packet(PMT_PID, 0x02, 1, program)


def stamp(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE))


def mux(payload: bytes, prologue: bytes, unit: int = UNIT) -> bytes:
    """The payload as a transport stream; prologue: what tables() returns."""
    parts, counter = [prologue], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        pts = FIRST + k * TICKS & (1 << 33) - 1
        body = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + stamp(pts) + data
        first = PACKET - 4 - 8  # after the adaptation field with its clock reference
        n = 1 + max(0, -(-(len(body) - first) // (PACKET - 4)))
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | np.arange(counter, counter + n) & 0x0F
        counter = counter + n & 0x0F
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        raw = np.frombuffer(body, np.uint8)
        if len(body) <= first:
            out[0, 3] |= 0x20
            out[0, 4], out[0, 5] = PACKET - 5 - len(body), 0x50
            out[0, 6:12] = np.frombuffer(clock, np.uint8)
            out[0, PACKET - len(body) :] = raw
        else:
            out[0, 3] |= 0x20
            out[0, 4], out[0, 5] = 7, 0x50
            out[0, 6:12] = np.frombuffer(clock, np.uint8)
            out[0, 12:] = raw[:first]
            whole = (len(body) - first) // (PACKET - 4)
            out[1 : 1 + whole, 4:] = raw[first : first + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
            if 1 + whole < n:
                rest = len(body) - first - whole * (PACKET - 4)
                out[-1, 3] |= 0x20
                out[-1, 4] = PACKET - 5 - rest
                if rest < PACKET - 5:
                    out[-1, 5] = 0
                out[-1, PACKET - rest :] = raw[-rest:]
        parts.append(out.tobytes())
    return b"".join(parts)


def sections(packets: np.ndarray) -> tuple[list[bytes], int]:
    """The table sections in the packets of one PID, without their checksums,
    and how many were cut off or have a wrong checksum."""
    out: list[bytes] = []
    errors, held, before = 0, b"", b""

    def drain() -> None:
        nonlocal errors, held
        while len(held) >= 3 and held[0] != 0xFF:
            end = 3 + (struct.unpack_from(">H", held, 1)[0] & 0x0FFF)
            if len(held) < end:
                return
            if end >= 12 and crc_mpeg(held[:end]) == 0:
                out.append(held[: end - 4])
            else:
                errors += 1
            held = held[end:]
        if held[:1] == b"\xff":  # stuffing
            held = b""

    for packet in packets:
        raw = packet.tobytes()
        if raw == before or not raw[3] & 0x10:  # sent twice, or without payload
            continue
        if held and (raw[3] - before[3]) & 0x0F != 1:
            errors, held = errors + 1, b""
        before = raw
        data = raw[4 + (1 + raw[4] if raw[3] & 0x20 else 0) :]
        if raw[1] & 0x40:
            rest = 1 + data[0] if data else 0
            if held:
                held += data[1:rest]
                drain()
                errors += bool(held)
            held = data[rest:]
        elif held:
            held += data
        drain()
    return out, errors + bool(held)


def demux(media: bytes, known: dict[bytes, tuple[list[bytes], int]]) -> tuple[bytes, list[tuple[int, int, int, bool, int, bool]], dict[str, int]]:
    """Payload, units (pts, offset, length, random access, pid, whole), and counts.

    The payload holds all elementary streams of all programs, one after the
    other, in the order of the tables; pid and type are those of the first.

    known: sections by packets, so that a table that many streams share is
    checked once; it is bounded by the caller's use for one batch.
    """
    facts = {"packets": len(media) // PACKET, "pid": -1, "type": -1, "cc_errors": 0, "sync_errors": 0, "table_errors": 0}
    rows = np.frombuffer(media, np.uint8, facts["packets"] * PACKET).reshape(-1, PACKET)
    good = rows[:, 0] == 0x47 if len(rows) else np.zeros(0, bool)
    facts["sync_errors"] = int((~good).sum()) + (len(media) % PACKET > 0)
    rows = rows[good]
    pids = (rows[:, 1] & 0x1F).astype(np.int32) << 8 | rows[:, 2]

    def current(pid: int, table_id: int) -> list[bytes]:
        """Sections of a table that are in force."""
        found = rows[pids == pid]
        key = found.tobytes()
        if key not in known:
            known[key] = sections(found)
        if pid not in seen:
            seen.add(pid)
            facts["table_errors"] += known[key][1]
        return [s for s in known[key][0] if s[0] == table_id and s[5] & 1]

    seen: set[int] = set()
    pat = current(0, 0x00)
    facts["table_errors"] += bool(len(media)) and not pat and not facts["table_errors"]
    programs = dict.fromkeys(struct.unpack_from(">HH", s, at) for s in pat for at in range(8, len(s) - 3, 4))
    streams: dict[int, int] = {}
    for number, pid in programs:
        if number == 0:  # the network's table, no program
            continue
        errors = facts["table_errors"]
        pmt = [s for s in current(pid & 0x1FFF, 0x02) if struct.unpack_from(">H", s, 3)[0] == number]
        facts["table_errors"] += not pmt and facts["table_errors"] == errors
        for s in pmt:
            at = 12 + (struct.unpack_from(">H", s, 10)[0] & 0x0FFF) if len(s) >= 12 else len(s)
            while at + 5 <= len(s):
                streams.setdefault(struct.unpack_from(">H", s, at + 1)[0] & 0x1FFF, s[at])
                at += 5 + (struct.unpack_from(">H", s, at + 3)[0] & 0x0FFF)
    parts: list[bytes] = []
    units: list[tuple[int, int, int, bool, int, bool]] = []
    at = 0
    for pid, kind in streams.items():
        if facts["pid"] < 0:
            facts["pid"], facts["type"] = pid, kind
        own, found, errors = elementary(rows[pids == pid])
        facts["cc_errors"] += errors
        parts.append(own)
        units += [(pts, at + offset, n, start, pid, whole) for pts, offset, n, start, whole in found]
        at += len(own)
    return b"".join(parts), units, facts


def elementary(rows: np.ndarray) -> tuple[bytes, list[tuple[int, int, int, bool, bool]], int]:
    """Payload and units of one stream's packets, and its continuity errors."""
    # a discontinuity may be announced in a packet without payload, too
    told = (rows[:, 3] & 0x20 > 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 > 0)
    holds = rows[:, 3] & 0x10 > 0
    told = np.maximum.accumulate(np.where(told, np.arange(len(rows)), -1))[holds] if len(rows) else told
    place, rows = np.flatnonzero(holds), rows[holds]
    if not len(rows):
        return b"", [], 0
    again = np.r_[False, (rows[1:] == rows[:-1]).all(axis=1)]  # a packet may be sent twice
    again[1:] &= ~again[:-1]
    place, told, rows = place[~again], told[~again], rows[~again]
    counters = rows[:, 3] & 0x0F
    jump = np.r_[False, ((counters[1:] - counters[:-1] & 0x0F) != 1) & (told[1:] <= place[:-1])]
    cc_errors = int(jump.sum())
    adapted = rows[:, 3] & 0x20 > 0
    offset = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    starts = rows[:, 1] & 0x40 > 0
    random = adapted & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 > 0)
    raw = rows[np.arange(PACKET) >= offset[:, None]].tobytes()
    ends = np.cumsum(np.maximum(PACKET - offset, 0))
    begins = (ends - np.maximum(PACKET - offset, 0))[starts].tolist()
    # a jump at a unit's first packet cuts off the end of the unit before
    breaks = np.flatnonzero(jump)
    unit = np.cumsum(starts) - 1
    broken = set((unit[breaks] - starts[breaks]).tolist())
    parts, units, at = [], [], 0
    for k, (begin, end, start) in enumerate(zip(begins, [*begins[1:], len(raw)], random[starts].tolist(), strict=True)):
        if end - begin < HEADER or raw[begin : begin + 3] != b"\0\0\1":
            continue
        size = struct.unpack_from(">H", raw, begin + 4)[0]
        skip = 9 + raw[begin + 8]
        x = raw[begin + 9 : begin + 14]
        pts = (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1 if raw[begin + 7] & 0x80 else -1
        data = raw[begin + skip : min(end, begin + 6 + size) if size else end]
        units.append((pts, at, len(data), start, k not in broken and (not size or end - begin >= 6 + size)))
        parts.append(data)
        at += len(data)
    return b"".join(parts), units, cc_errors


def padded(text: bytes, multiple: int) -> bytes:
    return text + b"\0" * (-len(text) % multiple if text else multiple)


def encode_transport_stream(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", multiple: int = 64, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes (of the text), media (binary transport stream)."""
    if not 0 < unit <= 65_000:
        raise ValueError("an elementary packet holds 1 to 65000 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prologue = tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t, multiple), prologue, unit) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


UNITS = "array<struct<pts:bigint,offset:bigint,length:bigint,random_access:boolean,pid:bigint,whole:boolean>>"


def decode_transport_stream(streams: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and what is read from it: payload, units
    (timestamp, place, length, random access, pid, whole), packets, pid, stream_type,
    cc_errors, sync_errors, table_errors."""
    units_type = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_()), ("pid", pa.int64()), ("whole", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[list[bytes], int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if len(known) > 1000:
                    known.clear()
                read = [demux(m, known) if m is not None else (None, None, {}) for m in part.column(2).to_pylist()]
                units = [u if u is None else [{"pts": p, "offset": o, "length": n, "random_access": r, "pid": i, "whole": w} for p, o, n, r, i, w in u] for _, u, _ in read]
                facts = [pa.array([f.get(k) for _, _, f in read], pa.int64()) for k in ("packets", "pid", "type", "cc_errors", "sync_errors", "table_errors")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p for p, _, _ in read], pa.binary()), pa.array(units, units_type), *facts], ["doc_id", "n_bytes", "media", "payload", "units", "packets", "pid", "stream_type", "cc_errors", "sync_errors", "table_errors"])

    return streams.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, media binary, payload binary, units {UNITS}, packets long, pid long, stream_type long, cc_errors long, sync_errors long, table_errors long")


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's stored stream and of what is read back."""
    read = decode_transport_stream(encode_transport_stream(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), "packets"),
        F.concat(F.lit("pid="), "pid"),
        F.concat(F.lit("type="), "stream_type"),
        F.concat(F.lit("units="), F.size("units")),
        F.concat(F.lit("pts="), F.try_element_at("units", F.lit(1))["pts"], F.lit("-"), F.try_element_at("units", F.lit(-1))["pts"]),
        F.concat(F.lit("random_access="), F.size(F.filter("units", lambda u: u["random_access"]))),
        F.concat(F.lit("cc_errors="), "cc_errors"),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
