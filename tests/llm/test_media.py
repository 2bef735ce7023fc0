import random
import struct

import numpy as np

from tonarium.llm import media


def test_round_trip_of_all_sizes():
    rng = random.Random(0)
    prologue, known = media.tables(), {}
    for n in [0, 1, 63, 64, 128, 160, 162, 163, 176, 177, 184, 345, 346, 347, 700, 32_768, 32_769, 100_000, *(rng.randrange(3000) for _ in range(60))]:
        data = rng.randbytes(n)
        stream = media.mux(data, prologue)
        assert len(stream) % 188 == 0 and stream[::188] == b"G" * (len(stream) // 188)
        got, units, facts = media.demux(stream, known)
        assert got == data and facts["cc_errors"] == facts["sync_errors"] == 0
        if n:
            assert (facts["pid"], facts["type"]) == (media.STREAM_PID, media.STREAM_TYPE)
            assert [u[0] for u in units] == [media.FIRST + k * media.TICKS for k in range(len(units))]
            assert all(u[3] for u in units) and sum(u[2] for u in units) == n


def test_damage_is_counted():
    stream = media.mux(random.Random(1).randbytes(5000), media.tables())
    got, _, facts = media.demux(stream[: 188 * 5] + stream[188 * 6 :], {})
    assert facts["cc_errors"] == 1 and len(got) < 5000
    got, _, facts = media.demux(stream[:1000] + b"x" + stream[1001:] + b"tail", {})
    assert facts["sync_errors"] == 1
    assert media.demux(b"", {})[0] == b"" and media.demux(b"\x47" * 188, {})[0] == b""
    broken = bytearray(stream)
    broken[10] ^= 1  # the first table's checksum
    assert media.demux(bytes(broken), {})[2]["pid"] == -1


def test_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 70_000, "x"), (3, "abc", "x"), (None, "abc", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.decode_transport_stream(media.encode_transport_stream(frame)).toPandas()
    assert len(got) == 5
    for r, (_, text, _) in zip(got.itertuples(), rows, strict=True):
        data = (text or "").encode()
        assert r.payload == media.padded(data, 64) and r.n_bytes == len(data) and len(r.payload) % 64 == 0
    assert got.media[3] == got.media[4] and len(got.units[2]) == 5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.decode_transport_stream(media.encode_transport_stream(empty)).collect() == []
    none = spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")
    assert media.decode_transport_stream(none).first().payload is None


def table_packets(pid, table_id, number, body):
    """A section over as many packets as it needs."""
    whole = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    data = b"\0" + whole + struct.pack(">I", media.crc_mpeg(whole))
    cuts = [data[k : k + 184] for k in range(0, len(data), 184)]
    return b"".join((struct.pack(">BHB", 0x47, (0x4000 if k == 0 else 0) | pid, 0x10 | k & 15) + c).ljust(188, b"\xff") for k, c in enumerate(cuts))


def test_long_tables_and_several_streams():
    rng = random.Random(3)
    data = {pid: rng.randbytes(n) for pid, n in ((0x201, 40_000), (0x202, 500), (0x301, 70_000))}
    packets = []
    for pid, payload in data.items():
        rows = np.frombuffer(media.mux(payload, b""), np.uint8).reshape(-1, 188).copy()
        rows[:, 1], rows[:, 2] = rows[:, 1] & 0xE0 | pid >> 8, pid & 0xFF
        packets.append(rows.tobytes())
    entry = lambda pid, info: struct.pack(">BHH", 6, 0xE000 | pid, 0xF000 | len(info)) + info
    pat = table_packets(0, 0, 1, struct.pack(">HHHHHH", 0, 0xE010, 1, 0xE200, 2, 0xE300))
    one = table_packets(0x200, 2, 1, struct.pack(">HH", 0xE201, 0xF000) + entry(0x201, b"x" * 300) + entry(0x202, b""))
    two = table_packets(0x300, 2, 2, struct.pack(">HH", 0xE301, 0xF000 | 200) + b"y" * 200 + entry(0x301, b""))
    got, units, facts = media.demux(pat + one + two + pat + b"".join(packets), {})
    assert got == b"".join(data.values()) and {u[4] for u in units} == set(data)
    assert all(got[u[1] : u[1] + u[2]] in data[u[4]] for u in units) and sum(u[2] for u in units) == len(got)
    assert facts["pid"] == 0x201 and facts["cc_errors"] == facts["sync_errors"] == facts["table_errors"] == 0
    got, _, facts = media.demux(pat + one[:188] + two + b"".join(packets), {})
    assert got == data[0x301] and facts["table_errors"] == 1


def test_packets_without_payload_sent_twice_or_announced():
    data = random.Random(5).randbytes(2000)
    prologue = media.tables()
    packets = [media.mux(data, b"")[k : k + 188] for k in range(0, 188 * 12, 188)]
    packets = [p for p in packets if p]
    empty = lambda counter, flags: struct.pack(">BHBBB", 0x47, media.STREAM_PID, 0x20 | counter, 183, flags).ljust(188, b"\xff")

    def read(parts):
        got, units, facts = media.demux(prologue + b"".join(parts), {})
        return got, [u[5] for u in units], facts["cc_errors"]

    assert read(packets) == (data, [True], 0)
    assert read([*packets[:4], empty(3, 0), *packets[4:]]) == (data, [True], 0)  # its counter stands still
    assert read([*packets[:4], packets[3], *packets[4:]]) == (data, [True], 0)
    got, whole, errors = read([*packets[:4], packets[3], packets[3], *packets[4:]])  # three times are too many
    assert errors == 1 and whole == [False]
    lost = [*packets[:4], *packets[5:]]
    got, whole, errors = read(lost)
    assert errors == 1 and whole == [False] and len(got) < len(data)
    assert read([*lost[:4], empty(9, 0x80), *lost[4:]])[2] == 0  # announced; the unit is still too short
    two = media.mux(random.Random(6).randbytes(70_000), b"")
    rows = [two[k : k + 188] for k in range(0, len(two), 188)]
    starts = [k for k, r in enumerate(rows) if r[1] & 0x40]
    assert read(rows[: starts[1] - 1] + rows[starts[1] :])[1:] == ([False, True, True], 1)


def test_query_against_the_texts(spark):
    import hashlib
    import os
    import zlib

    import pytest

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = media.op2_transport_stream(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        data = media.padded(texts[r.doc_id], 64)
        stream = media.mux(data, media.tables())
        want = (len(texts[r.doc_id]), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stream), hashlib.sha256(stream).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want and "cc_errors=0" in r.feature
