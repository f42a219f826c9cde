"""Byte streams, debounce and life cycles against loops over whole series, with chunks so small that all edges are crossed."""

import random

import pytest
from pyspark.sql import functions as F

from quarte.operators import automata, devices, framing


def loop(body):
    """The reader, one byte after the other."""
    i, out = 0, []
    while i < len(body):
        if body[i] == 0x8E:
            end = body.find(b"\x8e", i + 1)
            if end < 0 or end - i > framing.MAX_FRAME:
                if len(body) - i <= framing.MAX_FRAME and end < 0:
                    out.append((i, -1, body[i : i + 1]))
                    break
                out.append((i, 0, body[i : i + 1]))
                i += 1
                continue
            out.append((i, 1, body[i + 1 : end]))
            i = end + 1
        elif body[i : i + 2] == b"AT" and body[i + 3 : i + 5] == b"YZ" and body[i + 2 : i + 3] in [b"%d" % d for d in range(1, 10)]:
            out.append((i, 2, body[i : i + 5]))
            i += 5
        else:
            i += 1
    return out


def read(spark, bodies, size, window):
    rows = [(d, k, body[k * size : (k + 1) * size]) for d, body in enumerate(bodies) for k in range(-(-len(body) // size))]
    random.Random(size).shuffle(rows)
    df = spark.createDataFrame(rows, "d long, k long, b binary")
    return framing.frames(df, "d", "k", "b", window)


def streams():
    rnd = random.Random(5)
    parts = [b"\x8e", b"AT8YZ", b"AT9YZ", b"AT", b"3YZ", b"AT0YZ", b"\x00" * 50, b"A" * 300, b"\x8e" + b"\x02" * 20 + b"\x8e", b"\x8e" + b"x" * 255 + b"\x8e", b"\x8e" + b"x" * 256 + b"\x8e"]
    mixed = [b"".join(rnd.choices(parts, k=60)) for _ in range(6)]
    return [*mixed, b"", b"AT8", b"\x8e", b"\x8e" + b"AT8YZ" * 60, b"\x8e" + b"y" * 255, b"\x8e" + b"y" * 256, b"AT8YZAT9", b"\x8e" * 900]


@pytest.mark.parametrize("size, window", [(1, 300), (7, 512), (64, 1 << 16), (5000, 257), (900, 700)])
def test_frames_do_not_depend_on_pieces(spark, tiny_chunks, monkeypatch, size, window):
    monkeypatch.setattr(automata, "FAN", 3)
    bodies = streams()
    got = sorted((r.device, r.at, r.what, bytes(r.frame)) for r in read(spark, bodies, size, window).collect())
    assert got == sorted((d, *row) for d, body in enumerate(bodies) for row in loop(body))


#: A frame as a device sends it: sequence 1, command 50, six bytes of data.
CAPTURED = bytes.fromhex("8e020000000000000001000000500300000000000006c2fd8e")


def real(seq, cmd=b"\x50", data=b""):
    head = b"\x02" + b"PL0001" + b"\x01" + bytes([seq]) + b"\x00\x00\x00" + cmd + data + len(data).to_bytes(2, "big")
    crc = 0
    for byte in b"\x8e" + head:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return b"\x8e" + head + crc.to_bytes(2, "big") + b"\x8e"


def test_counters_and_literal_frames(spark):
    bodies = [
        b"AT8YZ" + real(1) + real(1) + real(2) + b"AT9YZ",
        real(3)[:-3] + b"\x00" + real(3)[-2:] + b"AT1YZ",
        b"\x8e" + b"AT8YZ" * 60,
        real(4, b"\x52", b"\x00\x03") + real(4) + real(5)[:10],
        CAPTURED + b"AT8YZ" + CAPTURED,
    ]
    rows = framing.decoded(read(spark, bodies, 3, 512))
    got = {r.device: (r.mains, r.repeats, r.errors, r.hits, r.strays) for r in framing.counters(rows).collect()}
    assert got == {0: (2, 1, 0, 2, 0), 1: (0, 0, 1, 1, 0), 2: (0, 0, 0, 60, 1), 3: (1, 1, 0, 0, 0), 4: (1, 1, 0, 1, 0)}
    light = rows.where("device = 3 AND ok AND NOT repeat").first()
    assert (light.seq, light.cmd, light.data) == (4, "52", "0003")
    captured = rows.where("device = 4 AND ok AND NOT repeat").first()
    assert (captured.seq, captured.cmd, captured.data) == (1, "50", "030000000000")
    assert [r.digit for r in rows.where("device = 0 AND kind = 'hit'").orderBy("at").collect()] == [8, 9]


def bounce(times, limit):
    out, last = [], None
    for t, i in times:
        if last is None or t - last >= limit:
            out.append(i)
            last = t
    return out


@pytest.mark.parametrize("spread, limit", [(3, 15), (40, 15), (1, 400), (0, 5), (60, 1), (9, 0)])
def test_debounce_of_one_hot_device(spark, tiny_chunks, spread, limit):
    rnd = random.Random(spread)
    now, rows = 0, []
    for i in range(150):
        now += rnd.randrange(spread + 1)
        rows.append((7, now, i))
    rows += [(8, 5, 1000), (8, 5, 1001), (9, 1, 1002)]
    df = spark.createDataFrame(rows, "d long, t long, i long").withColumn("c", F.expr("t div 30"))
    got = {(r.d, r.i) for r in devices.debounce(df, "d", "c", "t", "i", limit).collect()}
    want = {(d, i) for d in (7, 8, 9) for i in bounce(sorted((t, i) for e, t, i in rows if e == d), limit)}
    assert got == want


def lived(rows):
    phase, match, out = "idle", None, []
    for i, kind in rows:
        if kind == "start":
            if phase != "idle":
                out.append((match, "preempted", i))
            phase, match = "preparing", i
        elif kind == "cancel" and phase != "idle":
            out.append((match, "cancelled", i))
            phase = "idle"
        elif kind == "ready" and phase == "preparing":
            out.append((match, "playing", i))
            phase = "playing"
        elif kind == "hit" and phase == "playing":
            out.append((match, "signal", i))
        elif kind == "end" and phase == "playing":
            out.append((match, "settling", i))
            phase = "settling"
        elif kind == "result" and phase in ("playing", "settling"):
            out.append((match, "finished", i))
            phase = "idle"
    return out


def test_life_of_one_hot_device(spark, tiny_chunks, monkeypatch):
    monkeypatch.setattr(automata, "FAN", 2)
    rnd = random.Random(9)
    kinds = rnd.choices([*devices.KINDS, "other"], [2, 1, 4, 8, 3, 2, 2], k=200)
    rows = [(7, i * 3, i, k) for i, k in enumerate(kinds)] + [(8, 0, 500, "hit"), (9, 0, 600, "start")]
    df = spark.createDataFrame(rows, "d long, t long, idx long, kind string").withColumn("c", F.expr("t div 11"))
    got = devices.life_events(df, "d", "c", ["t", "idx"]).where("event IS NOT NULL AND d = 7").collect()
    assert sorted((r.start_idx, r.event, r.idx) for r in got) == sorted(lived([(i, k) for d, _, i, k in rows if d == 7]))
    cycles = devices.life_cycles(df, "d", "c", ["t", "idx"]).collect()
    assert len(cycles) == kinds.count("start") + 1
    assert {(r.start_idx, r.reached) for r in cycles if r.d == 9} == {(600, "preparing")}


def test_stream_step_equals_the_loop():
    """The streaming form goes over a batch as one composition and keeps the state between batches."""
    import numpy as np

    rnd = random.Random(2)
    kinds = rnd.choices(devices.KINDS, k=300)
    code = np.array([devices.KINDS.index(k) for k in kinds])
    grid = np.array(devices.GRID)
    whole = automata.scanned(grid, code, np.arange(300) == 0, np.array([0]))
    state = 0
    for k, at in zip(code, whole, strict=True):
        assert at == state
        state = grid[k][state]
