"""Frames in a captured byte stream that comes cut into pieces of any size.

Between two delimiters lies a main frame of at most ``MAX_FRAME`` bytes behind the first; a delimiter that no other one
follows within that reach is stray and skipped. Five bytes ``AT1YZ`` to ``AT9YZ`` outside of main frames are a hit. All
other bytes are skipped. The rule reads as if bytes came one at a time, so results don't depend on the pieces.

1. Running sums of the pieces' lengths give their place in the stream of a device, and pieces are dealt into windows of
   ``WINDOW`` bytes, each with the ``MAX_FRAME`` bytes behind it.
2. A reader enters a window at one of its first ``MAX_FRAME + 1`` bytes, wherever the last frame before it ended. A window
   gives the place at which each of these is left, by jump pointers that double.
3. The composition of windows fixes where each is entered (``automata``), and a second pass marks the frames that are read,
   those across a window's edge included.

The tail of a stream behind a delimiter that waits for its end, and hits cut off by the end, stay unread."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.operators import automata
from quarte.operators.matches import serial_frames
from quarte.operators.series import carry, chunk_of, number, running
from quarte.session import stage

MARK = 0x8E
MAX_FRAME = 256  #: bytes behind a delimiter within which the next one has to come
WINDOW = 1 << 16
HIT = 5
STOPPED = MAX_FRAME + 1  #: state behind a delimiter that still waits


def jumps(body: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where something begins in the window, where the reader goes on behind each, and what each is.

    A place is a main frame (1), a hit (2), a stray delimiter (0) or a delimiter that waits (-1)."""
    marks = np.flatnonzero(body == MARK)
    hits = np.zeros(0, np.int64)
    if len(body) >= HIT:
        a, t, d, y, z = (body[k : len(body) - HIT + 1 + k] for k in range(HIT))
        hits = np.flatnonzero((a == 0x41) & (t == 0x54) & (d >= 0x31) & (d <= 0x39) & (y == 0x59) & (z == 0x5A))
    close = np.append(marks[1:], len(body) + MAX_FRAME + 1)
    whole = close - marks <= MAX_FRAME
    # without an end in reach: stray once a byte beyond its reach is there
    waits = ~whole & (marks + MAX_FRAME >= len(body))
    place = np.concatenate([marks, hits])
    to = np.concatenate([np.where(whole, close + 1, marks + 1), hits + HIT])
    kind = np.concatenate([np.where(whole, 1, np.where(waits, -1, 0)), np.full(len(hits), 2)])
    order = np.argsort(place, kind="stable")
    order = order[place[order] < window]
    return place[order], to[order], kind[order]


def left(place: np.ndarray, to: np.ndarray, kind: np.ndarray, window: int) -> list[int]:
    """Where the window is left, in bytes of the next one, for every place it may be entered at."""
    n = len(place)
    # pointers to the next place that the reader meets; n is behind the last one
    point = np.append(np.where(to >= window, n, np.searchsorted(place, to)), n)
    out = np.append(np.where(kind < 0, STOPPED, np.maximum(to - window, 0)), 0)
    point[:-1][kind < 0] = n
    while True:
        going = point < n
        if not going.any():
            break
        # a place takes over where the one it points to leaves, once that one points out
        out = np.where(going, out[point], out)
        point = np.where(going, point[point], point)
    entry = np.arange(MAX_FRAME + 1)
    return [*out[np.searchsorted(place, entry)].tolist(), STOPPED]


def read(place: np.ndarray, to: np.ndarray, kind: np.ndarray, entry: int) -> np.ndarray:
    """Places that a reader entering at ``entry`` stops at."""
    n = len(place)
    seen = np.zeros(n + 1, bool)
    point = np.append(np.where(kind < 0, n, np.searchsorted(place, to)), n)
    seen[np.searchsorted(place, entry) if entry <= MAX_FRAME else n] = True
    while (point < n).any():  # marks reach twice as far each time
        ahead = seen.copy()
        ahead[point[seen]] = True
        seen, point = ahead, point[point]
    ahead = seen.copy()
    ahead[point[seen]] = True
    return np.flatnonzero(ahead[:n])


def _windows(window: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        body = b"".join(x or b"" for x in rows.column("piece").to_pylist())
        found = jumps(np.frombuffer(body, np.uint8), window)
        return pa.table({
            "device": rows.column("device")[:1], "w": rows.column("w")[:1],
            "body": pa.array([body], pa.binary()), "exits": pa.array([left(*found, window)], pa.list_(pa.int32())),
        })

    return run


def _frames(window: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for device, w, body, entry in zip(*(batch.column(c).to_pylist() for c in ("device", "w", "body", "entry")), strict=True):
                place, to, kind = jumps(np.frombuffer(body, np.uint8), window)
                keep = read(place, to, kind, entry)
                what = kind[keep]
                a = np.where(what == 1, place[keep] + 1, place[keep])
                b = np.where(what == 1, to[keep] - 1, np.minimum(to[keep], place[keep] + HIT))
                out[0] += [device] * len(keep)
                out[1] += (place[keep] + w * window).tolist()
                out[2] += what.tolist()
                out[3] += [body[x:y] for x, y in zip(a, b, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["device", "at", "what", "frame"])

    return run


def frames(pieces: DataFrame, device: str, order: str, data: str, window: int = WINDOW) -> DataFrame:
    """(device, at, what, frame) from rows (device, order, data): what the reader finds and at which byte of the stream.

    ``order`` is a whole number that rises along the stream."""
    given = pieces.select(F.col(device).cast("long").alias("device"), F.col(order).alias("_o"), F.coalesce(F.col(data), F.lit(b"")).alias("_data"))
    given = given.withColumn("_n", F.octet_length("_data").cast("long")).withColumn("_c", chunk_of("_o"))
    placed = running(given, ["device"], "_c", ["_o"], "_n", "_at")
    first, last = F.greatest(F.expr(f"(_at - {MAX_FRAME}) div {window}"), F.lit(0)), F.expr(f"(_at + _n - 1) div {window}")
    dealt = placed.where("_n > 0").withColumn("w", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("w") * window, F.col("_at"))
    piece = F.substring("_data", (start - F.col("_at") + 1).cast("int"), (F.least((F.col("w") + 1) * window + MAX_FRAME, F.col("_at") + F.col("_n")) - start).cast("int"))
    dealt = dealt.select("device", "w", start.alias("at"), piece.alias("piece")).where(F.octet_length("piece") > 0)
    held = stage(dealt.groupBy("device", "w").applyInArrow(_windows(window), "device long, w long, body binary, exits array<int>"))
    entered = automata.entries(held, ["device"], "w")
    return held.select("device", "w", "body").join(entered, ["device", "w"]).mapInArrow(_frames(window), "device long, at long, what int, frame binary")


def decoded(found: DataFrame) -> DataFrame:
    """Frames with their parts: (device, at, kind, ok, repeat, seq, cmd, data, digit).

    kind is main, hit, stray or waiting; ``repeat`` marks a good main frame with the sequence number of the one before."""
    kind = F.when(F.col("what") == 1, "main").when(F.col("what") == 2, "hit").when(F.col("what") == 0, "stray").otherwise("waiting")
    rows = serial_frames(found.withColumn("kind", kind))
    main = F.col("kind") == "main"
    good = main & F.col("ok")
    rows = rows.withColumn("_c", F.expr(f"at div {WINDOW}"))
    rows = carry(rows, ["device"], "_c", ["at"], last={"_seq": F.when(good, F.col("seq"))}, strict=True)
    digit = F.when(F.col("kind") == "hit", F.expr("int(substr(decode(frame, 'US-ASCII'), 3, 1))"))
    return rows.select(
        "device", "at", "kind", F.when(main, F.col("ok")).alias("ok"), F.coalesce(good & (F.col("seq") == F.col("_seq")), F.lit(False)).alias("repeat"),
        *(F.when(good, F.col(c)).alias(c) for c in ("seq", "cmd", "data")), digit.alias("digit"),
    )


def counters(rows: DataFrame) -> DataFrame:
    """Per device: main frames passed on, repeats left out, main frames in error, hits, stray delimiters."""
    main = F.col("kind") == "main"
    return rows.groupBy("device").agg(
        F.count_if(main & F.col("ok") & ~F.col("repeat")).alias("mains"), F.count_if("repeat").alias("repeats"),
        F.count_if(main & ~F.col("ok")).alias("errors"), F.count_if(F.col("kind") == "hit").alias("hits"),
        F.count_if(F.col("kind") == "stray").alias("strays"),
    )
