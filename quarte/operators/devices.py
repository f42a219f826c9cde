"""Order-dependent device rules in batch: debounce and match life cycle.

Neither is worked on device by device: debounce follows pointers between events, the life cycle composes the transitions of
chunks, so that one hot device is spread over as many tasks as it has chunks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarte.operators import automata
from quarte.operators.series import carry, chunk_of, number
from quarte.session import stage


def _numbered(events: DataFrame, device: str, chunk: str, order: list[str]) -> DataFrame:
    return number(events, [device], chunk, order, "_n")


def followers(events: DataFrame, device: str, chunk: Column, time: str, limit: int) -> DataFrame:
    """Numbered events (device, time, _n) with ``_next``: the first event at least ``limit`` later."""
    probe = events.select(device, (F.col(time) + limit).alias("_t"), F.lit(0).alias("_kind"), "_n")
    real = events.select(device, F.col(time).alias("_t"), F.lit(1).alias("_kind"), "_n")
    rows = probe.unionByName(real).withColumn("_c", chunk)
    # a dense stretch of time is cut by rows: a probe and the event it meets may lie any number of rows apart
    met = carry(rows, [device], "_c", ["_t", "_kind", "_n"], first={"_next": F.when(F.col("_kind") == 1, F.col("_n"))})
    return met.where("_kind = 0").select(device, "_n", "_next")


def _orbits(batches: Iterator[pa.RecordBatch], device: str, mark: bool) -> Iterator[pa.RecordBatch]:
    """Rows (device, _c, _n, _next[, entry]) sorted by chunk and number: where each row's pointers leave the chunk, or the
    rows that the pointers from the chunk's entry meet."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        d, c = (table.column(x).to_numpy() for x in (device, "_c"))
        last = int(np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])]))[-1])
        if last:
            yield from _followed(table.slice(0, last), device, mark)
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield from _followed(pa.Table.from_batches(held).combine_chunks(), device, mark)


def _followed(table: pa.Table, device: str, mark: bool) -> Iterator[pa.RecordBatch]:
    d, c, n = (table.column(x).to_numpy() for x in (device, "_c", "_n"))
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(n)))
    base = np.repeat(start, size)
    to = table.column("_next").fill_null(-1).to_numpy()
    # numbers are dense, so a pointer inside the chunk is a distance in rows
    end = np.repeat(n[start] + size, size)
    inside = (to >= 0) & (to < end)
    point = np.append(np.where(inside, base + to - n[base], len(n)), len(n))
    if mark:
        entry = table.column("entry").to_numpy()
        seen = np.zeros(len(n) + 1, bool)
        seen[: len(n)] = n == entry
        while (point < len(n)).any():
            ahead = seen.copy()
            ahead[point[seen]] = True
            seen, point = ahead, point[point]
        yield from table.filter(pa.array(seen[: len(n)])).to_batches()
        return
    out = np.append(to, -1)
    while (going := point < len(n)).any():
        out, point = np.where(going, out[point], out), np.where(going, point[point], point)
    out = out[: len(n)]
    cols = [table.column(device), table.column("_n"), pa.array(out, pa.int64(), mask=out < 0)]
    yield from pa.table(cols, names=[device, "_n", "_exit"]).to_batches()


def debounce(events: DataFrame, device: str, chunk: str, time: str, idx: str, limit: int) -> DataFrame:
    """Events at least ``limit`` after the last accepted one; the first one is accepted.

    Every event points to the first one at least ``limit`` later, and accepted events are those that the pointers from the
    first one meet. Inside a chunk of rows pointers are followed by doubling. Between chunks only the rows that a
    pointer enters a chunk at are left; marks spread over them by joins that reach twice as far each time."""
    if limit <= 0:
        return events.select(device, time, idx)
    rows = events.select(device, chunk, F.col(time).cast("long").alias(time), F.col(idx).cast("long").alias(idx))
    rows = stage(_numbered(rows, device, chunk, [time, idx]).withColumn("_n", F.col("_n").cast("long")))
    next_ = followers(rows, device, F.expr(f"_t div {limit * 64}"), time, limit)
    rows = rows.join(next_, [device, "_n"]).withColumn("_c", chunk_of("_n")).select(device, "_c", "_n", "_next", time, idx)
    rows = stage(rows.repartition(device, "_c").sortWithinPartitions(device, "_c", "_n"))
    in_order = rows.repartition(device, "_c").sortWithinPartitions(device, "_c", "_n")
    left = in_order.mapInArrow(lambda b: _orbits(b, device, False), f"{device} long, _n long, _exit long")
    # rows that a pointer out of another chunk meets, and where their pointers go on
    left = stage(left)
    met = left.where("_exit IS NOT NULL").select(device, F.col("_exit").alias("_n")).distinct()
    first = left.where("_n = 0").select(device, "_n")
    gates = met.unionByName(first)
    jump = stage(left.join(gates, [device, "_n"]))
    seen, before_ = first, -1
    while (now := seen.count()) != before_:
        before_ = now
        ahead = seen.join(jump, [device, "_n"]).where("_exit IS NOT NULL").select(device, F.col("_exit").alias("_n"))
        seen = stage(seen.unionByName(ahead).distinct())
        twice = jump.select(device, F.col("_n").alias("_exit"), F.col("_exit").alias("_twice"))
        jump = stage(jump.join(twice, [device, "_exit"], "left").select(device, "_n", F.col("_twice").alias("_exit")))
    entered = seen.select(device, chunk_of("_n").alias("_c"), F.col("_n").alias("entry"))
    marked = rows.join(entered, [device, "_c"]).repartition(device, "_c").sortWithinPartitions(device, "_c", "_n")
    shape = marked.schema
    return marked.mapInArrow(lambda b: _orbits(b, device, True), shape).select(device, time, idx)


IDLE, PREPARING, PLAYING, SETTLING = range(4)
KINDS = ("start", "cancel", "ready", "hit", "end", "result")
#: Next state for each state, by kind of row; rows of no kind change nothing.
MOVES = {
    "start": (PREPARING,) * 4,
    "cancel": (IDLE,) * 4,
    "ready": (IDLE, PLAYING, PLAYING, SETTLING),
    "hit": (IDLE, PREPARING, PLAYING, SETTLING),
    "end": (IDLE, PREPARING, SETTLING, SETTLING),
    "result": (IDLE, PREPARING, IDLE, IDLE),
}
SAID = (
    "CASE WHEN kind = 'start' AND state <> 0 THEN 'preempted' WHEN kind = 'cancel' AND state <> 0 THEN 'cancelled' "
    "WHEN kind = 'ready' AND state = 1 THEN 'playing' WHEN kind = 'hit' AND state = 2 THEN 'signal' "
    "WHEN kind = 'end' AND state = 2 THEN 'settling' WHEN kind = 'result' AND state IN (2, 3) THEN 'finished' END"
)


def coded(kind: Column) -> Column:
    """Number of a kind; what is no kind counts as a hit of no use."""
    return F.coalesce(*(F.when(kind == k, F.lit(n)) for n, k in enumerate(KINDS)), F.lit(len(KINDS)))


GRID = [*(MOVES[k] for k in KINDS), tuple(range(4))]


def life_events(events: DataFrame, device: str, chunk: str, order: list[str]) -> DataFrame:
    """Rows (device, order, kind, idx) that the state of the device accepts: ``event`` says what they do, ``start_idx`` to
    which match. ``start_n`` numbers the match by its start; a start that preempts belongs to the match it ends."""
    rows = _numbered(events, device, chunk, order).withColumns({"_c": chunk_of("_n"), "_code": coded(F.col("kind"))})
    rows = automata.states(rows, [device], "_c", ["_n"], "_code", GRID, IDLE)
    begin = F.when(F.col("kind") == "start", F.struct(F.col("_n").alias("n"), F.col("idx").alias("idx")))
    rows = carry(rows, [device], "_c", ["_n"], last={"_before": begin}, strict=True)
    rows = rows.withColumns({"start_n": F.col("_before.n"), "start_idx": F.col("_before.idx"), "event": F.expr(SAID)})
    return rows.where("event IS NOT NULL OR kind = 'start'").select(device, "idx", "kind", "event", "start_idx", "start_n", "_n")


def life_cycles(events: DataFrame, device: str, chunk: str, order: list[str]) -> DataFrame:
    """One row per match from rows with kind start, ready, hit, end, cancel or result.

    Everything before the first start of a device is ignored; a start that ends the match before it begins its own."""
    rows = life_events(events, device, chunk, order)
    own = rows.where("kind = 'start'").select(device, F.col("_n").alias("start_n"), F.col("idx").alias("start_idx"), F.lit("started").alias("event"))
    rows = rows.where("event IS NOT NULL AND event <> 'preempted'").select(device, "start_n", "start_idx", "event").unionByName(own)
    was = lambda e: F.count_if(F.col("event") == e)
    return rows.groupBy(device, "start_n").agg(
        F.max("start_idx").alias("start_idx"),
        was("signal").alias("n_signals"),
        (was("cancelled") > 0).alias("cancelled"),
        F.when(was("settling") > 0, "settling").when(was("playing") > 0, "playing").otherwise("preparing").alias("reached"),
    )
