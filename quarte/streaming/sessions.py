"""Stream forms: sequence dedup, match life cycle, live tracking, heartbeats and
signal-to-frame matching.

Keyed state is a few numbers per device or phrase. Rows of one key inside a
micro-batch are put in time order first; stored tables are replayed in slices of
time, so that order holds over micro-batches too.
"""

from __future__ import annotations

import pickle
import time as clock
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarte.operators import asof, automata, devices, tracking
from quarte.session import checkpoint_dir, shared_path


SLICES = 8  #: stretches of time that a stored table is replayed in, at least
SLICE_ROWS = 250_000  #: rows of a stretch, about
TOGETHER = 16  #: stretches in a micro-batch; with the rows of a stretch they bound what one key can have in a batch
STEP_MS = 100  #: between the times of neighbouring files
BEYOND = "INTERVAL 3650 DAYS"  #: how far after the last row the end of input is stamped


def source(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A stored table, one file or a folder of them, as a stream of files in the order they were written."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}.parque[t]")  # a pattern, as a plain path has to be a folder


def replay(rows: DataFrame, time: str, files_per_trigger: int = TOGETHER, slices: int | None = None) -> DataFrame:
    """Stored rows as a stream in event time, with an end.

    One exchange by ranges of time writes a file for each stretch of about ``SLICE_ROWS`` rows, sorted by time. The stream
    reads files by their time of change, so the driver stamps them in the order of their stretches, whatever the order of
    the table's own files: a batch is some whole stretches, and no row comes after the watermark of an earlier batch. One
    last row, all NULL but for a time far beyond the others, moves the watermark past everything: open sessions and
    unmatched rows come out. Rows without a time come first."""
    spark = rows.sparkSession
    path = shared_path(spark, "replay")
    slices = slices or max(SLICES, -(-rows.count() // SLICE_ROWS))
    rows.repartitionByRange(slices, F.col(time)).sortWithinPartitions(time).write.parquet(path)
    end = rows.agg(F.max(time).alias("_end")).filter("_end IS NOT NULL")
    last = [F.expr(f"_end + {BEYOND}") if c == time else F.lit(None) for c in rows.columns]
    end = end.select(*(e.cast(rows.schema[c].dataType).alias(c) for e, c in zip(last, rows.columns)))
    stamp(spark, path, end)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files_per_trigger)).parquet(path)


def stamp(spark: SparkSession, path: str, end: DataFrame) -> None:
    """Give the files of a folder rising times of change by their names, then append the end of input behind them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    first = int(clock.time() * 1000) - STEP_MS * (len(files) + 1)
    for k, file in enumerate(files):
        store.setTimes(file, first + k * STEP_MS, -1)
    end.coalesce(1).write.mode("append").parquet(path)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all data at hand into a stored table and read that."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/quarte-stream-{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def keyed(
    stream: DataFrame,
    key: str,
    order: list[str],
    output: str,
    state_schema: str,
    first: tuple,
    step: Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]],
) -> DataFrame:
    """Apply ``step(state, sorted rows) -> (state, output rows)`` per key."""

    def work(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(order)
        now, out = step(state.get if state.exists else first, rows)
        state.update(now)
        yield out

    return stream.groupBy(key).applyInPandasWithState(
        work, output, state_schema, "append", GroupStateTimeout.NoTimeout
    )


def dedup(stream: DataFrame, device: str, order: list[str], seq: str, output: str) -> DataFrame:
    """Drop main frames that repeat the sequence just before; hit frames stay."""

    def step(state: tuple, rows: pd.DataFrame):
        main = rows[rows[seq].notna()]
        before = main[seq].shift(1)
        if len(main):
            before.iloc[0] = state[0] if state[0] >= 0 else float("nan")
        repeats = main.index[main[seq] == before]
        last = int(main[seq].iloc[-1]) if len(main) else state[0]
        return (last,), rows.drop(index=repeats)

    return keyed(stream, device, order, output, "last bigint", (-1,), step)


LIFE = "device bigint, start_idx bigint, event string, idx bigint"


def life_cycle(stream: DataFrame) -> DataFrame:
    """Match states per device over rows (device, ts, idx, kind).

    kind is start, ready, hit, end, cancel or result. Emits one row per accepted
    event; a new start preempts, hits count only while playing. The rows of a batch are one composition of transitions."""
    grid = np.array(devices.GRID, np.int64)
    number = {k: n for n, k in enumerate(devices.KINDS)}
    # what a kind of row says in each state
    said = np.full((len(grid), 4), None, object)
    said[number["start"], 1:] = "preempted"
    said[number["cancel"], 1:] = "cancelled"
    said[number["ready"], devices.PREPARING] = "playing"
    said[number["hit"], devices.PLAYING] = "signal"
    said[number["end"], devices.PLAYING] = "settling"
    said[number["result"], devices.PLAYING:] = "finished"

    def step(state: tuple, rows: pd.DataFrame):
        entry, match = state
        code = rows["kind"].map(number).fillna(len(number)).to_numpy(np.int64)
        first = np.arange(len(code)) == 0
        before = automata.scanned(grid, code, first, np.array([entry]))
        started = np.where(code == number["start"], rows["idx"], -1)
        at = np.maximum.accumulate(np.where(started >= 0, np.arange(len(code)), -1))
        now = np.where(at >= 0, started[at], match)
        event = said[code, before]
        out = pd.DataFrame({"device": rows["device"], "start_idx": np.append(match, now)[:-1], "event": event, "idx": rows["idx"]})
        return (int(grid[code[-1], before[-1]]), int(now[-1])), out[event != None]  # noqa: E711

    return keyed(stream, "device", ["ts", "idx"], LIFE, "phase int, start_idx bigint", (devices.IDLE, -1), step)


def live_tracks(detections: DataFrame, rules: tracking.TrackRules) -> DataFrame:
    """Track prepared detections as they arrive; the tracker is the state."""

    def step(state: tuple, rows: pd.DataFrame):
        tracker, last = pickle.loads(state[0]) if state[0] else (tracking.Tracker(rules), None)
        out = []
        for frame, part in rows.groupby("frame", sort=True):
            if last is not None and tracker.started:
                tracker.skip(int(frame) - last - 1)
            values = part[tracking.COLUMNS].to_numpy(dtype=float)
            dets = [tracking.Detection(int(i), v) for i, v in zip(part["det_idx"], values) if v[34] == v[34]]
            seen = tracker.update(dets)
            last = int(frame)
            for tid in (0, 1):
                d = seen.get(tid)
                out.append((rows["phrase_id"].iloc[0], last, tid, d.idx if d else None, d is not None))
        return (pickle.dumps((tracker, last)),), tracking.as_rows(out)

    return keyed(
        detections, "phrase_id", ["frame", "det_idx"], tracking.OUTPUT, "tracker binary", (b"",), step
    )


def silences(stream: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Sessions of a peer; a session ends when the peer is silent for ``gap``."""
    return (
        stream.withWatermark(time, gap)
        .groupBy(F.col(key), F.session_window(time, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("messages"))
        .select(key, F.col("session.start").alias("first_seen"), F.col("session.end").alias("lost_at"), "messages")
    )


def batch_nearest(signals: DataFrame, frames: DataFrame) -> DataFrame:
    """Batch form of the same match, without a time bound."""
    return asof.pick(asof.neighbours(signals, frames, ["user_id"], "ts", "frame"), "ts")
