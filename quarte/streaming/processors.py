"""Keyed processors with event-time timers: results against a time limit, nearest frames, gates by control rows.

Rows come in any order inside a micro-batch and, up to the watermark's delay, between micro-batches. A processor puts them
on its shelf and sets one timer at their latest time. When the watermark has passed it, nothing earlier can come, and the
rows up to that time are worked on in order of time, as arrays. So results don't depend on the order of files, and a key
keeps what is still open and nothing else.

A call into Spark's state costs about a millisecond, however few rows it moves. So keys share ``BUCKETS`` buckets, a bucket
works on the rows of all its keys at once, and state and timers are the bucket's: rows of a call are one packed array, and
calls follow buckets and micro-batches, not keys."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PACK = T.StructType([T.StructField("rows", T.BinaryType())])  #: rows of 64-bit numbers, one after the other
BUCKETS = 1 << 9  #: groups of keys with state of their own
NONE = -(2**62)  #: time of what isn't there
KEY, TS, KIND, IDX, NEAR_TS, NEAR = range(6)  #: columns of a row; the last two only of open ones


def packed(rows: np.ndarray) -> tuple[bytes]:
    return (np.ascontiguousarray(rows, np.int64).tobytes(),)


def unpacked(state, width: int) -> np.ndarray:
    """Rows of a list state, in the order they were put there."""
    return np.frombuffer(b"".join(bytes(r[0]) for r in state.get()), np.int64).reshape(-1, width)


def codes(*tables: np.ndarray) -> list[np.ndarray]:
    """A number for every row of tables of rows, in the order of key and time."""
    both = np.concatenate([t[:, [KEY, TS]] for t in tables])
    key, time = (np.unique(both[:, c], return_inverse=True)[1].astype(np.int64) for c in (0, 1))
    code = key * (len(both) + 1) + time
    return np.split(code, np.cumsum([len(t) for t in tables])[:-1])


def firsts(rows: np.ndarray) -> np.ndarray:
    """Of rows in order, the first of each key and time."""
    same = (rows[1:, KEY] == rows[:-1, KEY]) & (rows[1:, TS] == rows[:-1, TS])
    return rows[np.concatenate([[True], ~same])] if len(rows) else rows


def at_place(rows: np.ndarray, place: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row at each place, and whether there is one with the key of ``given``."""
    if not len(rows):
        return np.zeros((len(given), rows.shape[1]), np.int64), np.zeros(len(given), bool)
    met = rows[np.clip(place, 0, len(rows) - 1)]
    return met, (place >= 0) & (place < len(rows)) & (met[:, KEY] == given[:, KEY])


class Ordered(StatefulProcessor):
    """Rows (key, ts in milliseconds, kind, idx) of a bucket of keys in order of time, and rows that stay open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shelf = handle.getListState("shelf", PACK)
        self.open = handle.getListState("open", PACK)
        self.passed = {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            pdf = pdf[pdf["idx"].notna()]
            if len(pdf):
                given = pdf[["key", "ts", "kind", "idx"]].astype("int64").to_numpy()
                self.shelf.appendValue(packed(given))
                last = int(given[:, TS].max())
                latest = last if latest is None else max(latest, last)
        if latest is not None:
            self.handle.registerTimer(self.due(latest))
        return iter([])

    def due(self, latest: int) -> int:
        """Time at which rows up to ``latest`` are worked on."""
        return latest

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the watermark may be far beyond this timer, and no batch may follow that would fire one set now
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if self.passed.get(key, until - 1) >= until:
            return  # another timer of the bucket has done it
        self.passed[key] = until
        held = unpacked(self.shelf, IDX + 1)
        now = held[:, TS] <= until
        if not now.all():
            self.shelf.put([packed(held[~now])])
        elif len(held):
            self.shelf.clear()
        rows = held[now]
        rows = rows[np.lexsort((rows[:, IDX], rows[:, KIND], rows[:, TS], rows[:, KEY]))]
        opened = unpacked(self.open, NEAR + 1)
        out, left = self.work(rows, opened, until)
        if len(left):
            self.open.put([packed(left)])
        elif len(opened):
            self.open.clear()
        if len(out):
            yield out

    def work(self, rows: np.ndarray, opened: np.ndarray, until: int) -> tuple[pd.DataFrame, np.ndarray]:
        """Output rows and what stays open, from rows in order of key and time, open rows, and the time that has passed."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class ResultTimer(Ordered):
    """Rounds that wait for their result: kind 0 is the end of a round, kind 1 a result.

    A round is settled by the first result from its end on. After ``limit`` without one it is given up with code 0, once;
    a result that comes later still replaces it, once."""

    END, RESULT = 0, 1
    OUTPUT = "user_id long, event_id long, said string, result_id long, wait_ms long"

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def work(self, rows, opened, until):
        ends = np.concatenate([opened, np.pad(rows[rows[:, KIND] == self.END], ((0, 0), (0, 2)))])
        results = firsts(rows[rows[:, KIND] == self.RESULT])
        from_end, found = codes(ends, results)
        met, has = at_place(results, np.searchsorted(found, from_end), ends)
        wait = np.where(has, met[:, TS] - ends[:, TS], self.limit + 1)
        late = wait > self.limit
        over = late & (has | (ends[:, TS] + self.limit < until))  # its timer has fired, or would have before the result
        warned = ends[:, NEAR_TS] == 1
        said = {"in_time": has & ~late, "timeout": over & ~warned, "backfill": has & late}
        parts = [self._said(ends[m], word, met[m], wait[m]) for word, m in said.items()]
        left = ends[~has].copy()
        left[:, NEAR_TS] = np.where(over[~has], 1, left[:, NEAR_TS])
        waiting = left[left[:, NEAR_TS] == 0]
        if len(waiting):  # the next ones get theirs when this one fires
            self.handle.registerTimer(int(waiting[:, TS].min()) + self.limit + 1)
        parts = [p for p in parts if len(p)]
        return (pd.concat(parts) if parts else []), left

    def _said(self, ends, word, met, wait):
        shown = word != "timeout"
        cols = {"user_id": ends[:, KEY], "event_id": ends[:, IDX], "said": word, "result_id": met[:, IDX], "wait_ms": wait}
        out = pd.DataFrame(cols, index=range(len(ends)))
        return out if shown else out.assign(result_id=pd.array([None] * len(out), "Int64"), wait_ms=pd.array([None] * len(out), "Int64"))


class Nearest(Ordered):
    """The nearest frame of each signal no more than ``bound`` away, the earlier one on a tie: kind 0 is a frame, kind 1 a
    signal. A signal is open until a frame at or after it has come or ``bound`` has passed; what stays are the open signals,
    each with the frame before it, and the latest frame of a key while a signal to come may be near it."""

    FRAME, SIGNAL = 0, 1
    OUTPUT = "user_id long, idx long, frame long"

    def __init__(self, bound: int) -> None:
        self.bound = bound

    def work(self, rows, opened, until):
        latest = opened[opened[:, KIND] == self.FRAME]
        frames = np.concatenate([latest[:, : IDX + 1], rows[rows[:, KIND] == self.FRAME]])
        # of frames at the same time the smallest idx counts
        frames = firsts(frames[np.lexsort((frames[:, IDX], frames[:, TS], frames[:, KEY]))])
        new = rows[rows[:, KIND] == self.SIGNAL]
        at, mine = codes(frames, new)
        near, fits = at_place(frames, np.searchsorted(at, mine, "right") - 1, new)
        fits &= new[:, TS] - near[:, TS] <= self.bound
        new = np.column_stack([new, np.where(fits, near[:, TS], NONE), near[:, IDX]])
        signals = np.concatenate([opened[opened[:, KIND] == self.SIGNAL], new])
        at, mine = codes(frames, signals)
        following, has = at_place(frames, np.searchsorted(at, mine), signals)
        ahead = np.where(has, following[:, TS] - signals[:, TS], self.bound + 1)
        back = np.where(signals[:, NEAR_TS] == NONE, self.bound + 1, signals[:, TS] - signals[:, NEAR_TS])
        done = has | (signals[:, TS] + self.bound < until)
        frame = np.where(back <= ahead, signals[:, NEAR], following[:, IDX])
        found = np.minimum(back, ahead) <= self.bound
        out = pd.DataFrame({"user_id": signals[done, KEY], "idx": signals[done, IDX], "frame": pd.array(frame[done], "Int64")}, index=range(int(done.sum())))
        out.loc[~found[done], "frame"] = pd.NA
        left = signals[~done]
        if len(left):  # the next ones get theirs when this one fires
            self.handle.registerTimer(int(left[:, TS].min()) + self.bound + 1)
        last = frames[np.append(frames[1:, KEY] != frames[:-1, KEY], True)] if len(frames) else frames
        last = last[last[:, TS] + self.bound >= until]
        return out, np.concatenate([left, np.pad(last, ((0, 0), (0, 2)))])


class Gate(StatefulProcessor):
    """Frames from the active mark of their key on, renumbered; frames wait until the mark has come.

    A row with ``mark`` is a control row; the first one of a key counts."""

    OUTPUT = "user_id long, frame long, ts long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", T.StructType([T.StructField("mark", T.LongType())]))
        self.held = handle.getListState("held", T.StructType([T.StructField("frame", T.LongType()), T.StructField("ts", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()
        mark = None if mark is None else int(mark[0])
        for pdf in rows:
            marks = pdf["mark"].dropna()
            if mark is None and len(marks):
                mark = int(marks.min())
                self.mark.update((mark,))
                waiting = pd.DataFrame(list(self.held.get()), columns=["frame", "ts"])
                self.held.clear()
                yield self.passed(key[0], waiting, mark)
            frames = pdf.loc[pdf["frame"].notna(), ["frame", "ts"]].astype("int64")
            if mark is not None:
                yield self.passed(key[0], frames, mark)
            elif len(frames):
                self.held.appendList(list(frames.itertuples(index=False, name=None)))

    @staticmethod
    def passed(user: int, frames: pd.DataFrame, mark: int) -> pd.DataFrame:
        frames = frames[frames["frame"] >= mark]
        return pd.DataFrame({"user_id": user, "frame": frames["frame"] - mark, "ts": frames["ts"]})

    def close(self) -> None:
        pass


class Routing(Ordered):
    """Messages of matches that were started and never cancelled: kind 0 is a message, 1 also starts its match, 2 also
    cancels it. A match is over when nothing has come for ``idle``; its messages wait until then.

    Waiting messages stay packed on the shelf. They are looked at when an eighth of ``idle`` ends, so that a message is
    moved a few times and no more, however many micro-batches come meanwhile."""

    MESSAGE, START, CANCEL = 0, 1, 2
    LOOKS = 8
    OUTPUT = "match_id long, idx long"

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def due(self, latest):
        step = max(1, self.idle // self.LOOKS)
        return -(-(latest + self.idle + 1) // step) * step

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if self.passed.get(key, until - 1) >= until:
            return
        self.passed[key] = until
        held = unpacked(self.shelf, IDX + 1)
        if not len(held):
            return
        held = held[np.argsort(held[:, KEY], kind="stable")]
        first = np.flatnonzero(np.append(True, held[1:, KEY] != held[:-1, KEY]))
        rows = np.diff(np.append(first, len(held)))
        over = np.repeat(np.maximum.reduceat(held[:, TS], first) + self.idle < until, rows)
        starts, cancels = (np.add.reduceat((held[:, KIND] == k).astype(np.int64), first) > 0 for k in (self.START, self.CANCEL))
        out = held[over & np.repeat(starts & ~cancels, rows)]
        if not over.all():
            self.shelf.put([packed(held[~over])])
        else:
            self.shelf.clear()
        if len(out):
            yield pd.DataFrame({"match_id": out[:, KEY], "idx": out[:, IDX]})


def timed(rows: DataFrame, key: str, at: str, delay: str, processor: StatefulProcessor) -> DataFrame:
    """Run an event-time processor over rows (key, at TIMESTAMP, ts, kind, idx) of a stream.

    Keyed state of this kind needs the RocksDB store, so the setting is made where another store is set."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    dealt = rows.withWatermark(at, delay).select(bucket.alias("bucket"), F.col(key).alias("key"), at, "ts", "kind", "idx")
    return dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def gated(rows: DataFrame, key: str) -> DataFrame:
    """Run the gate over rows (key, frame, ts, mark) of a stream."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Gate(), outputStructType=Gate.OUTPUT, outputMode="Append", timeMode="None")
