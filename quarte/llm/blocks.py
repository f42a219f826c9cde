"""Blocks of neighbouring rows inside a task, and whole numbers packed into few bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from quarte.llm.common import blobs

SLICE = 256  #: rows whose texts are Python objects at a time


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[int, Iterator[tuple[pa.RecordBatch, list[bytes]]]]]:
    """Rows of a task in blocks of about ``size`` bytes of text: (number of the block, its rows in slices).

    Numbers follow from the task's own and the order of its rows, so a task that is run again gives the same ones; a
    block ends at the first row that fills it. The slices of a block must be read before the next block."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    rows = slices(batches, text)
    ahead = next(rows, None)
    k = 0

    def fill():
        nonlocal ahead
        held = 0
        while ahead is not None and held < size:
            now, ahead = ahead, next(rows, None)
            held += sum(map(len, now[1]))
            yield now

    while ahead is not None:
        yield (part << 32) + k, fill()
        k += 1


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            piece = batch.slice(at, SLICE)
            yield piece, blobs(piece.column(text))


class Numbers(dict):
    """Numbers of words in the order they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of seven bits, the last byte of a number below 128; and where each begins."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >= np.uint64(1 << bits)
        if not more.any():
            break
        width += more
    begin = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        byte = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[begin[has] + k] = byte.astype(np.uint8) | np.where(width[has] > k + 1, 128, 0).astype(np.uint8)
    return out, begin


def unpack(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    width = end - begin + 1
    out = np.zeros(len(end), np.int64)
    for k in range(int(width.max(initial=0))):
        has = width > k
        out[has] |= (data[begin[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Strings of bytes between neighbouring edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))
