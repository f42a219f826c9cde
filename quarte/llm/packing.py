"""Packing of token ids into sequences by Karmarkar-Karp multiway differencing.

A document is cut into pieces of the capacity and a rest. Pieces are dealt at random into blocks of bounded size; in a
block full pieces are sequences of their own, and the rests are spread over as many windows as their ids need at least:
every piece starts as a partial partition with one filled window, and the two partial partitions with the largest
differences are merged, the fullest window of one onto the emptiest of the other, until one is left. Its windows are
nearly equal. If the fullest exceeds the capacity, the number of windows rises by one and the block is done again.

Defined results: a missing text is empty and holds the end id alone; repeated rows are packed as often as they occur; a
missing doc_id stays missing; an empty table has no pieces. In a window pieces follow each other by doc_id, start and
order of the block."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.llm.common import blobs, longs, stage
from quarte.llm.running import before
from quarte.llm.tokens import TOKENIZER, groups, words

CAPACITY = 4096
BLOCK = 2048  #: pieces in a block, on average
NO_ID = -(2**63)


def spread(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of every piece and the windows' loads, by differencing over m windows."""
    if m == 1:
        return np.zeros(len(sizes), np.int64), np.array([sizes.sum()])
    # a node: (loads ascending, or the piece's size; left, right, slots in both)
    nodes: list[tuple] = [(int(s),) for s in sizes]
    heap = [(-int(s), k) for k, s in enumerate(sizes)]
    heapq.heapify(heap)

    def loads(node: tuple) -> np.ndarray:
        if len(node) > 1:
            return node[0]
        out = np.zeros(m, np.int64)
        out[-1] = node[0]
        return out

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = loads(nodes[a]) + loads(nodes[b])[::-1]
        order = np.argsort(total, kind="stable")
        total = total[order]
        nodes.append((total, a, b, order))
        nodes[a], nodes[b] = nodes[a][:1] if len(nodes[a]) == 1 else (None, *nodes[a][1:]), (
            nodes[b][:1] if len(nodes[b]) == 1 else (None, *nodes[b][1:])
        )
        heapq.heappush(heap, (int(total[0] - total[-1]), len(nodes) - 1))
    top = heap[0][1]
    window = np.zeros(len(sizes), np.int64)
    slots = {top: np.arange(m)}
    for k in range(top, -1, -1):
        at = slots.pop(k)
        if len(nodes[k]) == 1:
            window[k] = at[-1]
            continue
        _, a, b, order = nodes[k]
        # slot i of the sorted loads came from slot order[i] of a and its mirror in b
        back = np.empty(m, np.int64)
        back[order] = at
        slots[a], slots[b] = back, back[::-1]
    return window, loads(nodes[top])


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of every piece of a block; no window holds more than the capacity."""
    window = np.empty(len(sizes), np.int64)
    full = np.flatnonzero(sizes == capacity)
    rest = np.flatnonzero(sizes < capacity)
    window[full] = np.arange(len(full))
    if len(rest):
        m = -(-int(sizes[rest].sum()) // capacity)
        while True:
            found, loads = spread(sizes[rest], m)
            if loads.max() <= capacity:
                break
            m += 1
        window[rest] = len(full) + found
    return window


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words(tokenizer)
        for batch in batches:
            texts = blobs(batch.column("text"))
            for piece in groups(texts):
                ids, n = coder.encode(texts[piece])
                raw = ids.astype("<u4").tobytes()
                base = np.cumsum(n) - n
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, n[doc] - start)
                at = (base[doc] + start) * 4
                crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                own = batch.column("doc_id").slice(piece.start, piece.stop - piece.start).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [own, longs(start), longs(length), longs(crc), longs(n[doc])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block long, window long, offset long, windows long"


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence (numbered from 0 without gaps) and the offset in it."""
    cut = stage(pieces(docs, tokenizer, capacity).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))))
    n_blocks = max(1, -(-cut.count() // BLOCK))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable").reset_index(drop=True)
        frame["window"] = pack_block(frame["length"].to_numpy(np.int64), capacity)
        frame["offset"] = frame.groupby("window")["length"].cumsum() - frame["length"]
        frame["windows"] = int(frame["window"].max()) + 1
        return frame

    packed = stage(dealt.groupBy("block").applyInPandas(place, PACKED))
    blocks = packed.groupBy("block").agg(F.max("windows").alias("windows"))
    blocks = blocks.withColumn("hundred", F.expr("block div 1000"))
    base = before(blocks, "hundred", ["block"], "windows", "base").select("block", "base")
    out = packed.join(base, "block")
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("window")).alias("sequence_id"), "offset",
    )
