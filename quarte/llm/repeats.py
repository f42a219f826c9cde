"""Suffix-array dedup by bucket-pointer refinement, over all documents.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier (smaller doc_id, or the same document
and an earlier start). Only starts of the same string need to meet, so suffixes are not fully sorted but refined bucket
by bucket until the buckets are strings of ``length`` bytes:

1. Initial q-gram buckets. A start lies in the bucket of the smallest q-gram hash in its string; neighbouring starts
   mostly share it and travel as one run (about one row for 35 bytes). Runs are dealt by bucket and sorted.
2. Within a bucket, runs are sorted by the bucket identifiers of their later offsets (the three that cover the run's
   bytes). Runs with equal identifiers are equal strings: all but the first repeat. A bucket with one string is done.
3. Only runs that meet different strings in their bucket, or hold its q-gram twice (periodic text), are refined to single starts: the identifiers of 64 bytes, got
   from those of 32, are used again at two offsets to name ``length`` bytes; starts are sorted by that name.

Identifiers are 64-bit hashes of the bytes; a start is named by 128 bits. A hot bucket holds one row per run of the
documents that share it, never pairs, and each document spreads over the buckets of all its runs.

Defined results: a missing text is empty; texts shorter than ``length`` lose nothing; a missing doc_id sorts before all
others; rows that repeat both doc_id and text are the same document and get the same result, each once per row; rows
with the same doc_id and other texts are told apart by a hash of the text. Columns with clashing names are kept as they
are by ``without_repeats``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarte.llm.common import blobs, free, keyed, longs, parts, stage

LENGTH = 100
Q = 48
RUN = LENGTH - Q + 1  #: q-grams in a string, and starts in a run at most
HALF = 64  #: bytes of the longest identifiers; two of them name LENGTH bytes, three the bytes of a run
PIECE = 1 << 19  #: bytes hashed at a time
NO_ID = -(2**63)
OWN = 128  #: added to the number of starts of a run in which starts can be equal
BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def identifiers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the Q and the 64 bytes from every offset, each made from two shorter ones.

    The data has LENGTH bytes at least."""
    h, step, factor, by_size = BYTE[np.frombuffer(data, np.uint8)], 1, int(ODD), {}
    while step < HALF:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % 2**64
        step *= 2
        by_size[step] = h, factor
    (quarter, shift), (half, _) = by_size[16], by_size[32]
    return half[:-16] * np.uint64(shift) + quarter[32:], h


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def periodic(key: np.ndarray, bucket: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the bucket's q-gram stands twice in the strings of a run, so that starts of the run can be equal."""
    wide = 2 * RUN - 1
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate([key, np.zeros(wide, np.uint64)]), wide)[first]
    found = (near == bucket[first][:, None]) & (np.arange(wide) < (n + RUN - 1)[:, None])
    return found.sum(1) > 1


def runs_of(data: bytes, ends: list[int]) -> tuple[np.ndarray, ...]:
    """Bucket, identifier of the covered bytes, first start and number of starts of every run in a row of texts, and
    whether starts inside the run can be equal."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    short, long = identifiers(data)
    key = mixed(short)
    bucket = least(key, RUN)
    whole, begin = np.zeros(len(bucket), bool), 0
    for end in ends:
        if end - begin >= LENGTH:
            whole[begin : end - LENGTH + 1] = True
        begin = end
    differs = np.empty(len(bucket), bool)
    differs[0] = True
    np.not_equal(bucket[1:], bucket[:-1], out=differs[1:])
    differs[1:] |= ~whole[:-1]
    first = np.flatnonzero(whole & differs)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    stop = np.empty(len(bucket), bool)
    stop[-1] = True
    stop[:-1] = differs[1:] | ~whole[1:]
    last = np.flatnonzero(whole & stop)
    n = last - first + 1
    pieces = -(-n // RUN)
    if (pieces > 1).any():
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, total = np.repeat(first, pieces) + k * RUN, np.repeat(n, pieces)
        first, n = start, np.minimum(RUN, total - k * RUN)
    size = n + LENGTH - 1
    far = size - HALF
    name = mixed(long[first]) * ODD + mixed(long[first + far // 2])
    name = mixed(name) * ODD + mixed(long[first + far]) + size.astype(np.uint64)
    own = periodic(key, bucket, first, n)
    return bucket[first].view(np.int64), mixed(name).view(np.int64), first, n, own


def chunks(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Bytes to hash together and, for each text in them, its index, offset there and offset in the text."""
    data, held, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PIECE):
            part = text[at : at + PIECE + LENGTH - 1] if len(text) > PIECE else text
            held.append((i, size, at))
            data.append(part)
            size += len(part)
            if size >= PIECE:
                yield b"".join(data), held
                data, held, size = [], [], 0
    if held:
        yield b"".join(data), held


ID = [T.StructField("doc_id", T.LongType()), T.StructField("twin", T.IntegerType())]
RUNS = T.StructType(
    [T.StructField("bucket", T.LongType()), T.StructField("name", T.LongType()), *ID, T.StructField("span", T.LongType())]
)
FOUND = T.StructType([*ID, T.StructField("span", T.LongType()), T.StructField("again", T.BooleanType())])
NAMED = T.StructType(
    [T.StructField("name", T.LongType()), T.StructField("rest", T.LongType()), *ID, T.StructField("span", T.LongType())]
)


def packed(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First start and number of starts in one number that sorts by the start."""
    return (first.astype(np.int64) << 8) | n.astype(np.int64)


def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = blobs(batch.column("text"))
        ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "twin"))
        for data, held in chunks(texts):
            offsets = np.array([h[1] for h in held], np.int64)
            bucket, name, first, n, own = runs_of(data, [*offsets[1:].tolist(), len(data)])
            if not len(first):
                continue
            which = np.searchsorted(offsets, first, "right") - 1
            index = np.array([h[0] for h in held], np.int64)[which]
            start = first - offsets[which] + np.array([h[2] for h in held], np.int64)[which]
            yield pa.RecordBatch.from_arrays(
                [longs(bucket), longs(name), pa.array(ids[index]), pa.array(twins[index]), longs(packed(start, n + OWN * own))],
                schema=RUN_ARROW,
            )


RUN_ARROW = pa.schema(
    [("bucket", pa.int64()), ("name", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int32()), ("span", pa.int64())]
)
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("twin", pa.int32()), ("span", pa.int64()), ("again", pa.bool_())])
NAMED_ARROW = pa.schema(
    [("name", pa.int64()), ("rest", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int32()), ("span", pa.int64())]
)


def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by bucket, name, document and start: the repeats, and what stays open: the first runs of buckets with
    several names, and first runs that can repeat in themselves."""
    last: tuple | None = None  # the row before
    head: tuple | None = None  # the first run of the last name, and whether it was given out
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch)
        before = [np.concatenate([[last[k] if last else 0], c[:-1]]).astype(c.dtype) for k, c in enumerate(rows)]
        bucket, name, doc, twin, span = rows
        new_name = (bucket != before[0]) | (name != before[1])
        same_row = ~new_name & (doc == before[2]) & (twin == before[3]) & (span == before[4])
        if last is None:
            new_name[0], same_row[0] = True, False
        last = tuple(c[-1] for c in rows)
        again = np.flatnonzero(~new_name & ~same_row)
        own, span = (span & OWN) > 0, span & ~OWN
        first = np.flatnonzero(new_name)
        b, d, t, s, o = bucket[first], doc[first], twin[first], span[first], own[first]
        given = np.zeros(len(first), bool)
        if head:
            b, d = np.concatenate([[head[0]], b]), np.concatenate([[head[1]], d])
            t = np.concatenate([[head[2]], t]).astype(np.int32)
            s, given = np.concatenate([[head[3]], s]), np.concatenate([[head[4]], given])
            o = np.concatenate([[False], o])
        if len(b):
            near = b[1:] == b[:-1]
            several = o.copy()
            several[1:] |= near
            several[:-1] |= near
            out = several & ~given
            head = (b[-1], d[-1], t[-1], s[-1], bool(several[-1] or given[-1]))
            d, t, s = d[out], t[out], s[out]
        else:
            d, t, s = doc[:0], twin[:0], span[:0]
        yield pa.RecordBatch.from_arrays(
            [
                longs(np.concatenate([doc[again], d])),
                pa.array(np.concatenate([twin[again], t]).astype(np.int32)),
                longs(np.concatenate([span[again], s])),
                pa.array(np.concatenate([np.ones(len(again), bool), np.zeros(len(d), bool)])),
            ],
            schema=FOUND_ARROW,
        )


def starts_in(spans: np.ndarray) -> np.ndarray:
    first, n = spans >> 8, spans & 255
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def to_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single starts of open runs, named by the identifiers at two offsets."""
    for batch in batches:
        texts, spans = blobs(batch.column("text")), batch.column("spans")
        ids, twins = batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist()
        for text, doc, twin, own in zip(texts, ids, twins, spans, strict=True):
            p = starts_in(np.sort(own.values.to_numpy()))
            for at in range(0, len(text), PIECE):
                here = p[(p >= at) & (p < at + PIECE)]
                if not len(here):
                    continue
                _, long = identifiers(text[at : at + PIECE + LENGTH - 1])
                name, rest = mixed(long[here - at]), mixed(long[here - at + LENGTH - HALF])
                n = len(here)
                yield pa.RecordBatch.from_arrays(
                    [
                        longs(name.view(np.int64)), longs(rest.view(np.int64)), longs(np.full(n, doc)),
                        pa.array(np.full(n, twin, np.int32)), longs(packed(here, np.ones(n, np.int64))),
                    ],
                    schema=NAMED_ARROW,
                )


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts sorted by name, document and place: all but the first of each name."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch)
        before = [np.concatenate([[last[k] if last else 0], c[:-1]]).astype(c.dtype) for k, c in enumerate(rows)]
        same = [c == b for c, b in zip(rows, before, strict=True)]
        found = same[0] & same[1] & ~(same[2] & same[3] & same[4])
        if last is None:
            found[0] = False
        last = tuple(c[-1] for c in rows)
        k = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [longs(rows[2][k]), pa.array(rows[3][k].astype(np.int32)), longs(rows[4][k]), pa.array(np.ones(len(k), bool))],
            schema=FOUND_ARROW,
        )


def known(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.hash("text").alias("twin"), "text"
    )


def resolved_runs(docs: DataFrame) -> DataFrame:
    runs = keyed(known(docs).mapInArrow(to_runs, RUNS), parts(docs.sparkSession), "bucket", "name", "doc_id", "twin", "span")
    return stage(runs.mapInArrow(resolve, FOUND))


def resolved_starts(docs: DataFrame, found: DataFrame) -> DataFrame:
    open_runs = found.filter(~F.col("again")).groupBy("doc_id", "twin").agg(F.collect_list("span").alias("spans"))
    starts = known(docs).join(open_runs, ["doc_id", "twin"]).mapInArrow(to_starts, NAMED)
    dealt = keyed(starts, parts(docs.sparkSession), "name", "rest", "doc_id", "twin", "span")
    return stage(dealt.mapInArrow(later, FOUND))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (first start, number of starts) of every document (doc_id, twin) whose strings also start earlier."""
    found = resolved_runs(docs)
    free(docs.sparkSession)
    single = resolved_starts(docs, found)
    free(docs.sparkSession)
    return found.filter("again").unionByName(single).select("doc_id", "twin", "span")


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that the strings from these starts cover, joined where they meet."""
    spans = np.sort(spans)
    begin, end = spans >> 8, (spans >> 8) + (spans & 255) + LENGTH - 1
    end = np.maximum.accumulate(end)
    cut = np.flatnonzero(begin[1:] > end[:-1])
    return begin[np.concatenate([[0], cut + 1])], end[np.concatenate([cut, [len(end) - 1]])]


def cut_out(text: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes that went and the number of maximal runs they form."""
    if spans is None or not len(spans):
        return text, 0, 0
    begin, end = merged(np.asarray(spans, np.int64))
    keep = np.concatenate([[0], end]), np.concatenate([begin, [len(text)]])
    left = b"".join(text[a:b] for a, b in zip(*keep, strict=True))
    return left, int((end - begin).sum()), len(begin)


def with_spans(docs: DataFrame, rows: DataFrame) -> DataFrame:
    spans = repeated_spans(docs).groupBy("doc_id", "twin").agg(F.collect_list("span").alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_id", "twin": "_twin", "spans": "_spans"})
    return rows.join(spans, ["_id", "_twin"], "left")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and runs, and the digest of what is left."""
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blobs(batch.column("text"))
            found = [cut_out(t, s.values) for t, s in zip(texts, batch.column("_spans"), strict=True)]
            cols = [
                batch.column("doc_id"), longs([len(t) for t in texts]), longs([f[1] for f in found]),
                longs([f[2] for f in found]), pa.array([hashlib.sha256(f[0]).hexdigest() for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = known(docs).withColumnsRenamed({"doc_id": "_id", "twin": "_twin"})
    rows = rows.withColumn("doc_id", F.nullif("_id", F.lit(NO_ID)))
    return with_spans(docs, rows).mapInArrow(digest, out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of text; n_chars, where present, is counted anew.

    A cut may fall inside a character; what is left of it goes too. A document that repeats entirely keeps an empty
    text, a missing text stays missing."""
    given = docs.columns
    packed_row = F.struct(*(F.col(c) for c in given if c != "text")).alias("_row")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.hash("text").alias("_twin"), "text", packed_row
    )
    joined = with_spans(docs, rows)
    out = T.StructType([joined.schema["_row"], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            left = [
                None if t is None else cut_out(t, s.values)[0].decode("utf-8", "ignore")
                for t, s in zip(texts, batch.column("_spans"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(left, pa.string())], names=["_row", "text"])

    cut_rows = joined.mapInArrow(cut, out).select("_row.*", "text")
    if "n_chars" in given:
        cut_rows = cut_rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut_rows.select(*given)
