"""Token ids stored under Re-Pair grammars, one per shard, with random access.

Documents are dealt by ranges of doc_id and cut into shards of about ``SHARD`` ids. In a shard frequent pairs of
neighbouring symbols are replaced by new symbols, again and again: each round counts the pairs, ranks those that stand
at least ``LEAST`` times by their count, replaces where a pair outranks the pairs that overlap it, and adds a rule for
each pair replaced often enough. It ends when a round shortens the sequence by less than ``GAIN``.

A shard is stored as one binary record: header, steps between doc ids, ids per document and expansion lengths of the rules
as numbers of seven bits a byte, then the rules (two symbols each) and the remaining symbols, packed with just the bits that
the largest symbol needs. The lengths summed over the symbols tell which symbols hold a range of ids, so a document is
decoded by expanding only those.

Defined results: a missing text is empty and holds the end id alone; missing doc_ids come first; rows that repeat a
doc_id follow each other in order of their text; an empty table has no shards."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.llm.blocks import pack, unpack
from quarte.llm.common import blobs, longs, parts, stage
from quarte.llm.running import before
from quarte.llm.tokens import TOKENIZER, groups, words

SHARD = 1 << 20  #: ids in a shard, but for a longer last document
LEAST = 4  #: times that a pair must be replaced
GAIN = 0.01  #: share of the sequence that a further round must save
FEW = 0.75  #: share of the pairs below which those to count are picked
MAGIC = b"RPG2"
HEAD = struct.Struct("<4sIQQQQQQQ")  #: magic, first new symbol, documents, ids, rules, symbols, bytes of the three lists
NO_ID = -(2**63)


def winners(rank: np.ndarray) -> np.ndarray:
    """Places that outrank both neighbours; in a stretch of one rank that outranks what is around it, every other place.

    Equal neighbours are a symbol repeated, or pairs that share a slot; either way places taken never touch."""
    over, under = np.ones(len(rank), bool), np.ones(len(rank), bool)  # than what is before and behind
    np.greater(rank[1:], rank[:-1], out=over[1:])
    np.greater(rank[:-1], rank[1:], out=under[:-1])
    equal = np.flatnonzero(~(over[1:] | under[:-1]) & (rank[1:] > 0))
    over[:1], under[-1:] = rank[:1] > 0, rank[-1:] > 0
    single = np.flatnonzero(over & under)
    if not len(equal):
        return single
    first = np.concatenate([[True], np.diff(equal) > 1])
    start = equal[first]
    size = np.diff(np.append(np.flatnonzero(first), len(equal))) + 1
    top = over[start] & under[start + size - 1]
    start, half = start[top], (size[top] + 1) // 2
    inside = np.repeat(start - 2 * (np.cumsum(half) - half), half) + 2 * np.arange(half.sum())
    return np.concatenate([single, inside])


def distinct(key: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in rising order, the number of each key's, and how often each stands; equal keys share a group. Mostly
    a group holds one key, so few keys are sorted."""
    last = np.zeros(groups, np.uint64)
    last[group] = key
    other = np.flatnonzero(last[group] != key)
    more, at_more = np.unique(key[other], return_inverse=True)
    at = group.copy()
    at[other] = groups + at_more
    used = np.bincount(at, minlength=groups + len(more))
    held = np.flatnonzero(used)
    keys = np.concatenate([last, more])[held]
    rising = np.argsort(keys)
    number = np.empty(len(used), np.int64)
    number[held[rising]] = np.arange(len(held))
    return keys[rising], number[at], used[held[rising]]


def replace_round(seq: np.ndarray, first_new: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over a sequence: the shorter sequence, the pairs behind its new symbols, and its pairs to count next.

    Pairs are counted in hashed slots, which sets the ranks; the pairs at the places taken are then counted exactly. ``live``
    tells where a pair begins that may stand often enough: one that is seldom found is never found more often later, so where
    such pairs are many, only those that were frequent or hold a new symbol are counted again."""
    none = np.zeros((0, 2), np.uint32)
    n = np.count_nonzero(live)
    if not n:
        return seq, none, live
    few = n < FEW * len(live)
    where = np.flatnonzero(live) if few else slice(len(live))
    a, b = seq[:-1][where], seq[1:][where]
    bits = max(8, len(a).bit_length())
    slot = ((a * np.uint32(0x9E3779B1)) ^ ((b * np.uint32(0x85EBCA6B)) >> np.uint32(7)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
    slot = slot.astype(np.int64)
    times = np.bincount(slot, minlength=1 << bits)
    held = np.flatnonzero(times >= LEAST)
    order = np.zeros(1 << bits, np.int32)
    order[held[np.argsort(times[held], kind="stable")]] = np.arange(1, len(held) + 1)
    rank = order[slot]
    if few:
        rank, some = np.zeros(len(live), np.int32), rank
        rank[where] = some
    place = winners(rank)
    key = (seq[place].astype(np.uint64) << np.uint64(32)) | seq[place + 1]
    pair, at, used = distinct(key, rank[place].astype(np.int64) - 1, len(held))
    often = used >= LEAST
    place, at = place[often[at]], at[often[at]]
    if not len(place):
        return seq, none, live
    symbol = (first_new + np.cumsum(often) - 1).astype(np.uint32)
    pair = pair[often]
    rules = np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
    out = seq.copy()
    out[place] = symbol[at]
    stay = np.ones(len(seq), bool)
    stay[place + 1] = False
    live = rank > 0
    live[np.maximum(place, 1) - 1] = True
    stay = np.flatnonzero(stay)
    return out[stay], rules, live[stay[:-1]]


def compress(ids: np.ndarray, first_new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and expansion lengths of a sequence of ids below ``first_new``."""
    seq, rules, size = ids.astype(np.uint32), np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    live = np.ones(max(len(seq) - 1, 0), bool)
    while True:
        shorter, new, live = replace_round(seq, first_new + len(rules), live)
        if len(new):
            rules = np.concatenate([rules, new])
            size = np.concatenate([size, lengths_of(new, size, first_new).sum(1)])
        saved, seq = len(seq) - len(shorter), shorter
        if saved <= GAIN * len(seq):
            return seq, rules, size


def lengths_of(symbols: np.ndarray, size: np.ndarray, first_new: int) -> np.ndarray:
    out = np.ones(symbols.shape, np.int64)
    new = symbols >= first_new
    out[new] = size[symbols[new].astype(np.int64) - first_new]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first_new: int, size: np.ndarray) -> np.ndarray:
    """Ids of symbols; ``size`` has the lengths of the rules, so that every symbol is written at its place at once and
    only those with a rule are looked at again."""
    n = lengths_of(symbols, size, first_new)
    place = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint32)
    while True:
        new = symbols >= first_new
        # what still has a rule is written too, and overwritten by its first symbol later
        out[place] = symbols
        if not new.any():
            return out
        place = place[new]
        pair = rules[symbols[new].astype(np.int64) - first_new]
        place = np.concatenate([place, place + lengths_of(pair[:, 0], size, first_new)])
        symbols = pair.T.ravel()


def packed(symbols: np.ndarray, bits: int) -> bytes:
    """Numbers with ``bits`` bits each, lowest first."""
    raw = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)
    places = np.unpackbits(raw, axis=1, count=bits, bitorder="little")
    return np.packbits(places.ravel(), bitorder="little").tobytes()


def unpacked(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Numbers of so many bits; eight of them fill whole bytes, so that those at one place among eight are shifted alike."""
    rows = -(-n // 8)
    raw = np.zeros(rows * bits, np.uint8)
    held = -(-n * bits // 8)
    raw[:held] = data[:held]
    raw, out = raw.reshape(rows, bits), np.empty((rows, 8), np.uint32)
    for k in range(8):
        at, skip = divmod(k * bits, 8)
        number = np.zeros(rows, np.uint64)
        for j in range(-(-(skip + bits) // 8)):
            number |= raw[:, at + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = (number >> np.uint64(skip)) & np.uint64((1 << bits) - 1)
    return out.ravel()[:n]


def write_shard(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray) -> bytes:
    first_new = int(ids.max()) + 1 if len(ids) else 0
    symbols, rules, size = compress(ids, first_new)
    bits = max(1, (first_new + len(rules)).bit_length())
    # doc ids rise, so their steps are small; the first may be any number and stands as it is
    first = doc_ids[:1].astype("<i8").tobytes()
    lists = [pack(np.diff(doc_ids))[0].tobytes(), pack(sizes)[0].tobytes(), pack(size)[0].tobytes()]
    head = HEAD.pack(MAGIC, first_new, len(doc_ids), len(ids), len(rules), len(symbols), *map(len, lists))
    return head + first + b"".join(lists) + packed(rules.ravel(), bits) + packed(symbols, bits)


class Shard:
    """A stored shard; ``ids`` decodes any range of it."""

    def __init__(self, record: bytes) -> None:
        magic, self.first_new, docs, self.n_ids, rules, symbols, *edges = HEAD.unpack_from(record)
        if magic != MAGIC:
            raise ValueError("not a grammar shard")
        data, at = np.frombuffer(record, np.uint8), HEAD.size
        first = np.frombuffer(record, "<i8", min(docs, 1), at)
        at += first.nbytes
        lists = []
        for n in edges:
            lists.append(unpack(data[at : at + n]))
            at += n
        steps, self.sizes, size = lists
        self.doc_ids = np.concatenate([first, first[:1] + np.cumsum(steps)])
        bits = max(1, (self.first_new + rules).bit_length())
        cut = at + -(-2 * rules * bits // 8)
        self.rules = unpacked(data[at:cut], 2 * rules, bits).reshape(-1, 2)
        self.symbols = unpacked(data[cut:], symbols, bits)
        self.size = size
        self.upto = np.cumsum(lengths_of(self.symbols, size, self.first_new))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def all(self) -> np.ndarray:
        """All ids: every rule is expanded once, and its ids are copied to where its symbol stands."""
        one = np.arange(self.first_new, dtype=np.uint32)
        rules = np.arange(self.first_new, self.first_new + len(self.rules), dtype=np.uint32)
        ids = np.concatenate([one, expand(rules, self.rules, self.first_new, self.size)])
        size = np.concatenate([np.ones(self.first_new, np.int64), self.size])
        n = size[self.symbols]
        begin = (np.cumsum(size) - size)[self.symbols] - (self.upto - n)
        at = np.repeat(begin, n)
        at += np.arange(len(at))
        return ids[at]

    def ids(self, start: int, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.upto, [start, start + n - 1], "right")
        got = expand(self.symbols[a : b + 1], self.rules, self.first_new, self.size)
        skip = start - (self.upto[a - 1] if a else 0)
        return got[skip : skip + n]


def shards(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Shards in order (part, number) with their ids: part, number, n_ids, record."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = words(tokenizer), TaskContext.get().partitionId(), 0
        ids, docs_of, sizes, held = [], [], [], 0

        def full() -> pa.RecordBatch:
            record = write_shard(np.concatenate(ids), np.concatenate(docs_of), np.concatenate(sizes))
            cols = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), longs([held]), pa.array([record], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "number", "n_ids", "record"])

        for batch in batches:
            texts, own = blobs(batch.column("text")), batch.column("doc_id").to_numpy()
            for piece in groups(texts):
                got, n = coder.encode(texts[piece])
                ids.append(got)
                docs_of.append(own[piece])
                sizes.append(n)
                held += len(got)
                if held >= SHARD:
                    yield full()
                    number, ids, docs_of, sizes, held = number + 1, [], [], [], 0
        if held:
            yield full()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(build, "part int, number int, n_ids long, record binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Per document of stored shards: doc_id, start among all ids, n_tokens, ids_crc32 of the decoded ids."""
    base = before(stored.select("part", "number", "n_ids"), "part", ["number"], "n_ids", "base").drop("n_ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, record in enumerate(batch.column("record")):
                s = Shard(record.as_py())
                raw = s.all().astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(s.starts.tolist(), s.sizes.tolist(), strict=True)]
                own = [pa.repeat(batch.column(c)[k], len(crc)) for c in ("part", "number")]
                cols = [*own, longs(s.doc_ids), longs(s.starts), longs(s.sizes), longs(crc)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "number", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = stored.select("part", "number", "record").mapInArrow(
        decode, "part int, number int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    out = rows.join(base, ["part", "number"])
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )
