"""Ranked lexical search with Block-Max MaxScore over a sharded inverted index.

``index`` cuts the documents into shards of about ``SHARD`` bytes of text. A shard holds one posting list per term:
documents in doc_id order as steps, with term counts, packed in blocks of ``POSTINGS``. Beside each block stand its last
document, its first byte and its competitive (count, document length) pairs: those that no other posting of the block
beats in both. The best part score of a block under any corpus statistics is reached by one of these pairs, so the index
needs no second pass once they are known.

``search`` brings the lists of the queries' terms, with weights from the whole corpus, together per shard and block of
``QUERIES`` queries, and reads each query over growing ranges of documents:

* the lists with the smallest bounds that together can't reach the k-th best score are non-essential, the others are
  read in the range and give the candidates;
* a candidate goes through the non-essential lists, largest bound first, and is rejected as soon as its score, the
  maximum of its block in this list and the bounds of the lists left can't reach that score; only blocks that hold a
  candidate left are unpacked.

Every shard gives the k best of each query, and these heaps are merged by a window over the query, limited on the map
side first. A shard is bounded by its bytes, so no term or group of copies, however frequent, is one task.

Defined results: every row of the documents is a document of its own; missing texts have no terms; equal scores go to
the smaller doc_id, missing doc_ids last; a query without terms, or with terms that no document holds, gives no rows;
rows of the queries that are repeated as a whole count once; empty tables give no rows. Only the named columns are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarte.llm.blocks import Numbers, binary, blocks, lists, pack, unpack
from quarte.llm.common import longs, stage, unstage

SHARD = 1 << 25  #: bytes of text in a shard, about
POSTINGS = 128  #: postings in a block
QUERIES = 512  #: queries that meet a shard at a time, about
ROWS = 1 << 15  #: lists in an Arrow batch
UNIT = 1_000_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
#: Bytes of a text as they are read: separators are spaces, only A-Z are lower-cased.
READ = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

INDEX = (
    "shard long, term string, df long, last array<int>, starts array<int>, pairs array<int>, counts array<int>, "
    "lengths array<int>, body binary, ids array<long>, with_terms long, terms long"
)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the lists of each shard, and one row without a term for its documents."""
    for number, rows in blocks(batches, "text", SHARD):
        place, found, ids = Numbers(), [], []
        for piece, texts in rows:
            ids += piece.column("doc_id").to_pylist()
            found += [place.of(t.translate(READ).split()).astype(np.int32) for t in texts]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        found, ids = [found[k] for k in order], [ids[k] for k in order]
        length = np.array([len(f) for f in found], np.int64)
        yield from listed(number, list(place), np.concatenate(found), ids, length)


def listed(shard: int, terms: list[bytes], tokens: np.ndarray, ids: list, length: np.ndarray) -> Iterator[pa.RecordBatch]:
    key, tf = np.unique(tokens * np.int64(len(length)) + np.repeat(np.arange(len(length)), length), return_counts=True)
    term, doc = key // len(length), key % len(length)
    head = np.searchsorted(term, np.arange(len(terms) + 1))
    at = np.arange(len(key)) - np.repeat(head[:-1], np.diff(head))
    step = np.where(at == 0, doc + 1, np.diff(doc, prepend=0))
    data, begin = pack(np.stack([step, tf], 1).ravel())
    begin = np.append(begin[0::2], len(data))
    opens = np.flatnonzero(at % POSTINGS == 0)
    block = np.cumsum(at % POSTINGS == 0) - 1
    closes = np.append(opens[1:], len(key)) - 1 if len(opens) else opens
    # competitive pairs: shorter than every posting of the block that has the same count or a higher one
    n = length[doc]
    ranked = np.lexsort((n, -tf, block))
    fall = n[ranked] - block[ranked] * (n.max(initial=0) + 1)
    best = np.minimum.accumulate(fall)
    keep = ranked[np.concatenate([[True], fall[1:] < best[:-1]])] if len(fall) else ranked
    pairs = np.bincount(block[keep], minlength=len(opens))
    lists_at = np.searchsorted(opens, head)  # first block of each list
    pairs_at = np.concatenate([[0], np.cumsum(pairs)])
    for a in range(0, len(terms), ROWS):
        b = min(a + ROWS, len(terms))
        blk, byte = lists_at[a : b + 1], begin[head[a : b + 1]]
        some, two = slice(blk[0], blk[-1]), pairs_at[blk]
        of = keep[two[0] : two[-1]]
        edges = blk - blk[0]
        cols = [
            longs(np.full(b - a, shard)), pa.array(terms[a:b], pa.binary()).cast(pa.string()), longs(np.diff(head[a : b + 1])),
            lists(doc[closes[some]], edges, pa.int32()),
            lists(begin[opens[some]] - np.repeat(byte[:-1], np.diff(blk)), edges, pa.int32()),
            lists(pairs[some], edges, pa.int32()),
            lists(tf[of], two - two[0], pa.int32()), lists(n[of], two - two[0], pa.int32()),
            binary(data[byte[0] : byte[-1]], byte - byte[0]),
            pa.nulls(b - a, pa.list_(pa.int64())), *[pa.nulls(b - a, pa.int64())] * 2,
        ]
        yield pa.RecordBatch.from_arrays(cols, names=NAMES)
    ints = pa.list_(pa.int32())
    cols = [
        longs([shard]), pa.nulls(1, pa.string()), longs([0]), *[pa.nulls(1, ints)] * 4,
        pa.array([length.tolist()], ints), pa.nulls(1, pa.binary()), pa.array([ids], pa.list_(pa.int64())),
        longs([int((length > 0).sum())]), longs([int(length.sum())]),
    ]
    yield pa.RecordBatch.from_arrays(cols, names=NAMES)


NAMES = [c.split(" ")[0] for c in INDEX.split(", ")]


def index(docs: DataFrame) -> DataFrame:
    """The stored index of (doc_id, text)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(given.mapInArrow(build, INDEX))


class Postings:
    """One list of a shard; blocks are unpacked when they are asked for, once for all queries."""

    def __init__(self, weight: int, df: int, last, starts, most, body: np.ndarray, m: np.ndarray) -> None:
        self.weight, self.last, self.body, self.m = weight, last, body, m
        self.starts = np.append(starts, len(body))
        self.most = most * weight
        self.bound = int(self.most.max())
        self.open = np.zeros(len(last), bool)
        # documents of a packed block read as its last one, so that the whole stays sorted
        self.docs = np.repeat(last, POSTINGS)[:df].astype(np.int64)
        self.parts = np.zeros(df, np.int64)

    def unpack(self, which: np.ndarray) -> None:
        which = which[~self.open[which]]
        if not len(which):
            return
        for run in np.split(which, np.flatnonzero(np.diff(which) > 1) + 1):
            a, b = run[0], run[-1] + 1
            values = unpack(self.body[self.starts[a] : self.starts[b]])
            docs, tf = (self.last[a - 1] if a else -1) + np.cumsum(values[0::2]), values[1::2]
            to = slice(a * POSTINGS, a * POSTINGS + len(docs))
            self.docs[to], self.parts[to] = docs, self.weight * part(tf, self.m[docs])
        self.open[which] = True

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.last, (lo, hi - 1))
        self.unpack(np.arange(a, min(b + 1, len(self.last))))
        a, b = np.searchsorted(self.docs, (lo, hi))
        return self.docs[a:b], self.parts[a:b]

    def block_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that may hold the documents (their number where none does) and their maxima."""
        at = np.searchsorted(self.last, docs)
        return at, np.append(self.most, 0)[at]

    def of(self, docs: np.ndarray) -> np.ndarray:
        """Parts of documents whose blocks are unpacked."""
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[at] == docs, self.parts[at], 0)


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tf // (1000 * tf + 12 * m)


def best(query: list[tuple[Postings, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents above 0 of one query, best first, and their scores; equal scores in document order."""
    query = sorted(query, key=lambda q: q[0].bound * q[1])
    upto = np.cumsum([0] + [p.bound * times for p, times in query])
    docs = scores = np.zeros(0, np.int64)
    least, lo, width = 1, 0, 256  # a later document with the k-th best score comes after it: it has to be better
    while lo < n_docs:
        hi = min(lo + width, n_docs)
        essential = int(np.searchsorted(upto[1:], least))
        if essential == len(query):
            break
        total = np.zeros(hi - lo, np.int64)
        for p, times in query[essential:]:
            d, parts = p.between(lo, hi)
            total[d - lo] += parts * times
        left = np.flatnonzero(total)
        total, left = total[left], left + lo
        for i in range(essential - 1, -1, -1):
            p, times = query[i]
            block, most = p.block_of(left)
            keep = total + most * times + upto[i] >= least
            total, left, block = total[keep], left[keep], block[keep]
            if not len(left):
                break
            p.unpack(np.unique(block[block < len(p.last)]))
            total = total + p.of(left) * times
        keep = total >= least
        docs, scores = np.append(docs, left[keep]), np.append(scores, total[keep])
        if len(docs) >= k:
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            least = int(scores[-1]) + 1
        lo, width = hi, min(width * 2, 8192)
    order = np.lexsort((docs, -scores))
    return docs[order], scores[order]


def searcher(with_terms: int, terms: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Queries of one shard: lists with their weights and uses, and the shard's documents."""

    def run(rows: pa.Table, documents: pa.Table) -> pa.Table:
        out = ([], [], [])
        if rows.num_rows:
            ids = documents.column("ids").combine_chunks().flatten()
            n = documents.column("n").combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 75 + 25 * n * with_terms // terms
            for item, query in queries(rows, m, with_terms, terms).items():
                docs, scores = best(query, len(n), k)
                out[0].append(np.full(len(docs), item))
                out[1].append(docs)
                out[2].append(scores)
        item, docs, scores = (np.concatenate([np.zeros(0, np.int64), *c]) for c in out)
        found = ids.take(pa.array(docs)) if rows.num_rows else longs([])
        return pa.Table.from_arrays([longs(item), found, longs(scores)], names=["item", "doc_id", "score"])

    return run


def queries(rows: pa.Table, m: np.ndarray, with_terms: int, terms: int) -> dict[int, list[tuple[Postings, int]]]:
    def ragged(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows.column(name).combine_chunks()
        edges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), edges

    last, block = ragged("last")
    starts, pairs = ragged("starts")[0], ragged("pairs")[0]
    tf, n = ragged("counts")[0], ragged("lengths")[0]
    first = np.cumsum(pairs) - pairs
    most = np.maximum.reduceat(part(tf, 75 + 25 * n * with_terms // terms), first)
    out: dict[int, list] = {}
    fixed = zip(rows.column("weight").to_pylist(), rows.column("df").to_pylist(), rows.column("body").to_pylist(), rows.column("uses").to_pylist(), strict=True)
    for k, (weight, df, body, uses) in enumerate(fixed):
        of = slice(block[k], block[k + 1])
        listing = Postings(weight, df, last[of], starts[of], most[of], np.frombuffer(body, np.uint8), m)
        for use in uses:
            out.setdefault(use["item"], []).append((listing, use["times"]))
    return out


def cut(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(TERM), F.lit(1))


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each row of (item_id, text): (item_id, rank, doc_id, score)."""
    held = index.filter("term IS NULL")
    with_terms, terms = held.agg(F.sum("with_terms"), F.sum("terms")).first()
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    items = stage(items.withColumn("item", F.monotonically_increasing_id()))
    parts = max(1, -(-items.count() // QUERIES))
    words = items.select("item", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part"), F.explode(cut(F.col("text"))).alias("term"))
    uses = words.groupBy("part", "term", "item").agg(F.count(F.lit(1)).alias("times"))
    uses = stage(uses.groupBy("part", "term").agg(F.collect_list(F.struct("item", "times")).alias("uses")))
    lists_ = index.filter("term IS NOT NULL")
    df = lists_.select("term", "df").join(uses.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("_df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * (with_terms or 0) + 2) / (2 * F.col("_df") + 1).cast("double")))
    # stored, so that Spark knows its size and can send it to the lists where it is small
    uses = stage(uses.join(df, "term").withColumn("weight", weight).filter("weight > 0").select("part", "term", "uses", "weight"))
    rows = lists_.join(uses, "term").select("shard", "part", "weight", "uses", "df", "last", "starts", "pairs", "counts", "lengths", "body")
    documents = held.select(F.col("shard").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("of_part"), "ids", F.col("lengths").alias("n"))
    run = searcher(with_terms or 0, terms or 1, k)
    heaps = rows.groupBy("shard", "part").cogroup(documents.groupBy("of", "of_part")).applyInArrow(run, "item long, doc_id long, score long")
    order = W.Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranking(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index the documents, search them for every item and drop the index."""
    made = index(docs)
    found = stage(search(made, items, k))
    unstage(made)
    return found
