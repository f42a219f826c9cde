"""Source divergence audit by chunk factorization.

Which sources of a language use words unlike one another, and which words set a source apart?

1. A pass over the whole texts counts white-space chunks per document. Documents are dealt into blocks of about
   ``BLOCK`` bytes; each chunk of a block gives one row with its packed (document, group, count) postings.
2. Rows are sorted by chunk, so that every chunk that is distinct over all blocks is cut into terms once; the terms take
   over the chunk's postings.
3. Rows are sorted by term and block. The postings of a block that lead to one term are joined, which gives its documents
   and occurrences per language and source, and one aggregation sums them. A term is dealt over as many tasks as there
   are spans of ``SPAN`` tasks of the first pass, so a term of all documents is no task of its own.
4. Terms in at least ``min_docs`` documents of a language are kept. A source's smoothed share of a kept term is compared
   with those of every other source of the language, and with the language's own.

Sums over the pairs of sources are made from blocks of terms: bands of ``BAND`` sources meet as matrices, so no row is
made for a pair and a term. A hot source or language is no task of its own: blocks are cut by bytes, counts are summed
before they are shuffled, shares are keyed by term, and a group's row goes to its shares over lanes. All sums are whole numbers.

Defined results: a missing text, language or source is the empty string; every row is a document of its own, whatever
its doc_id, so repeated rows count as often as they occur; an empty table gives no rows; a language without kept terms
gives its pairs with value 0; equal values are ranked by the item's bytes. Only the three columns named are read, so
others, and clashing names among them, are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarte.llm.blocks import Numbers, binary, blocks, pack, unpack
from quarte.llm.common import for_lanes, free, in_lanes, join_small, longs, stage, unstage

BLOCK = 1 << 25  #: bytes of text in a block, about
SPAN = 512  #: tasks of the first pass whose blocks of a term meet in one task
SMALL = 100_000  #: groups that are sent to every task; more are joined by a shuffle
TERMS = 4096  #: terms in a block of the pair sums, about
BAND = 256  #: sources that meet at a time
UNIT = 1_000_000_000
ROWS = 1 << 16  #: rows of an Arrow batch
#: Bytes of a chunk as its terms are read: only A-Z are lower-cased, other ASCII characters separate.
READ = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, text) -> (chunk, block, postings): a chunk's documents as steps, with their group and count."""
    for number, rows in blocks(batches, "text", BLOCK):
        place = Numbers()
        group, size, ids, times = [], [], [], []
        for piece, texts in rows:
            group.append(piece.column("g").to_numpy())
            for text in texts:
                one, n = np.unique(place.of(text.split()), return_counts=True)
                size.append(len(one))
                ids.append(one.astype(np.int32))
                times.append(n.astype(np.int32))
        chunk, doc, n = np.concatenate(ids), np.repeat(np.arange(len(size), dtype=np.int32), size), np.concatenate(times)
        ids = times = None
        order = np.argsort(chunk, kind="stable")
        chunk, doc, n = chunk[order], doc[order], n[order]
        head = np.searchsorted(chunk, np.arange(len(place) + 1))
        step = np.diff(doc, prepend=0)
        step[head[:-1]] = doc[head[:-1]]
        data, edge = packed(step, np.concatenate(group)[doc], n)
        edge = edge[head]
        words = list(place)
        for a in range(0, len(words), ROWS):
            b = min(a + ROWS, len(words))
            cols = [pa.array(words[a:b], pa.binary()).cast(pa.string()), longs(np.full(b - a, number))]
            cols.append(binary(data[edge[a] : edge[b]], edge[a : b + 1] - edge[a]))
            yield pa.RecordBatch.from_arrays(cols, names=["chunk", "block", "postings"])


def packed(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole numbers as bytes, packed some rows at a time, and where each begins and the last ends."""
    data, edges, used = [np.zeros(0, np.uint8)], [], 0
    for at in range(0, len(columns[0]), ROWS):
        some, begin = pack(np.stack([c[at : at + ROWS] for c in columns], 1).ravel())
        data.append(some)
        edges.append(begin[:: len(columns)] + used)
        used += len(some)
    return np.concatenate(data), np.concatenate([*edges, [used]])


def starts(column: pa.Array) -> np.ndarray:
    """Where runs of equal values begin."""
    if len(column) < 2:
        return np.zeros(len(column), np.int64)
    return np.concatenate([[0], np.flatnonzero(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)) + 1])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk -> (term, block, postings), one row per occurrence of a term in the chunk."""
    last, known = None, []
    for batch in batches:
        chunk = batch.column("chunk")
        head = starts(chunk)
        texts = chunk.take(pa.array(head)).cast(pa.binary()).to_pylist()
        found = [known if k == 0 and c == last else c.translate(READ).split() for k, c in enumerate(texts)]
        last, known = (texts[-1], found[-1]) if texts else (last, known)
        width = np.array([len(f) for f in found], np.int64)
        rows = np.diff(np.append(head, len(chunk)))
        # a run of r rows with w terms gives r x w rows: the terms of the run for each row
        row = np.repeat(np.arange(len(chunk)), np.repeat(width, rows))
        many = np.repeat(width, rows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        term = np.repeat(np.repeat(np.cumsum(width) - width, rows), many) + nth
        terms = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
        take = pa.array(row)
        cols = [terms.take(pa.array(term)), batch.column("block").take(take), batch.column("postings").take(take)]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "block", "postings"])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term and block -> (g, term, docs, n); a document counts once however many chunks hold the term."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = max(starts(batch.column("term"))[-1], starts(batch.column("block"))[-1])
        if edge == 0 and held and same(held[-1], batch):
            held.append(batch)
            continue
        # the last run of a term and block may go on in the next batch
        table = pa.Table.from_batches([*held, batch.slice(0, edge)]) if edge or held else None
        held = [batch.slice(edge)]
        if table is not None and table.num_rows:
            yield sums(table)
    if held:
        yield sums(pa.Table.from_batches(held))


def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a.column(c)[-1] == b.column(c)[0] for c in ("term", "block"))


def sums(rows: pa.Table) -> pa.RecordBatch:
    term, block, postings = (rows.column(c).combine_chunks() for c in ("term", "block", "postings"))
    head = starts(term)
    run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(term))))
    opens = np.zeros(len(term), np.int64)
    opens[head], opens[starts(block)] = 1, 1
    edges = np.frombuffer(postings.buffers()[1], np.int32, len(postings) + 1, postings.offset * 4)
    data = np.frombuffer(postings.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    values = unpack(data)
    of = np.searchsorted(edges[1:] - edges[0], np.flatnonzero(data < 128)[0::3], "right")
    step, group, n = values[0::3], values[1::3], values[2::3]
    total = np.cumsum(step)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    doc = total - np.repeat((total - step)[first], np.diff(np.append(first, len(of))))
    # one row per document of a block, then one per group of a term
    unit = int(doc.max(initial=0)) + 1
    order = np.argsort((np.cumsum(opens)[of] * unit + doc), kind="stable")
    key = (np.cumsum(opens)[of] * unit + doc)[order]
    one = np.flatnonzero(np.diff(key, prepend=-1))
    n, group, of = np.add.reduceat(n[order], one), group[order][one], run[of[order][one]]
    unit = int(group.max(initial=0)) + 1
    order = np.argsort(of * unit + group, kind="stable")
    key, n = (of * unit + group)[order], n[order]
    one = np.flatnonzero(np.diff(key, prepend=-1))
    docs, n = np.diff(np.append(one, len(key))), np.add.reduceat(n, one)
    names = term.take(pa.array(head[key[one] // unit]))
    return pa.RecordBatch.from_arrays([longs(key[one] % unit), names, longs(docs), longs(n)], names=["g", "term", "docs", "n"])


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, g, term, docs, n) and (lang, source, g) of all documents."""
    spark = docs.sparkSession
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = stage(docs.select(*names).distinct().withColumn("g", F.monotonically_increasing_id()))
    given = docs.select(*names, F.col("text").cast("string").alias("text"))
    if groups.count() <= SMALL:
        given = given.join(F.broadcast(groups), ["lang", "source"])
    else:  # stored, as rows out of a shuffle come in no fixed order and blocks must be the same on a second try
        given = stage(on_groups(given, groups))
    chunks = given.select("g", "text").mapInArrow(factor, "chunk string, block long, postings binary")
    terms = chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(cut, "term string, block long, postings binary")
    span = F.expr(f"shiftright(block, 32) div {SPAN}")
    terms = terms.repartition("term", span).sortWithinPartitions("term", "block")
    counts = terms.mapInArrow(add_up, "g long, term string, docs long, n long")
    counts = counts.groupBy("g", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return stage(join_small(counts, groups.select("g", "lang"), "g", "inner")), groups


def share(count: str, total: str, kept: str) -> Column:
    """1 + UNIT * (count + 5) div (total + 5 * kept), in decimals so that no product overflows."""
    above = f"CAST({UNIT} AS DECIMAL(10, 0)) * CAST(coalesce({count}, 0) + 5 AS DECIMAL(20, 0))"
    return F.expr(f"1 + ({above}) div nullif(CAST({total} + 5 * {kept} AS DECIMAL(20, 0)), 0)")


PART = "lang string, a long, b long, value long"


def distances(rows: pa.Table) -> pa.Table:
    """Shares of one block of terms (lang, x, y, band, i, term, p) -> sums of differences per pair of sources.

    A row without a term gives a source's share of the terms that it doesn't have."""
    lang, x, y = (rows.column(c)[0].as_py() for c in ("lang", "x", "y"))
    i, band, p = (rows.column(c).to_numpy() for c in ("i", "band", "p"))
    term = rows.column("term").combine_chunks().dictionary_encode()
    code = term.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def matrix(k: int) -> tuple[np.ndarray, np.ndarray]:
        mine = band == k
        names, at = np.unique(i[mine], return_inverse=True)
        out = np.zeros((len(names), len(term.dictionary)), np.int64)
        base = code[mine] < 0
        out[at[base]] = p[mine][base][:, None]
        out[at[~base], code[mine][~base]] = p[mine][~base]
        return names, out

    (left, m), (right, o) = matrix(x), matrix(y)
    found = []
    for k, row in enumerate(m):
        other = right > left[k]
        if other.any():
            found.append((np.full(int(other.sum()), left[k]), right[other], np.abs(o[other] - row).sum(1)))
    a, b, value = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
    cols = [pa.array([lang] * len(a), pa.string()), longs(a), longs(b), longs(value)]
    return pa.Table.from_arrays(cols, names=["lang", "a", "b", "value"])


def on_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Join on language and source, with a hot group dealt over lanes."""
    return in_lanes(rows).join(for_lanes(groups), ["lang", "source", "_lane"]).drop("_lane")


def pair_sums(shares: DataFrame, sources: DataFrame) -> DataFrame:
    """Shares (lang, i, bands, blocks, term, p) and all sources -> (lang, a, b, value) for all pairs of sources, a < b."""
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    held = shares.select("lang", "i", "bands", "term", "p", block)
    absent = sources.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    absent = absent.select("lang", "i", "bands", F.lit(None).cast("string").alias("term"), F.coalesce(share("0", "total", "kept"), F.lit(0)).alias("p"), "block")
    rows = held.unionByName(absent).withColumn("band", F.expr(f"i div {BAND}"))
    rows = rows.withColumn("meets", F.explode(F.expr("sequence(0L, bands - 1)")))
    rows = rows.withColumns({"x": F.least("band", "meets"), "y": F.greatest("band", "meets")})
    sums = rows.select("lang", "block", "x", "y", "band", "i", "term", "p").groupBy("lang", "block", "x", "y").applyInArrow(distances, PART)
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module text.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the source has more of than
    its language."""
    counts, groups = counted(docs)
    free(docs.sparkSession)  # the exchanges of the counting are most of the disk
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("_d"), F.sum("n").alias("everywhere")).filter(F.col("_d") >= min_docs).drop("_d")
    kept = stage(kept)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("everywhere").alias("lang_total"))
    mine = stage(counts.join(kept, ["lang", "term"]).select("g", "term", "n", "everywhere"))
    totals = mine.groupBy("g").agg(F.sum("n").alias("total"))
    number = F.row_number().over(W.Window.partitionBy("lang").orderBy("source")) - 1
    sources = groups.join(totals, "g", "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    sources = sources.withColumn("i", number.cast("long")).withColumn("blocks", F.expr(f"greatest(1L, ceil(kept / {TERMS}))"))
    sources = stage(sources.withColumn("bands", F.expr(f"max(i) OVER (PARTITION BY lang) div {BAND} + 1")))
    shares = join_small(mine, sources, "g", "inner").withColumn("p", share("n", "total", "kept"))

    rank = F.row_number().over(W.Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    above = shares.withColumn("value", F.col("p") - share("everywhere", "lang_total", "kept")).filter("value > 0")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.select("*", rank).filter(F.col("rank") <= top)

    sums_ = stage(pair_sums(shares, sources))
    both = sums_.unionByName(sums_.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = sources.select("lang", "source", "i")
    pairs = both.join(name.select("lang", "source", F.col("i").alias("a")), ["lang", "a"]).join(name.select("lang", F.col("source").alias("item"), F.col("i").alias("b")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").select("*", rank)
    return pairs.unionByName(terms)
