"""Similarity join of word shingle sets: Jaccard of 0.8 or more, exact, as connected components.

Two sets link when 100 * |A & B| >= 80 * |A | B|. Sets are banded by size, so that linked sets lie in the same or in
neighbouring bands, and every set enters the tiles of its own and the next band. A tile of a band is one segment of the
hash space with one content: a band with at most D different elements between linked sets is cut into more than D
segments, so linked sets agree in at least one whole segment and meet in its tile. A passage that many documents share
does not bring them together unless nothing else of theirs falls into the segment.

0. Equal sets link at once, and only the first of them goes on.
1. In every tile each member is paired with the smallest one (linear in the tile). Bit counts of hashed bitmaps bound
   the overlap from above, and what passes is settled by intersecting the sorted arrays. Links give components.
2. Tiles whose other members already lie in one component are done. The rest are compared member by member across
   components, large tiles in blocks of rows sorted by size, by bitmaps and then exactly.

No link between different sets is lost, pairs within a component are not expanded, and copies stay linear.

Defined results: missing and empty texts have no shingles and link with nothing; a text of one to four words is one
shingle; rows with the same doc_id are one node and link wherever one of their sets does; a missing doc_id is one node
that sorts first and is given back as missing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.llm.common import blobs, free, keyed, longs, parts, slices, stage
from quarte.llm.components import components

WORDS = 5
SHARE = 80  #: per cent
NO_ID = -(2**63)
PIECE = 1 << 19
BLOCK = 1024  #: rows of a tile compared with each other at a time
U = np.uint64
BYTE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = bytes(range(256)).lower()


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER = powers(0x9E3779B97F4A7C15, 1 << 12)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every lower-cased word."""
    raw = np.frombuffer(data.translate(LOWER), np.uint8)
    inside = ~SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, np.uint64), first
    size = stop - first
    power = POWER if size.max() <= len(POWER) else powers(0x9E3779B97F4A7C15, int(size.max()))
    letters = np.flatnonzero(inside)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    total = np.add.reduceat(BYTE[raw[letters]] * power[place], np.cumsum(size) - size)
    return mixed(total + size.astype(np.uint64)), first


def joined(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` words in a row."""
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * U(0xC2B2AE3D27D4EB4F) + words[j : len(words) - n + 1 + j]
    return mixed(out)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of one text from its word hashes."""
    if not len(words):
        return words
    return np.unique(joined(words, min(WORDS, len(words))))


def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Shingle set of every text; texts are hashed together up to a bounded size."""
    at = 0
    while at < len(texts):
        held, size = [], 0
        while at + len(held) < len(texts) and (not held or size + len(texts[at + len(held)]) < PIECE):
            held.append(texts[at + len(held)])
            size += len(held[-1]) + 1
        hashes, first = word_hashes(b" ".join(held))
        begin = np.cumsum([0, *(len(t) + 1 for t in held)])
        cut = np.searchsorted(first, begin)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield shingles(hashes[a:b])
        at += len(held)


def band_limits(most: int = 1 << 40) -> list[int]:
    """Largest size of every band; a band ends where SHARE per cent of it would leave it."""
    out, low = [], 1
    while low < most:
        out.append(low * 100 // SHARE)
        low = out[-1] + 1
    return out


LIMITS = np.array(band_limits())


def different(band: int) -> int:
    """Elements that two linked sets can differ in when the larger lies in this band."""
    return int(2 * LIMITS[band] * (100 - SHARE) // (100 + SHARE))


def band_keys(items: np.ndarray, band: int) -> np.ndarray:
    """Tiles of a band that a set of sorted hashes enters."""
    d, seed = different(band), int(band) * 0x9E3779B97F4A7C15
    value = mixed(items ^ U(seed % 2**64))
    whole = value.sum(dtype=np.uint64)
    if d < 2:
        found = whole[None] if d == 0 else np.concatenate([whole[None], whole - value])
        return mixed(found + U((seed + 1) % 2**64))
    spare = d // 6 + 3  # segments that both may have empty
    k = d + 1 + spare
    segment = ((items >> U(32)) * U(k)) >> U(32)
    start = np.flatnonzero(np.diff(segment, prepend=U(2**63)))
    found = np.add.reduceat(value, start) + segment[start] * U(0xA24BAED4963EE407)
    if k - len(start) > spare:
        empty = np.setdiff1d(np.arange(k, dtype=np.uint64), segment[start], assume_unique=True)
        found = np.concatenate([found, empty * U(0xA24BAED4963EE407)])
    return mixed(found + U((seed + 2) % 2**64))


def tile_keys(items: np.ndarray) -> np.ndarray:
    if not len(items):
        return items
    band = int(np.searchsorted(LIMITS, len(items)))
    return np.concatenate([band_keys(items, band), band_keys(items, band + 1)])


def bitmap(items: np.ndarray) -> bytes:
    """Hashed bitmap with at least four bits for an element of the band's largest set."""
    width = 64
    if len(items):
        width = max(64, 1 << int(4 * LIMITS[np.searchsorted(LIMITS, len(items))] - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(items & U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def linked(shared, total):
    """Sizes in, verdict out; ``total`` is the sum of both sizes."""
    return 100 * shared >= SHARE * (total - shared)


def count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


def can_link(a: np.ndarray, b: np.ndarray, na, nb):
    """Upper bound of the overlap from bits set on one side only."""
    words = min(a.shape[-1], b.shape[-1])
    a, b = fold(a, words), fold(b, words)
    most = np.minimum(na - count(a & ~b), nb - count(b & ~a))
    return linked(most, na + nb)


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, h1, h2, bits = [], [], [], []
        for items in sets_of(blobs(batch.column("text"))):
            n.append(len(items))
            h1.append(items.sum(dtype=np.uint64))
            h2.append(mixed(items + U(5)).sum(dtype=np.uint64) if len(items) else U(0))
            bits.append(bitmap(items))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), longs(n), longs(np.array(h1, np.uint64).view(np.int64)),
             longs(np.array(h2, np.uint64).view(np.int64)), pa.array(bits, pa.binary())],
            names=["doc_id", "n", "h1", "h2", "bits"],
        )


def to_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids = batch.column("doc_id").to_numpy()
        keys, owners, size = [], [], 0
        for doc, items in zip(ids, sets_of(blobs(batch.column("text"))), strict=True):
            keys.append(tile_keys(items))
            owners.append(np.full(len(keys[-1]), doc, np.int64))
            size += len(keys[-1])
            if size > 1 << 17:
                yield tile_rows(keys, owners)
                keys, owners, size = [], [], 0
        if keys:
            yield tile_rows(keys, owners)


def tile_rows(keys: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    both = [longs(np.concatenate(keys).view(np.int64)), longs(np.concatenate(owners))]
    return pa.RecordBatch.from_arrays(both, names=["tile", "doc"])


def to_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and document -> (tile, hub, doc) for tiles with several documents, the hub itself left out."""
    last_tile, last_doc, hub = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.empty(len(tile), bool)
        new[0] = last_tile is None or tile[0] != last_tile
        new[1:] = tile[1:] != tile[:-1]
        twice = np.empty(len(tile), bool)
        twice[0] = not new[0] and doc[0] == last_doc
        twice[1:] = ~new[1:] & (doc[1:] == doc[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        hubs = doc[start][group] if len(start) else np.zeros(len(doc), np.int64)
        if not new[0]:
            hubs[group < 0] = hub
        last_tile, last_doc, hub = tile[-1], doc[-1], hubs[-1]
        out = np.flatnonzero(~new & ~twice & (doc != hubs))
        yield pa.RecordBatch.from_arrays(
            [longs(tile[out]), longs(hubs[out]), longs(doc[out])], names=["tile", "hub", "doc"]
        )


def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        items = list(sets_of(blobs(batch.column("text"))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([i.tobytes() for i in items], pa.binary())], names=["doc", "items"]
        )


def with_sides(pairs: DataFrame, facts: DataFrame, cols: list[str]) -> DataFrame:
    for side in ("a", "b"):
        named = facts.select(F.col("doc_id").alias(side), *(F.col(c).alias(side + c) for c in cols))
        pairs = pairs.join(named, side)
    return pairs


def by_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        a, b = batch.column("abits").to_pylist(), batch.column("bbits").to_pylist()
        na, nb = batch.column("an").to_numpy(), batch.column("bn").to_numpy()
        good = [
            bool(can_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), k, m))
            for x, y, k, m in zip(a, b, na, nb, strict=True)
        ]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def by_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        good = []
        for x, y in zip(batch.column("aitems").to_pylist(), batch.column("bitems").to_pylist(), strict=True):
            left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(left, right)
            at[at == len(left)] = 0
            good.append(bool(linked(int((left[at] == right).sum()), len(left) + len(right))))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def close_pairs(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow a link."""
    sized = with_sides(pairs, facts.select("doc_id", "n"), ["n"])
    sized = sized.filter(100 * F.least("an", "bn") >= SHARE * F.greatest("an", "bn")).select("a", "b")
    both = with_sides(sized, facts, ["n", "bits"]).select("a", "b", "an", "bn", "abits", "bbits")
    return stage(both.mapInArrow(by_bitmap, "a long, b long").distinct())


def links(pairs: DataFrame, facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that link: what the bitmaps allow is settled by the sorted arrays of the texts concerned."""
    close = close_pairs(pairs, facts)
    concerned = close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stage(rows.join(concerned, "doc_id", "left_semi").mapInArrow(to_sets, "doc long, items binary"))
    for side in ("b", "a"):
        close = close.join(sets.select(F.col("doc").alias(side), F.col("items").alias(side + "items")), side)
    return stage(close.select("a", "b", "aitems", "bitems").mapInArrow(by_items, "a long, b long").toDF("u", "v"))


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a tile, sorted by unit and size: pairs of different components that the bitmaps do not rule out."""
    unit, held = None, []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != unit and held:
                yield compared(held)
                held = []
            unit = row[0]
            held.append(row)
    if held:
        yield compared(held)


def compared(rows: list[tuple]) -> pa.RecordBatch:
    _, block, left, right, doc, component, n, bits = zip(*rows, strict=True)
    doc, component, n = np.array(doc), np.array(component), np.array(n)
    block, words = np.array(block), min(len(b) for b in bits) // 8
    matrix = np.array([fold(np.frombuffer(b, np.uint64), words) for b in bits])
    end = np.searchsorted(n, n * 100 // SHARE, "right")
    a, b = [], []
    apart = left[0] != right[0]
    for i in range(len(doc)):
        j = np.arange(i + 1, end[i])
        ok = component[j] != component[i]
        if apart:
            ok &= block[j] != block[i]
        j = j[ok]
        if len(j):
            j = j[can_link(matrix[i], matrix[j], n[i], n[j])]
            a.append(np.full(len(j), doc[i]))
            b.append(doc[j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([longs(np.minimum(a, b)), longs(np.maximum(a, b))], names=["a", "b"])


def rest_pairs(members: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs of different components that meet in a tile beside its hub and may link by their bitmaps."""
    n = parts(members.sparkSession)
    placed = members.join(found.withColumnRenamed("node", "doc"), "doc", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc"))
    mixed_tiles = placed.groupBy("tile").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")
    )
    mixed_tiles = mixed_tiles.filter("low < high").select("tile", "rows")
    placed = stage(placed.join(mixed_tiles, "tile").select("tile", "doc", "component", "rows"))
    sizes = facts.select(F.col("doc_id").alias("doc"), "n")
    big = placed.filter(F.col("rows") > BLOCK).join(sizes, "doc").select("tile", "doc", "component", "rows", "n")
    # sizes cut large tiles into blocks: equal counts of rows by a rank within the tile
    rank = F.expr("row_number() over (partition by tile order by n, doc)") - 1
    big = big.withColumn("block", F.floor(rank / BLOCK).cast("int"))
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    big = big.select("tile", "doc", "component", "block", other.alias("other"))
    big = big.select("tile", "doc", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    small = placed.filter(F.col("rows") <= BLOCK).select(
        "tile", "doc", "component", *(F.lit(0).alias(c) for c in ("block", "x", "y"))
    )
    units = big.unionByName(small).withColumn("unit", F.xxhash64("tile", "x", "y"))
    units = units.join(facts.select(F.col("doc_id").alias("doc"), "n", "bits"), "doc")
    dealt = units.repartition(n, "unit").sortWithinPartitions("unit", "tile", "x", "y", "n", "doc")
    cols = ["unit", "block", "x", "y", "doc", "component", "n", "bits"]
    return dealt.select(*cols).mapInArrow(across, "a long, b long").distinct()


def copies_of(facts: DataFrame) -> DataFrame:
    """Nodes whose set an earlier node has too: (u, v), the first and the later one."""
    sets = facts.filter("n > 0").select("n", "h1", "h2", "doc_id").distinct()
    first = sets.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("u"), F.count(F.lit(1)).alias("held"))
    later = sets.join(first.filter("held > 1").drop("held"), ["n", "h1", "h2"]).filter("doc_id <> u")
    return later.select("u", F.col("doc_id").alias("v"))


def tile_members(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Tiles with their hub and their other members; of equal sets only the first is a member.

    Copies share all tiles and the hub is the smallest of a tile, so it is never one of the later copies. A node of
    several sets (a repeated doc_id) stays, as it may link by its other sets."""
    tiles = keyed(rows.mapInArrow(to_tiles, "tile long, doc long"), parts(rows.sparkSession), "tile", "doc")
    members = tiles.mapInArrow(to_hubs, "tile long, hub long, doc long")
    return members.join(copies.select(F.col("v").alias("doc")), "doc", "left_anti").select("tile", "hub", "doc")


def several_sets(facts: DataFrame) -> DataFrame:
    """Nodes with several rows."""
    return facts.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    facts = stage(rows.mapInArrow(measure, "doc_id long, n long, h1 long, h2 long, bits binary"))
    copies = stage(copies_of(facts))
    members = stage(tile_members(rows, copies.join(several_sets(facts), "v", "left_anti")))
    free(spark)
    pairs = stage(members.select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct())
    first = links(pairs, facts, rows)
    free(spark)
    found = stage(components(first.unionByName(copies)))
    rest = stage(rest_pairs(members, found, facts))
    free(spark)
    more = links(rest, facts, rows)
    free(spark)
    found = components(found.toDF("v", "u").unionByName(more))
    out = facts.select("doc_id", "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("component", "doc_id"), F.lit(NO_ID)).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that link with a smaller doc_id, or repeat a row; columns stay as they are.

    Of rows with the same doc_id and text one stays."""
    found = stage(near_duplicates(docs))
    linked_away = (F.col("component_id") != F.col("doc_id")) | (F.col("component_id").isNull() & F.col("doc_id").isNotNull())
    gone = found.filter(linked_away).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    repeated = found.groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id")
    if repeated.isEmpty():
        return left
    repeated = stage(repeated)
    same = docs["doc_id"].cast("long").eqNullSafe(repeated["_id"])
    return left.join(repeated, same, "left_anti").unionByName(
        left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    )
