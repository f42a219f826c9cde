"""Language-model scores by prediction by partial matching (PPM) over bytes, with a word unigram as the base.

A text is read as its lower-cased words joined by single spaces, then an end symbol. Each byte is predicted from the
``ORDER`` bytes before it (zero bytes before the text). A context that training texts have seen gives a symbol seen
there (n - 1/2) / T, with T occurrences of q different symbols, and q / 2T to an escape to the context without its
oldest byte, where the symbols of the longer context are excluded from T and q (escape estimate of method D). Contexts never seen are passed over.
Below the empty context the symbols that training never saw are equally likely.

The trie is a table of (context, symbol, count), grown from all training texts and never held in one place:

1. Documents are dealt into batches of about ``BATCH`` bytes; each gives its distinct grams and words with counts.
2. Counts are summed over batches. Grams are dealt by the two bytes next to the symbol, so that a task has a whole
   branch of the trie for orders two and more; orders one and none are a table of 256 x 257 counts. This gives the
   final log probability of every gram that occurs anywhere.
3. Log probabilities go back to the batches in which their grams occur; a batch looks up its texts' grams.

Defined results: missing and empty texts are the end symbol alone; a document is held out when crc32 of its doc_id as
text, modulo ``FOLDS``, is ``HELD``; a missing doc_id is in training; repeated rows are learned and scored as often as
they occur; without training texts all symbols are equally likely. Words are told apart by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.llm.common import blobs, free, longs, parts, stage, unstage
from quarte.llm.jaccard import word_hashes

ORDER = 5
FOLDS, HELD = 7, 2
BATCH = 1 << 24  #: bytes of text in a batch, about
ROWS = 256  #: texts of a batch held as Python objects at a time
PIECE = 1 << 20
SYMBOLS, END = 257, 256
GRAM, WORD = 0, 1
NO_ID = -(2**63)
U = np.uint64


def read_as(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Gram of every symbol of texts that are read already, and where each text begins.

    A gram holds the context, latest byte first, above nine bits of symbol."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    gap = b"\0" * ORDER
    raw = np.frombuffer(gap + (b"\0" + gap).join(texts) + b"\0", np.uint8).astype(np.uint64)
    # places in raw of the symbols: every text is followed by its end and by a gap
    place = np.arange(size.sum()) + np.repeat(np.arange(1, len(texts) + 1) * ORDER, size)
    code = np.zeros(len(raw), np.uint64)
    for back in range(1, ORDER + 1):
        code[ORDER:] = (code[ORDER:] << U(8)) | raw[ORDER - back : len(raw) - back]
    symbol = raw.copy()
    symbol[place[begin + size - 1]] = END
    return ((code << U(9)) | symbol)[place].view(np.int64), begin


def pieces(texts: list[bytes]) -> Iterator[slice]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > PIECE:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


class Tally:
    """Counts of keys, gathered in sorted arrays."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counted: np.ndarray) -> None:
        key = np.sort(keys[counted])
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.put(key[cut], np.diff(np.append(cut, len(key))))
        rest = np.unique(keys[~counted])
        self.put(rest, np.zeros(len(rest), np.int64))

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 1 << 20:
            key, n = self.all()
            self.keys, self.counts, self.size = [key], [n], len(key) // 2

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, n = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(key)
        key, n = key[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[cut], np.add.reduceat(n, cut) if len(cut) else n


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, learn, text) sorted by batch -> its distinct grams and words with their training counts."""
    now, found = None, (Tally(), Tally())

    def out() -> Iterator[pa.RecordBatch]:
        for kind, t in zip((GRAM, WORD), found, strict=True):
            key, n = t.all()
            for at in range(0, len(key), 1 << 17):
                k, m = key[at : at + (1 << 17)], n[at : at + (1 << 17)]
                cols = [pa.array(np.full(len(k), now, np.int32)), pa.array(np.full(len(k), kind, np.int32)), longs(k), longs(m)]
                yield pa.RecordBatch.from_arrays(cols, names=["batch", "kind", "key", "n"])

    for rows in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        which = rows.column("batch").to_numpy()
        learn, texts = rows.column("learn").to_numpy(zero_copy_only=False), [read_as(t) for t in blobs(rows.column("text"))]
        edge = np.flatnonzero(np.diff(which, prepend=-1)).tolist() + [len(which)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if now is not None and which[a] != now:
                yield from out()
                found = (Tally(), Tally())
            now = int(which[a])
            for piece in pieces(texts[a:b]):
                part, own = texts[a:b][piece], learn[a:b][piece]
                key, begin = grams(part)
                found[GRAM].add(key, np.repeat(own, np.diff(np.append(begin, len(key)))))
                hashes, counts = words_of(part)
                found[WORD].add(hashes, np.repeat(own, counts))
    if now is not None:
        yield from out()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of texts that are read already, and the number of words of each text."""
    hashes, first = word_hashes(b" ".join(texts))
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes.view(np.int64), np.diff(np.searchsorted(first, begin))


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and where each row's key stands among them."""
    distinct, at = np.unique(key, return_inverse=True)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64), at


def log_probabilities(gram: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of every gram of whole branches (all grams with the same two latest bytes are given).

    ``n`` are training counts, zero for grams that only held-out texts have; ``pairs`` counts (latest byte, symbol)."""
    code, symbol = gram >> 9, gram & 511
    # levels from the longest context to the empty one: count of the symbol there, T, q, and per context the
    # occurrences there of the symbols that the next longer context has seen
    counts, totals, kinds = [], [], []
    below = []
    for order in range(ORDER, 1, -1):
        context = code >> (8 * (ORDER - order))
        distinct, sums, at = summed((context << 9) | symbol, n)
        owners, own = np.unique(distinct >> 9, return_inverse=True)
        total = np.bincount(own, sums, len(owners)).astype(np.int64)
        kind = np.bincount(own, sums > 0, len(owners)).astype(np.int64)
        counts.append(sums[at])
        totals.append(total[own][at])
        kinds.append(kind[own][at])
        below.append((distinct, sums, own, at))
    latest = code >> (8 * (ORDER - 1))
    single = pairs.sum(0)
    counts += [pairs[latest, symbol], single[symbol]]
    totals += [pairs.sum(1)[latest], np.full(len(gram), single.sum())]
    kinds += [(pairs > 0).sum(1)[latest], np.full(len(gram), (single > 0).sum())]
    covered = []  # for each level but the last: T of the next level that the seen symbols of this context take
    for level, (distinct, sums, own, at) in enumerate(below):
        order = ORDER - level
        if order > 2:
            shorter = ((distinct >> 17) << 9) | (distinct & 511)
            next_distinct, next_sums = below[level + 1][:2]
            there = next_sums[np.searchsorted(next_distinct, shorter)]
        else:
            there = pairs[distinct >> 17, distinct & 511]
        covered.append(np.bincount(own, np.where(sums > 0, there, 0), own.max() + 1 if len(own) else 0).astype(np.int64)[own][at])
    covered.append(np.where(pairs > 0, single[None, :], 0).sum(1)[latest])
    out = np.zeros(len(gram))
    open_ = np.ones(len(gram), bool)
    seen = np.zeros(len(gram), bool)  # whether a longer context was seen, so that its symbols are excluded
    for level in range(ORDER + 1):
        total, kind = totals[level].astype(float), kinds[level].astype(float)
        if level:
            total = total - np.where(seen, covered[level - 1], 0)
            kind = kind - np.where(seen, kinds[level - 1], 0)
        able = open_ & (kind > 0)
        hit = able & (counts[level] > 0)
        out[hit] += np.log10((counts[level][hit] - 0.5) / total[hit])
        miss = able & ~hit
        out[miss] += np.log10(kind[miss] / (2 * total[miss]))
        open_ &= ~hit
        seen |= kinds[level] > 0
    never = SYMBOLS - int((single > 0).sum())
    out[open_] -= np.log10(never)
    return out


def branches(pairs: np.ndarray):
    """Rows (branch, key, n) sorted by key -> (key, value): the log probability of every gram."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            _, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([longs(key), pa.array(log_probabilities(key, n, pairs))], names=["key", "value"])

        for rows in batches:
            if not rows.num_rows:
                continue
            branch, key, n = (c.to_numpy() for c in rows.columns)
            if held and sum(len(h[0]) for h in held) > 1 << 18:
                # whole branches only: the last one held may go on
                old = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(old[0], old[0][-1]))
                if cut:
                    held = [tuple(x[:cut] for x in old)]
                    yield done()
                    held = [tuple(x[cut:] for x in old)]
                else:
                    held = [tuple(old)]
            held.append((branch, key, n))
        if held:
            yield done()

    return solve


class Lookup:
    """Values of whole-number keys; two tables by hash hold nearly all, a search the rest."""

    def __init__(self, key: np.ndarray, value: np.ndarray, missing: float) -> None:
        order = np.argsort(key)
        self.key, self.value = np.append(key[order], -1), np.append(value[order], missing)
        self.bits = max(8, int(4 * len(key)).bit_length())
        self.tables = []
        left = np.arange(len(key))
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            table = np.full(1 << self.bits, len(key), np.int32)
            slot = self.slots(self.key[left], odd)
            table[slot] = left
            left = left[table[slot] != left]
            self.tables.append((odd, table))
        self.rest = bool(len(left))

    def slots(self, key: np.ndarray, odd: int) -> np.ndarray:
        return ((key.view(np.uint64) * U(odd)) >> U(64 - self.bits)).view(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        odd, table = self.tables[0]
        at = table[self.slots(key, odd)]
        wrong = np.flatnonzero(self.key[at] != key)
        if len(wrong):
            odd, table = self.tables[1]
            again = key[wrong]
            second = table[self.slots(again, odd)]
            bad = self.key[second] != again
            if bad.any():
                third = np.full(bad.sum(), len(self.key) - 1)
                if self.rest:
                    search = np.minimum(np.searchsorted(self.key[:-1], again[bad]), len(self.key) - 1)
                    third = np.where(self.key[search] == again[bad], search, len(self.key) - 1)
                second[bad] = third
            at[wrong] = second
        return self.value[at]


def batch_scores(total: int, distinct: int, ends: int):
    """Scores of the texts of a batch from the table of what its grams and words are worth."""
    below = float(total + distinct + 1)
    out_names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        kind, key, value = (known.column(c).to_numpy() for c in ("kind", "key", "value"))
        gram = Lookup(key[kind == GRAM], value[kind == GRAM], 0.0)
        word = Lookup(key[kind == WORD], value[kind == WORD], 0.0)
        texts = [read_as(t) for t in blobs(docs.column("text").combine_chunks())]
        n, hits, base, model = [], [], [], []
        for piece in pieces(texts):
            part = texts[piece]
            code, begin = grams(part)
            model.append(np.add.reduceat(gram(code), begin))
            hashes, counts = words_of(part)
            c = word(hashes)
            each = np.repeat(np.arange(len(part)), counts)
            n.append(counts + 1)
            hits.append(np.bincount(each, c > 0, len(part)).astype(np.int64) + (ends > 0))
            base.append(np.bincount(each, np.log10((c + 1) / below), len(part)) + np.log10((ends + 1) / below))
        cols = [
            docs.column("doc_id").combine_chunks(), pa.array(~docs.column("learn").to_numpy()), longs(np.concatenate(n)),
            longs(np.concatenate(hits)), longs(np.full(len(texts), total)), pa.array(np.concatenate(base)),
            pa.array(np.concatenate(model)),
        ]
        return pa.Table.from_arrays(cols, names=out_names)

    return score


def dealt(docs: DataFrame, batches: int) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    held = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(FOLDS)) == HELD
    return docs.select(
        F.pmod(F.xxhash64(key, F.hash("text")), F.lit(batches)).cast("int").alias("batch"), key.alias("doc_id"),
        (~F.coalesce(held, F.lit(False))).alias("learn"), "text",
    )


def tallies(docs: DataFrame, batches: int) -> DataFrame:
    n = parts(docs.sparkSession)
    rows = dealt(docs, batches).select("batch", "learn", "text").repartition(n, "batch").sortWithinPartitions("batch")
    return stage(rows.mapInArrow(tally, "batch int, kind int, key long, n long"))


def values(counted: DataFrame) -> tuple[DataFrame, int, int]:
    """What every gram and word is worth, the number of words in training and that of different ones."""
    n = parts(counted.sparkSession)
    total = stage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    is_word = F.col("kind") == WORD
    words, distinct = total.filter(is_word).agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))).first()
    gram = total.filter(F.col("kind") == GRAM)
    latest, symbol = F.shiftright("key", 9 + 8 * (ORDER - 1)), F.col("key").bitwiseAND(511)
    pairs = np.zeros((256, SYMBOLS), np.int64)
    for r in gram.groupBy(latest.alias("b"), symbol.alias("s")).agg(F.sum("n").alias("n")).collect():  # 256 x 257 at most
        pairs[r.b, r.s] = r.n
    branch = F.shiftright("key", 9 + 8 * (ORDER - 2)).alias("branch")
    by_branch = gram.select(branch, "key", "n").repartition(n, "branch").sortWithinPartitions("key")
    solved = by_branch.mapInArrow(branches(pairs), "key long, value double").withColumn("kind", F.lit(GRAM))
    known = total.filter(is_word & (F.col("n") > 0)).select("key", F.col("n").cast("double").alias("value"), "kind")
    worth = stage(solved.unionByName(known))
    unstage(total)
    return worth, int(words or 0), int(distinct or 0)


def told(counted: DataFrame, worth: DataFrame) -> DataFrame:
    """What each batch needs to know: (batch, kind, key, value)."""
    return stage(counted.select("batch", "kind", "key").join(worth, ["kind", "key"]).select("batch", "kind", "key", "value"))


def scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-volume // BATCH))
    rows = dealt(docs, batches)
    ends = rows.filter("learn").count()
    counted = tallies(docs, batches)
    free(spark)
    worth, words, distinct = values(counted)
    free(spark)
    known = told(counted, worth)
    unstage(counted, worth)
    free(spark)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    score = batch_scores(words + ends, distinct + (ends > 0), ends)
    both = rows.select("batch", "doc_id", "learn", "text").groupBy("batch").cogroup(known.groupBy("batch"))
    return both.applyInArrow(score, out).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
