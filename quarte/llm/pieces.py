"""SentencePiece encoding and decoding by suffix-array matching.

Words (a run of spaces and what follows it) never share a piece, so the distinct words of a batch that are not known yet
are put together into one text. A suffix array over it, built by doubling, is searched for every piece by bisection; the
ranges give all edges (place, piece), which are sorted by where they end and relaxed from left to right. An edge is
taken when the piece before it, as the last one of what was read so far, and its own stand next to each other under the
merge order of the model: then no merge across the edge comes before those that made the two pieces. Exactly one edge
holds at every place, and following them back gives the ids that merging by score would give. Characters that no piece
has become byte pieces.

Decoding joins pieces and bytes, turns the space mark into spaces and drops the one put before the text.

Defined results: missing and empty texts have no ids; a space mark written in a text is a space; bytes that form no
character decode to the replacement character; repeated rows give a row each."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.llm.common import blobs, longs
from quarte.llm.ppm import Lookup
from quarte.llm.tokens import Places, Runs, groups, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()
GAP = b"\xff"  #: never in UTF-8; keeps words apart in the index
WORDS = 8  #: eight-byte steps that bisection compares, 64 bytes
CACHE = 500_000  #: words whose ids are kept at most
INDEXED = 1 << 19  #: bytes of words that one suffix array holds, but for a longer word
NORMAL, BYTE = 1, 6
FAR = np.int64(1 << 40)


class Model:
    """Pieces of a model with the merges that make each of them from characters."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.pieces = [p.piece for p in spec.pieces]
        self.size = len(self.pieces)
        normal = [i for i, p in enumerate(spec.pieces) if p.type == NORMAL]
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        by_score = sorted(normal, key=lambda i: (-spec.pieces[i].score, i))
        self.rank = {self.pieces[i]: k for k, i in enumerate(by_score)}
        self.id_of = {self.pieces[i]: i for i in normal}
        self.one = {p for p in self.id_of if len(p) == 1}
        made = [(i, self.merges(self.pieces[i])) for i in normal]
        made = [(i, m) for i, m in made if m is not None]
        self.usable = np.array([i for i, _ in made])
        self.raw = [self.pieces[i].encode() for i in self.usable]
        self.length = np.array([len(r) for r in self.raw])
        self.spines(made)
        self.crossings()

    def merges(self, piece: str) -> list[tuple[int, str, str]] | None:
        """Rank of each merge that makes a piece, with the first and last symbol after it; None if merging ends elsewhere."""
        symbols, out = list(piece), []
        while len(symbols) > 1:
            ranks = [self.rank.get(a + b, FAR) for a, b in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == FAR:
                return None
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            out.append((best, symbols[0], symbols[-1]))
        return out

    def symbol(self, s: str) -> int:
        return self.id_of.get(s, self.size)

    def spines(self, made: list[tuple[int, list]]) -> None:
        """Per piece and merge: its rank, and the first and last symbol before it; id ``size`` is a lone unknown character."""
        steps = max(len(m) for _, m in made) + 1
        self.next_rank = np.full((self.size + 1, steps), FAR, np.int64)
        self.first = np.full((self.size + 1, steps), self.size, np.int64)
        self.last = np.full((self.size + 1, steps), self.size, np.int64)
        for i, merged in made:
            piece = self.pieces[i]
            states = [(piece[0], piece[-1]), *((f, z) for _, f, z in merged)]
            for k, (f, z) in enumerate(states):
                self.first[i, k], self.last[i, k] = self.symbol(f), self.symbol(z)
            self.next_rank[i, : len(merged)] = [r for r, _, _ in merged]

    def crossings(self) -> None:
        """Rank of the piece that two neighbouring symbols form."""
        key, value = [], []
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    key.append(a * (self.size + 1) + b)
                    value.append(self.rank[p])
        self.cross = Lookup(np.array(key, np.int64), np.array(value, np.int64), FAR)

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a text of two pieces leaves just these two."""
        out = np.ones(len(a), bool)
        i, j, left = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.arange(len(a))
        while len(left):
            x, y = a[left], b[left]
            ra, rb = self.next_rank[x, i[left]], self.next_rank[y, j[left]]
            c = self.cross(self.last[x, i[left]] * (self.size + 1) + self.first[y, j[left]])
            # of equal pieces the leftmost merges first
            crossed = (c < FAR) & (c < ra) & (c <= rb)
            out[left[crossed]] = False
            go = ~crossed & ((ra < FAR) | (rb < FAR))
            in_a = ra <= rb
            i[left[go & in_a]] += 1
            j[left[go & ~in_a]] += 1
            left = left[go]
        return out


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the ``depth`` bytes from there, by doubling from eight; and the eight bytes at every place."""
    padded = np.concatenate([data, np.zeros(8 * WORDS + 8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : len(padded) - 7 + k]
    n, step, key = len(data), 8, eight[: len(data)]
    order = np.argsort(key)
    rank = ranked(key, order)
    while step < depth:
        further = np.zeros(n, np.uint64)
        if step < n:
            further[:-step] = rank[step:] + np.uint64(1)
        key = (rank << np.uint64(32)) | further
        order = np.argsort(key)
        rank = ranked(key, order)
        step *= 2
    return order, eight


def ranked(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.concatenate([[False], key[order[1:]] != key[order[:-1]]]))
    return out


def bisect(order: np.ndarray, eight: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """First place in suffix order that is not before (``after``: that is beyond) each wanted string of WORDS steps."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = order[np.minimum(mid, len(order) - 1)]
        before, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for k in range(WORDS):
            here = eight[np.minimum(at + 8 * k, len(eight) - 1)]
            before |= same & (here < wanted[:, k])
            same &= here == wanted[:, k]
        right = open_ & (before | (same & after))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def strings(raw: list[bytes], fill: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(r.ljust(8 * WORDS, fill) for r in raw), ">u8").reshape(len(raw), WORDS).astype(np.uint64)


class Encoder:
    """Ids of words, each worked out once while it stays in the cache."""

    def __init__(self, path: str) -> None:
        self.model = Model(path)
        self.low, self.high = strings(self.model.raw, b"\0"), strings(self.model.raw, b"\xff")
        self.depth = int(self.model.length.max())
        self.single = {p.encode() for p in self.model.one}
        self.place, self.of_word = Places(), Runs()

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and piece of every occurrence of a piece, sorted by the end."""
        order, eight = suffix_array(data, self.depth)
        a, b = bisect(order, eight, self.low, False), bisect(order, eight, self.high, True)
        n = b - a
        upto = np.cumsum(n)
        begin = order[np.arange(upto[-1]) + np.repeat(a - (upto - n), n)]
        end = begin + np.repeat(self.model.length, n)
        piece = np.repeat(self.model.usable, n)
        begin, end, piece = (np.concatenate(x) for x in zip((begin, end, piece), self.unknown(data, begin, end), strict=True))
        sort = np.lexsort((begin, end))
        return begin[sort], end[sort], piece[sort]

    def unknown(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges for the characters that are no piece."""
        starts = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 0xFF))
        lead = data[starts]
        size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        has = np.zeros(len(data) + 1, bool)
        length = np.zeros(len(data) + 1, np.int64)
        length[starts] = size
        has[begin[end - begin == length[begin]]] = True
        lone = ~has[starts]
        return starts[lone], starts[lone] + size[lone], np.full(lone.sum(), self.model.size)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words in a row, and the number of ids of each."""
        size = np.array([len(w) for w in words])
        start = np.cumsum(size + 1) - size - 1
        data = np.frombuffer(GAP.join(words) + GAP, np.uint8)
        begin, end, piece = self.edges(data)
        word = np.searchsorted(start, begin, "right") - 1
        offset = end - start[word]
        turn = np.argsort(offset, kind="stable")
        begin, end, piece, offset = begin[turn], end[turn], piece[turn], offset[turn]
        first = np.zeros(len(data) + 1, bool)
        first[start] = True
        taken, back = np.full(len(data) + 1, -1, np.int64), np.full(len(data) + 1, -1, np.int64)
        for a, b in spans(offset):
            s, e, p = begin[a:b], end[a:b], piece[a:b]
            ok = first[s]
            inner = np.flatnonzero(~ok & (taken[s] >= 0))
            if len(inner):
                key, which = np.unique(taken[s[inner]] * (self.model.size + 1) + p[inner], return_inverse=True)
                ok[inner] = self.model.stand(key // (self.model.size + 1), key % (self.model.size + 1))[which]
            taken[e[ok]], back[e[ok]] = p[ok], s[ok]
        return self.followed_back(data, start, start + size, taken, back)

    def followed_back(self, data: np.ndarray, start: np.ndarray, at: np.ndarray, taken: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and the number of ids of each, from the edges taken at every place."""
        live, found = np.flatnonzero(at > start), []
        while len(live):
            here = at[live]
            found.append((live, taken[here], back[here]))
            at[live] = back[here]
            live = live[at[live] > start[live]]
        step = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        word, piece, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-step, word))
        word, piece, begin = word[order], piece[order], begin[order]
        lone = piece == self.model.size
        n = np.ones(len(piece), np.int64)
        lead = data[begin[lone]]
        n[lone] = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        ids = np.repeat(piece, n)
        byte = np.repeat(lone, n)
        place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(ids))
        ids[byte] = self.model.byte_id[data[place[byte]]]
        return ids.astype(np.uint32), np.bincount(word, n, len(start)).astype(np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        cut = [split(t) for t in texts]
        if len(self.place) > CACHE:
            self.place, self.of_word = Places(), Runs()
        at = self.place.of([w for words in cut for w in words])
        new = self.place.noted()
        for some in groups(new, INDEXED):
            self.of_word.add(*self.learn(new[some]))
        ids, upto = self.of_word(at)
        return ids, np.diff(upto[np.cumsum([0, *map(len, cut)])])


def spans(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    yield from zip(edge.tolist(), [*edge[1:].tolist(), len(sorted_values)], strict=True)


def split(text: bytes) -> list[bytes]:
    """Words of a text with the space mark before it and for its spaces; spaces in a row go with the word after them."""
    if not text:
        return []
    out, run = [], 1
    for word in text.replace(MARK, b" ").split(b" "):
        if word:
            out.append(MARK * run + word)
            run = 1
        else:
            run += 1
    if run > 1:
        out.append(MARK * (run - 1))
    return out


@functools.cache
def encoder(name: str) -> Encoder:
    return Encoder(tokenizer_path(name))


def decode(ids: np.ndarray, model: Model) -> bytes:
    """Text of ids; control pieces give nothing."""
    known = decoder(model)
    return b"".join([known[i] for i in ids.tolist()]).replace(MARK, b" ")[1:]


def decoder(model: Model) -> list[bytes]:
    if not hasattr(model, "texts"):
        texts = [b""] * model.size
        for p, i in model.id_of.items():
            texts[i] = p.encode()
        for value, i in enumerate(model.byte_id.tolist()):
            texts[i] = bytes([value])
        model.texts = texts
    return model.texts


def encoded(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """Per document: doc_id and its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blobs(batch.column("text"))
            for piece in groups(texts, 1 << 22):
                ids, n = encoder(name).encode(texts[piece])
                flat, ends = pa.array(ids.astype(np.int32)), pa.array(np.cumsum([0, *n]), pa.int32())
                own = batch.column("doc_id").slice(piece.start, piece.stop - piece.start)
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, name: str = MODEL) -> DataFrame:
    """Per row of ids: doc_id and text."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = encoder(name).model
            text = [decode(i.values.to_numpy(), model).decode("utf-8", "replace") for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(back, "doc_id long, text string")


def digests(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """Per document: ids, their checksum, and the checksum and size of the text they decode to."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [i.values.to_numpy() for i in batch.column("ids")]
            texts = [decode(i, encoder(name).model) for i in ids]
            cols = [
                batch.column("doc_id"), longs([len(i) for i in ids]), longs([zlib.crc32(i.astype("<u4").tobytes()) for i in ids]),
                longs([len(t) for t in texts]), longs([zlib.crc32(t) for t in texts]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_crc32", "decoded_bytes", "decoded_crc32"])

    shape = "doc_id long, n_tokens long, ids_crc32 long, decoded_bytes long, decoded_crc32 long"
    return encoded(docs, name).mapInArrow(digest, shape)
