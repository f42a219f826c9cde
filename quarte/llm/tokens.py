"""Token ids of whole texts by a word-level BPE tokenizer file, word by word.

White space separates what the tokenizer sees, so ids are looked up per distinct word: the tokenizers library encodes
each word once, in a bounded cache, and texts are put together from the cached ids. Arrow cuts a slice of texts into words
and finds the distinct ones, so that only those are looked up. Words of ASCII and Latin-1 letters are further cut at the
tokenizer's own split pattern, so that punctuation does not make words distinct; their parts are lower-cased and composed
already, so the library encodes them by the tokenizer's model and byte letters alone, many at once, as each part ends with a
token that ends a word."""

from __future__ import annotations

import functools
import os
import re
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
END = 2
CACHE, PARTS = 500_000, 400_000  #: words, and parts of words, kept at most
TOGETHER = 512  #: parts that the library gets as one text
#: The split pattern of the tokenizer file, for lower-cased ASCII and Latin-1 letters; a space parts words.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9 ]+| ")
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PLAINS = re.compile(r"[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Places(defaultdict):
    """Numbers of words; a word not seen before gets the next number and is noted as new."""

    def __init__(self) -> None:
        super().__init__(count().__next__)
        self.known = 0

    def of(self, words, n: int | None = None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words) if n is None else n)

    def noted(self) -> list:
        new = list(islice(reversed(self), len(self) - self.known))
        self.known = len(self)
        return new[::-1]


class Runs:
    """Ids of many words in one array."""

    def __init__(self) -> None:
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(size) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(size)] = self.used + np.cumsum(size) - size
        self.size[self.n : self.n + len(size)] = size
        self.used, self.n = self.used + len(ids), self.n + len(size)

    def __call__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these numbers in a row, and where each of them begins and the last ends."""
        size = self.size[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.start[at] - upto[:-1], size) + np.arange(upto[-1])], upto


class Cache:
    """Numbers, ids and uses of words. Beyond its bound, what was used once goes, and at most half of it stays."""

    def __init__(self, most: int, first: tuple = ()) -> None:
        self.most, self.first = most, first
        self.place, self.runs, self.times = Places(), Runs(), np.zeros(0, np.int64)
        self.put(first, Runs()(np.zeros(0, np.int64))[0], np.zeros(len(first), np.int64))

    def put(self, words, ids: np.ndarray, size: np.ndarray) -> None:
        self.place.of(words)
        self.place.noted()
        self.runs.add(ids, size)

    def trim(self) -> None:
        if len(self.place) <= self.most:
            return
        first = len(self.first)
        times = self.times[first:]
        stay = np.flatnonzero(times > 1)
        if len(stay) > self.most // 2:
            stay = np.sort(np.argpartition(times, -(self.most // 2))[-(self.most // 2) :])
        words, at = list(self.place), np.concatenate([np.arange(first), stay + first])
        ids, upto = self.runs(at)
        self.place, self.runs, self.times = Places(), Runs(), self.times[at] // 2
        self.put([words[k] for k in at.tolist()], ids, np.diff(upto))

    def of(self, words, used: np.ndarray | None = None) -> np.ndarray:
        """Numbers of words; ``used`` tells how often each of them stands where it isn't once."""
        at = self.place.of(words)
        times = np.bincount(at, used, len(self.place)).astype(np.int64)
        times[: len(self.times)] += self.times
        self.times = times
        return at


def split(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts in a row, between ASCII white space, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    found, counts = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    some = pc.binary_length(found).to_numpy() > 0  # white space at either end of a text leaves an empty string there
    if not some.all():
        edge = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(counts)])]
        found, counts = found.filter(pa.array(some)), np.diff(edge)
    return found.dictionary_encode(), counts


class Words:
    """Ids of texts; ``path`` is a tokenizer file whose words end at ASCII white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), letters])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.word, self.part = Cache(CACHE), Cache(PARTS, (" ",))

    @staticmethod
    def encoded(words: list[str], tokenizer) -> list[np.ndarray]:
        return [np.array(f.ids, np.uint32) for f in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def whole(self, words: list[str]) -> list[np.ndarray]:
        return self.encoded(words, self.tokenizer)

    def library(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts, or of several between spaces."""
        return self.encoded(parts, self.plain)

    def learn_parts(self) -> None:
        new = self.part.place.noted()
        lots = [new[at : at + TOGETHER] for at in range(0, len(new), TOGETHER)]
        for some, ids in zip(lots, self.library([" ".join(x) for x in lots]), strict=True):
            size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(size) != len(some) or size.sum() != len(ids):
                each = self.library(some)
                ids, size = np.concatenate(each), np.array([len(e) for e in each])
            self.part.runs.add(ids, size)

    def learn(self, new: list[bytes]) -> None:
        """Ids of new words, in the order of their numbers."""
        text, odd = b" ".join(new).decode(), []
        if "<|" in text or not PLAINS.fullmatch(text):
            words = text.split(" ")
            odd = [k for k, w in enumerate(words) if "<|" in w or not PLAIN.fullmatch(w)]
            found = self.whole([words[k] for k in odd])
            for k in odd:
                words[k] = ""
            text = " ".join(words)
        parts = SPLIT.findall(text.lower())
        at = self.part.of(parts)
        self.learn_parts()
        ids, upto = self.part.runs(at)
        ends = upto[np.append(np.flatnonzero(at == 0), len(at))]
        size = np.diff(ends, prepend=0)
        if odd:
            ids = np.insert(ids, np.repeat(ends[odd], [len(f) for f in found]), np.concatenate(found))
            size[odd] = [len(f) for f in found]
        self.word.runs.add(ids, size)

    def encode(self, texts: list[bytes], end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text followed by ``end``, and the number of ids of each text."""
        found, counts = split(texts)
        self.word.trim()
        self.part.trim()
        which = found.indices.to_numpy()
        distinct = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        at = self.word.of(distinct, np.bincount(which, minlength=len(distinct)))
        if new := self.word.place.noted():
            self.learn(new)
        ids, upto = self.word.runs(at[which])
        edge = upto[np.concatenate([[0], np.cumsum(counts)])]
        if end is None:
            return ids, np.diff(edge)
        return np.insert(ids, edge[1:], end), np.diff(edge) + 1


@functools.cache
def words(name: str) -> Words:
    """The tokenizer of this worker; its cache serves all tasks that the worker runs."""
    return Words(tokenizer_path(name))


def groups(texts: list[bytes], most: int = 1 << 21):
    """Slices of a list of texts with at most so many bytes together, or one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))
