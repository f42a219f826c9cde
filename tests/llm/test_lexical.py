"""Block-Max MaxScore against full scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarte.llm import blocks, lexical

DOCS, ITEMS = "doc_id long, text string, shard int, score string", "item_id long, text string, item int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    found = [(d, Counter(terms_of(t))) for d, t, *_ in docs]
    n_docs = sum(1 for _, c in found if c)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = Counter()
    for item, text in dict.fromkeys((i, t) for i, t, *_ in items):
        scores = []
        for d, c in found:
            if c:
                m = 75 + (25 * sum(c.values()) * n_docs) // total
                s = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms_of(text) if c[t]
                )
                scores.append((-s, d is None, d or 0, d))
        best = sorted(s for s in scores if s[0] < 0)[:k]
        out.update((item, rank, d, -s) for rank, (s, _, _, d) in enumerate(best, 1))
    return out


def made(n, seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["The", "a1", "É", "x-y"]
    docs = []
    for k in range(n):
        weights = [1 / (1 + j) for j in range(len(words))]
        text = None if k % 97 == 0 else "" if k % 89 == 0 else " ".join(rnd.choices(words, weights, k=rnd.randrange(1, 60)))
        docs.append((None if k % 101 == 0 else k // 2 * 3 % 997, text, 1, "s"))
    docs.append((5000, "w0 " * 50_000, 1, "s"))  # a very long text
    docs += [(6000 + k, "w7 w8 w9 the", 1, "s") for k in range(300)]  # ties
    docs += [docs[3]] * 5  # repeated rows
    items = [(k, " ".join(rnd.choices(words, k=rnd.randrange(1, 12))), 0) for k in range(30)]
    items += [(100, "w7 W7 w8, w9", 0), (101, None, 0), (102, "", 0), (103, "nowhere", 0), (104, "w0 w0 w1 the THE", 0), items[0]]
    return docs, items


@pytest.mark.parametrize("shard, postings, queries", [(1 << 25, 128, 512), (3000, 4, 5)])
def test_equals_full_scores(spark, monkeypatch, shard, postings, queries):
    for name, value in (("SHARD", shard), ("POSTINGS", postings), ("QUERIES", queries)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = made(2500, 7)
    got = lexical.ranking(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), 20).collect()
    assert Counter(tuple(r) for r in got) == brute(docs, items, 20)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 0)], ITEMS)
    assert lexical.ranking(docs, items).count() == 0
    assert lexical.ranking(spark.createDataFrame([(1, "a", 0, "")], DOCS), items.limit(0)).count() == 0
    assert lexical.ranking(spark.createDataFrame([(1, None, 0, "")], DOCS), items).count() == 0


def test_blocks_without_candidates_stay_packed():
    """A rare term decides; the frequent one's blocks are unpacked only where a candidate is left."""
    n = 50_000
    rare = np.arange(0, n, 5000)
    m = np.full(n, 100)

    def listing(weight, docs, tf):
        data, begin = blocks.pack(np.stack([np.diff(docs, prepend=-1), tf], 1).ravel())
        opens = np.arange(0, len(docs), lexical.POSTINGS)
        closes = np.minimum(opens + lexical.POSTINGS, len(docs)) - 1
        most = np.maximum.reduceat(lexical.part(tf, m[docs]), opens)
        return lexical.Postings(weight, len(docs), docs[closes], begin[0::2][opens], most, data, m)

    often = listing(1, np.arange(n), np.ones(n, np.int64))
    seldom = listing(9000, rare, np.full(len(rare), 3))
    docs, scores = lexical.best([(often, 1), (seldom, 1)], n, 3)
    assert list(docs) == [0, 5000, 10000] and len(set(scores)) == 1
    assert often.open.sum() < len(often.open) / 20


def test_numbers_are_packed_and_unpacked():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5])
    data, begin = blocks.pack(values)
    assert (blocks.unpack(data) == values).all() and begin[0] == 0 and len(data) == 1 + 1 + 1 + 2 + 2 + 3 + 5 + 6 + 1
    assert len(blocks.unpack(blocks.pack(np.zeros(0, np.int64))[0])) == 0
