"""PPM scores against a dictionary of contexts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarte.llm import ppm

SCHEMA = "doc_id long, text string, batch int, score string"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def symbols(text):
    return [*b" ".join(words_of(text)), 256]


def contexts(text):
    past = [0] * ppm.ORDER
    for s in symbols(text):
        yield tuple(past[-ppm.ORDER :]), s
        past.append(s)


def brute(rows):
    trie = defaultdict(Counter)
    for doc, text in rows:
        if not held(doc):
            for c, s in contexts(text):
                for k in range(ppm.ORDER + 1):
                    trie[c[k:]][s] += 1

    def probability(c, s):
        excluded, p = set(), 1.0
        for k in range(ppm.ORDER + 1):
            seen = trie.get(c[k:])
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in excluded}
            excluded |= set(seen)
            if not left:
                continue
            total = sum(left.values())
            if s in left:
                return p * (left[s] - 0.5) / total
            p *= len(left) / (2 * total)
        return p / (257 - len(trie.get((), ())))

    counts, ends = Counter(), 0
    for doc, text in rows:
        if not held(doc):
            counts.update(words_of(text))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for doc, text in rows:
        w = words_of(text)
        c = [counts[x] for x in w] + [ends]
        base = sum(math.log10((x + 1) / (total + distinct + 1)) for x in c)
        score = sum(math.log10(probability(*x)) for x in contexts(text))
        out.append((doc, held(doc), len(w) + 1, sum(x > 0 for x in c), total, base, score))
    return out, probability


def table():
    r = random.Random(2)
    vocab = ["the", "The", "cat", "sat", "größe", "a\x00b", "\U0001f642", "mat.", "x"]
    rows = [(i, r.choice([" ", "\n "]).join(r.choice(vocab) for _ in range(r.randint(0, 40)))) for i in range(60)]
    rows += [(100, ""), (101, None), (102, "zzz unseen words"), (None, "no id cat"), (5, "same id"), rows[7], (103, "the cat " * 3000)]
    return rows


@pytest.mark.parametrize("batch,piece", [(1 << 25, 1 << 20), (300, 50)])
def test_equals_the_dictionary(spark, monkeypatch, batch, piece):
    monkeypatch.setattr(ppm, "BATCH", batch)
    monkeypatch.setattr(ppm, "PIECE", piece)
    rows = table()
    got = ppm.scores(spark.createDataFrame([(i, t, 9, "own") for i, t in rows], SCHEMA).repartition(3)).collect()
    want, _ = brute(rows)
    key = lambda x: (x[0] is not None, x[0] or 0, x[2], x[5])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_sum_to_one():
    rows = [r for r in table() if r[0] != 103]
    _, probability = brute(rows)
    for c in [(0,) * 5, tuple(b" the "), tuple(b"qqqqq"), tuple(b"qqqqt")]:
        assert sum(probability(c, s) for s in range(257)) == pytest.approx(1)


def test_held_out_texts_are_predicted_better_than_by_words(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = ppm.scores(df).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_only_held_out_and_empty_tables(spark):
    ids = [i for i in range(100) if held(i)][:3]
    got = ppm.scores(spark.createDataFrame([(i, "ab", 0, "") for i in ids], SCHEMA)).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert all(r.score == pytest.approx(-3 * math.log10(257)) and r.base_score == 0 for r in got)
    assert ppm.scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lookup():
    r = np.random.default_rng(0)
    key = np.unique(r.integers(0, 1 << 41, 5000))
    look = ppm.Lookup(key, np.arange(len(key)) + 1.0, 0.0)
    assert (look(key) == np.arange(len(key)) + 1.0).all() and (look(key + 1)[~np.isin(key + 1, key)] == 0).all()
    assert ppm.Lookup(key[:0], np.zeros(0), 7.0)(key[:4]).tolist() == [7.0] * 4
