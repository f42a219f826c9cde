"""Similarity join against all pairs of small tables."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarte.llm import jaccard

SCHEMA = "doc_id long, text string, component string"


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (set sizes, smallest reachable id); a missing id sorts first."""
    key = lambda i: -1 if i is None else i
    sets = [(key(i), shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def table(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "É", "🙂"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = say(60)
    rows, base = [], []
    for i in range(25):
        base.append(say(r.choice([1, 3, 4, 5, 6, 9, 13, 14, 40, 120, 400])))
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5, 12])):
            at = r.randrange(len(w) + 1)
            w[at : at + r.choice([0, 1])] = say(r.choice([0, 1])) or w[at : at + 1]
        if r.random() < 0.3:
            w += passage
        text = r.choice([" ", "\n", " \t"]).join(w)
        rows.append((i, text.upper() if r.random() < 0.1 else text))
    rows += [(500, ""), (501, None), (502, " \n"), (503, rows[0][1]), (None, rows[1][1]), (504, "w1"), (505, "W1")]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1024), (3, 3)])
def test_equals_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = table(seed)
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA).repartition(3)
    got = jaccard.near_duplicates(df).collect()
    want = brute(rows)
    key = lambda i: -1 if i is None else i
    assert len(got) == len(rows)
    assert {key(r.doc_id): key(r.component_id) for r in got} == want
    size = {key(i): len(shingle_set(t)) for i, t in rows}
    assert all(r.n_shingles == size[key(r.doc_id)] for r in got)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert {key(r.doc_id) for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_second_round_finds_links_away_from_the_hub(spark):
    """Members that meet in tiles whose hub is unlike them still link."""
    r = random.Random(5)
    say = lambda n: [f"v{r.randrange(500)}" for _ in range(n)]
    shared = say(200)
    rows = [(i, " ".join(say(3) + shared + say(80 if i < 3 else 30))) for i in range(12)]
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v"), (9, "q r s t u v"), (4, "")]
    got = jaccard.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 2, 3)] * 3 + [(4, 0, 4), (9, 2, 3)]
    kept = jaccard.one_of_each(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, "a b c d e f"), (3, "q r s t u v"), (4, "")]
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 120), st.data())
def test_linked_sets_share_a_tile_and_pass_the_bound(n, data):
    r = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    a = r.integers(0, 2**64, n, dtype=np.uint64)
    drop = data.draw(st.integers(0, n // 5))
    add = data.draw(st.integers(0, n // 5))
    b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**64, add, dtype=np.uint64)]))
    a = np.unique(a)
    shared = len(np.intersect1d(a, b))
    if len(b) and jaccard.linked(shared, len(a) + len(b)):
        assert np.intersect1d(jaccard.tile_keys(a), jaccard.tile_keys(b)).size
        bits = [np.frombuffer(jaccard.bitmap(x), np.uint64) for x in (a, b)]
        assert jaccard.can_link(*bits, len(a), len(b))


def test_very_long_texts_and_words(spark):
    """Texts of a hundred thousand words, and words beyond 4,096 bytes that differ in their last character only."""
    r = random.Random(4)
    words = [f"v{r.randrange(50_000)}" for _ in range(100_000)]
    near = [f"u{i}" if i % 47 == 0 else w for i, w in enumerate(words)]
    far = [f"u{i}" if i % 30 == 0 else w for i, w in enumerate(words)]
    long_word = "é" * 5000
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, long_word + "a"), (5, long_word + "b"), (6, long_word + "a")]
    rows += [(7, f"{long_word}a b c d e"), (8, f"{long_word}A b c d e"), (9, f"{long_word}b b c d e")]
    df = spark.createDataFrame([(*x, "c") for x in rows], SCHEMA).repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df).collect()}
    assert {i: c for i, (_, c) in got.items()} == brute(rows)
    assert all(got[i][0] == len(shingle_set(t)) for i, t in rows)


def test_long_batches_are_worked_on_in_slices():
    """A batch of ten thousand texts or sets was turned into objects at once, which took the memory of its worker."""
    import pyarrow as pa

    n = 3000
    texts = [f"a b c d {i} e" for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": texts})
    sets = list(jaccard.to_sets(iter([batch])))
    assert [b.num_rows for b in sets] == [1024, 1024, 952]
    items = pa.Table.from_batches(sets).combine_chunks().to_batches()[0].column("items")
    pairs = pa.RecordBatch.from_arrays([batch.column(0)] * 2 + [items] * 2, names=["a", "b", "aitems", "bitems"])
    found = list(jaccard.by_items(iter([pairs])))
    assert max(b.num_rows for b in found) <= 1024 and sum(b.num_rows for b in found) == n
    assert sum(b.num_rows for b in jaccard.measure(iter([batch]))) == n
