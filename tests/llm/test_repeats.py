"""Suffix-array dedup against a dictionary of all strings."""

import hashlib
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarte.llm import repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _spans string"


def brute(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, digest, left) for rows (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest(), left)
    return out


def texts(seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "größe", "ab", "🙂", "x", "delta,", "\n"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [say(60) for _ in range(4)]
    rows = [(i, say(r.randint(0, 80)) + r.choice(shared)[r.randint(0, 9) :] + say(r.randint(0, 40))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(200, ""), (201, None), (202, "a" * 1000), (203, "ab" * 700 + "a" * 300), (204, "a" * 99), (205, " " * 100)]
    rows += [(None, rows[3][1]), (300, "".join(shared) * 3)]
    for k, unit in enumerate(["hetiwh ", "are ", "ç ", "ab", "x" * 40 + "y", "0123456789" * 5]):
        rows += [(310 + 2 * k + j, f"{say(r.randint(5, 40))} {unit * r.randint(110 // len(unit) + 1, 110 // len(unit) + 20)} {say(30)}") for j in (0, 1)]
    return rows


@pytest.mark.parametrize("piece", [1 << 19, 256])
def test_equals_all_strings(spark, monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = texts(3)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in repeats.digests(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for doc, (n, removed, spans, digest, _) in want.items():
        g = got[doc]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (n, removed, spans, digest), doc
    kept = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert repeats.without_repeats(df).columns == df.columns
    for doc, text in rows:
        want_text = None if text is None else want[doc][4].decode("utf-8", "ignore")
        assert kept[doc].text == want_text and kept[doc]._spans == "own"
        assert kept[doc].n_chars == (None if text is None else len(want_text))


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(df).collect()}
    assert got == {i: w[:4] for i, w in want.items()}


def test_repeated_rows_and_ids(spark):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(90))
    rows = [(1, long), (1, long), (1, "other " + long), (2, long)]
    df = spark.createDataFrame([(i, t, None, None, 0, "") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.digests(df).collect())
    n = len(long)
    assert len(got) == 4 and got[3] == (2, n, n)
    assert got[0][2] == got[1][2] and sorted([got[0][2], got[2][2]]) == [0, n]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeats.digests(df).count() == 0 and repeats.without_repeats(df).columns == df.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=260), min_size=1, max_size=4))
def test_runs_hold_every_start_once(docs):
    data = [d.encode() for d in docs]
    ends = pd.Series([len(d) for d in data]).cumsum().tolist()
    bucket, name, first, n, _ = repeats.runs_of(b"".join(data), ends)
    starts = [p for f, k in zip(first, n) for p in range(f, f + k)]
    begins = [0, *ends[:-1]]
    assert starts == [p for b, e in zip(begins, ends) for p in range(b, e - 99)]
    named = {}
    for b, m, f, k in zip(bucket, name, first, n):
        assert named.setdefault((b, m), b"".join(data)[f : f + k + 99]) == b"".join(data)[f : f + k + 99]
