"""The source divergence audit against counters."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarte.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, g long, block int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, min_docs, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = terms_of(text)
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in docs.items()}
    out = set()

    def shares(counts, lang):
        total = sum(counts[t] for t in kept[lang])
        return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    for lang, source in groups:
        of_lang = sum((c for (a, _), c in groups.items() if a == lang), Counter())
        p, q = shares(groups[lang, source], lang), shares(of_lang, lang)
        found = {"pair": [], "term": []}
        for other in {b for a, b in groups if a == lang and b != source}:
            r = shares(groups[lang, other], lang)
            found["pair"].append((-sum(abs(p[t] - r[t]) for t in p), other.encode()))
        found["term"] = [(q[t] - p[t], t.encode()) for t in p if groups[lang, source][t] and p[t] > q[t]]
        for part, items in found.items():
            for rank, (value, item) in enumerate(sorted(items), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item.decode(), -value, rank))
    return out


def made(n=400, seed=3):
    rnd = random.Random(seed)
    words = ["The", "the,", "the-the", "ab", "Ab;cd", "é x", "cd9ef", "12", "x", "(ab)", "ef\u0000gh", "ÀB", "zz"]
    rows = []
    for k in range(n):
        text = None if k % 37 == 0 else "" if k % 41 == 0 else " \n\t".join(rnd.choice(words[: 5 + k % 9]) for _ in range(rnd.randrange(40)))
        rows.append((k % 300, text, rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "a", "b", None, "é"]), 1, 2))
    rows.append((1, "word " * 200_000, "en", "a", 1, 2))  # a very long text
    rows += [rows[5]] * 30  # repeated rows
    rows.append((7, None, "xx", "only", 1, 2))  # a language without terms
    rows.append((8, "1 2 3", "xx", "other", 1, 2))
    return rows


@pytest.mark.parametrize("block, span, band, terms", [(1 << 25, 512, 256, 4096), (500, 1, 2, 3)])
def test_equals_counters(spark, monkeypatch, block, span, band, terms):
    for name, value in (("BLOCK", block), ("SPAN", span), ("BAND", band), ("TERMS", terms)):
        monkeypatch.setattr(divergence, name, value)
    rows = made()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if block == 500 else "10000")
    try:
        got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), 20, 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, 20, 4)


def test_many_groups_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 1)
    rows = made(120, 5)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), 20, 4).collect()
    assert {tuple(r) for r in got} == brute(rows, 20, 4)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 2**40), st.integers(0, 20000)), max_size=40))
def test_postings_packed_in_parts_are_the_same_bytes(rows):
    table = np.array(rows, np.int64).reshape(-1, 3)
    data, begin = divergence.pack(table.ravel())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(divergence, "ROWS", 3)
        got, edges = divergence.packed(*table.T)
    assert got.tolist() == data.tolist() and edges.tolist() == [*begin[::3].tolist(), len(data)]


def test_exchanges_of_the_counting_are_given_back(spark, monkeypatch):
    """They are most of the disk, so they go before the shares are made."""
    seen, stage = [], divergence.stage
    monkeypatch.setattr(divergence, "free", lambda spark: seen.append("free"))
    monkeypatch.setattr(divergence, "stage", lambda df: seen.append("stage") or stage(df))
    divergence.audit(spark.createDataFrame([(1, "a b a", "en", "x", 0, 0)], SCHEMA), 1).collect()
    assert seen.index("free") == 2 and seen.count("free") == 1 and "stage" in seen[3:]
