"""Quality rules: statistics against plain Python, and the estimates against numpy on the same rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarte.llm import outliers

SCHEMA = "doc_id long, text string, lang string, source string, grp string, start int, mean double"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {k for i, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x1c\x85\xa0#é😀"), max_size=60))
def test_statistics(text):
    assert outliers.text_stats(text.encode()) == plain(text)


@pytest.mark.parametrize("text", ["word " * 200_000, "\n".join(f"l{i % 900} x{i} y" for i in range(60_000)), "é" * 300_000 + " b\n" + "c" * 5000, "# | " * 100_000])
def test_statistics_of_very_long_texts(text):
    assert outliers.text_stats(text.encode()) == plain(text)


@pytest.mark.parametrize("x,k,p", [(3.841459, 1, 0.95), (11.0705, 5, 0.95), (30.856, 5, 0.99999), (18.475, 7, 0.99)])
def test_chi_square(x, k, p):
    assert outliers.chi2_cdf(x, k) == pytest.approx(p, abs=1e-5)
    assert outliers.chi2_quantile(p, k) == pytest.approx(x, rel=1e-4)


def corpus(seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(900):
        lang, source = r.choice([("en", "a"), ("en", "b"), ("de", None), (None, "b")])
        n = int(r.lognormvariate(5.2, 0.6)) + 50
        text = "\n".join(" ".join("x" * r.randint(2, 9) + str(r.randrange(9999)) for _ in range(10)) for _ in range(n // 10 + 1))
        rows.append([i, text, lang, source])
    for i in range(0, 900, 30):
        rows[i][1] = rows[i][1].replace(" ", " ### ")
    rows += [[1000, "", "en", "a"], [1001, None, None, None], [1002, "one two " * 100, "en", "b"], [1003, rows[5][1], "xx", "rare"], rows[7]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 1, 2.0) for r in rows], SCHEMA)


def vectors(rows):
    out = []
    for r in rows:
        n, chars, sym, dup, rep = plain(r[1])
        m = max(n, 1)
        out.append((np.log1p(n), np.log(max(chars, 1) / m), np.log1p(10 * sym / m), np.log1p(dup), rep / m))
    return np.array(out)


def brute(x, rules):
    """Reweighted estimate of one group, by the same steps over plain arrays."""
    floor = np.diag(np.square(rules.floor))

    def estimate(rows, factor):
        return rows.mean(0), factor * np.cov(rows.T, bias=True) + floor

    def far(at, cov):
        z = x - at
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)

    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    d = np.maximum((q[2] - q[0]) / 1.349, rules.floor)
    t = np.tanh((x - q[1]) / d)
    corr = t.T @ t / len(x)
    diag = np.sqrt(np.maximum(np.diag(corr), 1e-9))
    begin = [estimate(x, 1.0), (q[1], np.diag(d * d) + floor), (q[1], corr / np.outer(diag, diag) * np.outer(d, d) + floor)]
    best = None
    for k, (at, cov) in enumerate(begin):
        for _ in range(rules.steps):
            bins = np.floor(rules.bins * np.log2(far(at, cov) + 2.0**-20))
            kinds, n = np.unique(bins, return_counts=True)
            inside = np.isin(bins, kinds[np.cumsum(n) - n < np.ceil(rules.coverage * len(x))])
            at, cov = estimate(x[inside], outliers.consistency(rules.coverage))
        found = (np.linalg.slogdet(cov)[1], k, at, cov)
        best = min(best, found, key=lambda f: f[:2]) if best else found
    inside = far(*best[2:]) <= outliers.chi2_quantile(rules.reweight, 5)
    return far(*estimate(x[inside], outliers.consistency(rules.reweight)))


def test_equals_numpy(spark):
    rows, rules = corpus(), outliers.McdRules()
    got = outliers.quality(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, r)
    for r in rows:
        s = plain(r[1])
        g = found[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == s
        assert g.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert not (g.base_failed and g.kept)
    passed = [r for r in rows if not found[r[0]].base_failed]
    for key in {("en", "a"), ("en", "b"), ("de", None), (None, "b")}:
        own = [r for r in passed if (r[2], r[3]) == key]
        want = np.sqrt(brute(vectors(own), rules))
        mine = np.array([found[r[0]].outlier_distance for r in own])
        assert len(own) >= rules.min_group and np.allclose(mine, want, rtol=1e-3, atol=1e-3)
        limit = np.sqrt(outliers.chi2_quantile(rules.reject, 5))
        assert [found[r[0]].kept for r in own] == (want <= limit).tolist()
    junk = {r[0] for r in rows[:900:30]}
    assert not any(found[i].kept for i in junk) and sum(found[r[0]].kept for r in passed if r[0] not in junk) >= 0.99 * (len(passed) - len(junk))


def test_keep_gives_the_rows_as_they_were(spark):
    rows = corpus()
    df = frame(spark, rows).repartition(5)
    want = sorted(r.doc_id for r in outliers.quality(df).collect() if r.kept)
    kept = outliers.keep(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert {(r.grp, r.start, r.mean) for r in kept.collect()} == {("own", 1, 2.0)}


def test_small_and_empty_tables(spark):
    few = frame(spark, corpus()[:20])
    assert all(r.kept != r.base_failed for r in outliers.quality(few).collect())
    assert outliers.quality(frame(spark, [])).count() == 0 and outliers.keep(frame(spark, [])).count() == 0
