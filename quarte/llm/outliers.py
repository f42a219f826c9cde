"""Quality rules by robust multivariate outliers (minimum covariance determinant).

Every text becomes a vector of five transformed statistics. For each language and source the mean and covariance of the
three quarters of its documents that lie closest together are estimated by concentration steps from three deterministic
starts; the start with the smallest determinant wins, the estimate is reweighted, and documents far from it by
Mahalanobis distance are rejected.

Each concentration step is one aggregation over all rows: distances are binned (16 bins per doubling), counts and
moments are summed per group and bin, and the bins that hold the nearest h rows are kept whole. So no group, however
large, is sorted or brought into one task, and equal rows are never split.

Defined results: a missing or empty text has no words and fails the base rule; missing languages and sources are groups
of their own; groups with fewer than ``min_group`` fitted rows are pooled per language, then over everything; a pool
that is still smaller rejects nothing. Repeated rows count as often as they occur. Columns of the input whose names
clash with the ones made here are replaced in ``statistics`` and left alone in ``keep``."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from quarte.llm.blocks import slices
from quarte.llm.common import for_lanes, in_lanes, join_small, longs, stage

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
P = 5
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


@dataclass(frozen=True)
class McdRules:
    coverage: float = 0.75  #: share of a group that the determinant is minimised over
    steps: int = 5  #: concentration steps from each start
    min_group: int = 100  #: fitted rows that a group needs for an estimate of its own
    reweight: float = 0.975  #: quantile of the chi-square law for the reweighted estimate
    reject: float = 1 - 1e-5  #: quantile beyond which a document goes
    floor: tuple[float, ...] = (0.3, 0.06, 0.3, 0.5, 0.08)  #: spread that each statistic has at least
    bins: int = 16  #: distance bins per doubling of the squared distance


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n = len(words)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = np.zeros(n, bool)
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    covered[i : i + 3] = True
            repeat = int(covered.sum())
    return (
        n,
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
    )


def statistics(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns with the five base statistics of every whole text and the base verdict."""
    columns = [c for c in columns if c not in STATS and c != "base_failed"]
    given = docs.select(*columns, *([] if text in columns else [text]))
    out = T.StructType([given.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in STATS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            found = [text_stats(b) for b in texts]
            cols = [batch.column(c) for c in columns] + [longs([f[k] for f in found]) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, *STATS])

    n, rep = F.col("n_words"), F.col("n_repeat_words")
    return given.mapInArrow(measure, out).withColumn("base_failed", (n < 50) | (100 * rep > 50 * n))


def vector() -> list[Column]:
    """Transformed statistics: log length, log word length, symbols and repeated lines on a log scale, repeated share."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p("n_words").alias("f0"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("f1"),
        F.log1p(10 * F.col("n_symbols") / n).alias("f2"),
        F.log1p("n_dup_lines").alias("f3"),
        (F.col("n_repeat_words") / n).alias("f4"),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """Share of the chi-square law with k degrees of freedom up to x, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


@functools.cache
def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` right for normal data."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def groups(rows: DataFrame, rules: McdRules) -> DataFrame:
    """Language and source of every group with the key of the estimate it takes."""
    small = F.col("n") < rules.min_group
    lang, everything = W.Window.partitionBy("lang"), W.Window.partitionBy("level")
    counted = rows.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    pooled = counted.withColumn("pool", F.sum(F.when(small, F.col("n")).otherwise(0)).over(lang))
    level = F.when(~small, 0).when(F.col("pool") >= rules.min_group, 1).otherwise(2)
    keyed = pooled.withColumn("level", level).withColumn("rest", F.sum("n").over(everything))
    key = F.to_json(
        F.struct(
            "level",
            F.when(F.col("level") < 2, F.col("lang")).alias("lang"),
            F.when(F.col("level") < 1, F.col("source")).alias("source"),
        )
    )
    enough = (F.col("level") < 2) | (F.col("rest") >= rules.min_group)
    return keyed.select("lang", "source", F.when(enough, key).alias("grp"))


def attach(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Give every row what its language and source have; missing values match each other."""
    rows, other = in_lanes(rows), for_lanes(small.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    on = rows["lang"].eqNullSafe(other["_lang"]) & rows["source"].eqNullSafe(other["_source"])
    on &= rows["_lane"] == other["_lane"]
    return rows.join(other, on, "left").drop("_lang", "_source", "_lane")


def moments() -> list[Column]:
    x = [F.col(f"f{i}") for i in range(P)]
    return [
        F.count(F.lit(1)).alias("n"),
        *(F.sum(x[i]).alias(f"s{i}") for i in range(P)),
        *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in PAIRS),
    ]


MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in PAIRS)]
ESTIMATE = "grp string, start int, mean array<double>, inv array<double>, logdet double"


def estimates(summed: DataFrame, factor: float, rules: McdRules) -> DataFrame:
    """Mean, inverse covariance and its log determinant from the summed moments of each group and start."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            n = f["n"].to_numpy(float)
            mean = f[[f"s{i}" for i in range(P)]].to_numpy(float) / n[:, None]
            cov = np.zeros((len(f), P, P))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = f[f"s{i}_{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            cov = factor * cov + np.diag(np.square(rules.floor))
            yield pd.DataFrame(
                {
                    "grp": f["grp"], "start": f["start"], "mean": list(mean),
                    "inv": list(np.linalg.inv(cov).reshape(len(f), -1)), "logdet": np.linalg.slogdet(cov)[1],
                }
            )

    return summed.select("grp", "start", *MOMENTS).mapInPandas(solve, ESTIMATE)


def distance() -> Column:
    """Squared Mahalanobis distance of f0.. from the columns mean and inv."""
    z = [F.col(f"f{i}") - F.col("mean")[i] for i in range(P)]
    return sum(((1 if i == j else 2) * z[i] * z[j] * F.col("inv")[i * P + j] for i, j in PAIRS), F.lit(0.0))


def starts(rows: DataFrame, rules: McdRules) -> DataFrame:
    """Three starts for each group: classical moments, medians with quartile ranges, and those with the correlations
    of squashed scores."""
    classical = estimates(rows.groupBy("grp").agg(*moments()).withColumn("start", F.lit(0)), 1.0, rules)
    quartiles = rows.groupBy("grp").agg(
        *(F.percentile_approx(f"f{i}", [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i in range(P))
    )
    quartiles = stage(quartiles)

    def spread(i: int) -> Column:
        return F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(rules.floor[i]))

    score = [F.tanh((F.col(f"f{i}") - F.col(f"q{i}")[1]) / spread(i)) for i in range(P)]
    squashed = join_small(rows, quartiles, "grp", "inner").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(score[i] * score[j]).alias(f"t{i}_{j}") for i, j in PAIRS)
    )
    both = quartiles.join(squashed, "grp").select(
        "grp", F.explode(F.array(F.lit(1), F.lit(2))).alias("start"), "n",
        *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(P)), *(spread(i).alias(f"d{i}") for i in range(P)),
        *(f"t{i}_{j}" for i, j in PAIRS),
    )

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            d = f[[f"d{i}" for i in range(P)]].to_numpy(float)
            corr = np.zeros((len(f), P, P))
            for i, j in PAIRS:
                corr[:, i, j] = corr[:, j, i] = f[f"t{i}_{j}"].to_numpy(float) / f["n"].to_numpy(float)
            diag = np.sqrt(np.maximum(np.einsum("nii->ni", corr), 1e-9))
            corr /= diag[:, :, None] * diag[:, None, :]
            corr[f["start"].to_numpy() == 1] = np.eye(P)
            cov = corr * d[:, :, None] * d[:, None, :] + np.diag(np.square(rules.floor))
            yield pd.DataFrame(
                {
                    "grp": f["grp"], "start": f["start"], "mean": list(f[[f"m{i}" for i in range(P)]].to_numpy(float)),
                    "inv": list(np.linalg.inv(cov).reshape(len(f), -1)), "logdet": np.linalg.slogdet(cov)[1],
                }
            )

    return classical.unionByName(both.mapInPandas(solve, ESTIMATE))


def concentrate(rows: DataFrame, now: DataFrame, rules: McdRules) -> DataFrame:
    """One concentration step: moments of the bins of distance that hold the nearest h rows of each group and start."""
    bin_of = F.floor(rules.bins * F.log2(F.col("d2") + 2.0**-20)).alias("bin")
    binned = join_small(rows, now, "grp", "inner").withColumn("d2", distance()).groupBy("grp", "start", bin_of).agg(*moments())
    each = W.Window.partitionBy("grp", "start")
    upto = F.sum("n").over(each.orderBy("bin").rowsBetween(W.Window.unboundedPreceding, 0))
    near = binned.withColumns({"upto": upto, "size": F.sum("n").over(each)})
    near = near.filter(F.col("upto") - F.col("n") < F.ceil(rules.coverage * F.col("size")))
    summed = near.groupBy("grp", "start").agg(*(F.sum(c).alias(c) for c in MOMENTS))
    return estimates(summed, consistency(rules.coverage), rules)


def fit(rows: DataFrame, rules: McdRules | None = None) -> DataFrame:
    """Estimate per group (grp, mean, inv) from rows (lang, source, base_failed, statistics), with lang and source."""
    rules = rules or McdRules()
    named = stage(groups(rows, rules))
    fitted = stage(
        attach(rows.filter(~F.col("base_failed")), named).filter(F.col("grp").isNotNull()).select("grp", *vector())
    )
    now = stage(starts(fitted, rules))
    for _ in range(rules.steps):
        now = stage(concentrate(fitted, now, rules))
    best = now.groupBy("grp").agg(F.min_by(F.struct("mean", "inv"), F.struct("logdet", "start")).alias("b"))
    best = best.select("grp", "b.mean", "b.inv", F.lit(0).alias("start"))
    inside = join_small(fitted, best, "grp", "inner").filter(distance() <= chi2_quantile(rules.reweight, P))
    final = estimates(inside.groupBy("grp", "start").agg(*moments()), consistency(rules.reweight), rules)
    return stage(named.join(final.select("grp", "mean", "inv"), "grp", "left"))


def judge(rows: DataFrame, fitted: DataFrame, rules: McdRules | None = None) -> DataFrame:
    """Add the squared distance and the verdict to rows with statistics; rows without an estimate keep the base verdict."""
    rules = rules or McdRules()
    given = rows.columns
    f = vector()
    out = attach(rows.select("*", *f), fitted).withColumn("outlier_distance", F.round(F.sqrt(distance()), 6))
    limit = math.sqrt(chi2_quantile(rules.reject, P))
    near = F.coalesce(F.col("outlier_distance") <= limit, F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & near).select(*given, "outlier_distance", "kept")


def quality(docs: DataFrame, rules: McdRules | None = None) -> DataFrame:
    """One row per document: doc_id, the base statistics and verdict, kept, and the distance."""
    rows = stage(statistics(docs, ["doc_id", "lang", "source"]))
    judged = judge(rows, fit(rows, rules), rules)
    return judged.select("doc_id", *STATS, "base_failed", "kept", "outlier_distance")


def keep(docs: DataFrame, rules: McdRules | None = None) -> DataFrame:
    """The documents that pass, with all their columns as they were.

    Texts are measured once: the documents are stored beside their statistics, the estimates read only those, and the
    verdict filters the stored rows. Columns are numbered meanwhile, so no name clashes."""
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    numbered = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    measured = statistics(numbered, list(names.values()), names["text"])
    rows = stage(measured.withColumns({c: F.col(names[c]) for c in ("lang", "source")}))
    judged = judge(rows, fit(rows, rules), rules).filter("kept")
    return judged.select(*(F.col(n).alias(c) for c, n in names.items()))
