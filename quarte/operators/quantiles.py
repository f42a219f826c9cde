"""Exact middles of large groups.

``percentile`` keeps every distinct value of a group in one buffer. Here an
approximate percentile bounds a narrow band around the middle, the band is cut
into bins, and only the bin that holds the wanted rank is sorted. All results
are exact; the approximation only decides how much is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarte.operators.series import spread_join

BINS = 1024
ACCURACY = 2000


def middle(df: DataFrame, keys: Sequence[str], value: Column, name: str, upper: bool = False) -> DataFrame:
    """Median of ``value`` per key (mean of the two middles), or with ``upper``
    the element at position count/2 of the sorted values. Nulls are ignored."""
    rows = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    band = F.percentile_approx("_v", [0.498, 0.502], ACCURACY)
    stats = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        band.alias("_band"),
    )
    # Two ranks of slack on both sides cover the rounding of tiny groups.
    lo = F.when(F.col("_n") < ACCURACY, F.col("_min")).otherwise(F.col("_band")[0])
    hi = F.when(F.col("_n") < ACCURACY, F.lit(None)).otherwise(F.col("_band")[1])
    stats = stats.select(*keys, "_n", lo.alias("_lo"), hi.alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / BINS
    slot = F.when(F.col("_v") < F.col("_lo"), -1).otherwise(
        F.coalesce(F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / F.nullif(width, F.lit(0.0)))), F.lit(0))
    )
    counted = (
        spread_join(rows, stats, keys, F.col("_v"))
        .where(F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
        .withColumn("_slot", slot.cast("int"))
        .withColumn("_v", F.when(F.col("_slot") >= 0, F.col("_v")))
        .groupBy(*keys, "_slot", "_v", "_n")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    first_rank = (F.col("_n") / 2).cast("long") if upper else ((F.col("_n") - 1) / 2).cast("long")
    last_rank = (F.col("_n") / 2).cast("long")
    slots = (
        counted.groupBy(*keys, "_slot", "_n")
        .agg(F.sum("_c").alias("_in_slot"))
        .withColumn("_skip", F.coalesce(F.sum("_in_slot").over(before), F.lit(0)))
        .withColumn("_from", first_rank)
        .withColumn("_to", last_rank)
        .where((F.col("_skip") <= F.col("_to")) & (F.col("_skip") + F.col("_in_slot") > F.col("_from")))
        .select(*keys, "_slot", "_skip", "_from", "_to")
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy("_v")
    end = F.col("_skip") + F.sum("_c").over(inside)
    picks = (
        counted.drop("_n")
        .join(slots, [*keys, "_slot"])
        .withColumn("_end", end)
        .where((F.col("_end") > F.col("_from")) & (F.col("_end") - F.col("_c") <= F.col("_to")))
    )
    out = F.max("_v") if upper else (F.min("_v") + F.max("_v")) / 2
    return picks.groupBy(*keys).agg(out.alias(name))
