"""Totals of all rows before each row, in two levels, so that no task sees more than a share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def before(df: DataFrame, group: str, order: list[str], value: str, to: str) -> DataFrame:
    """Add ``to``: the sum of ``value`` over all rows of smaller ``group``, or of the same group and smaller ``order``.

    ``group`` is a whole number that never falls along the order and takes few values beside the rows."""
    inside = W.Window.partitionBy(group).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    total = df.groupBy(group).agg(F.sum(value).alias("_total"))
    over = W.Window.orderBy(group).rowsBetween(W.Window.unboundedPreceding, -1)
    total = total.select(group, F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"))
    out = df.withColumn(to, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(total, group)
    return out.withColumn(to, (F.col(to) + F.col("_base")).cast("long")).drop("_base")
