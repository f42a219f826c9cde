"""Connected components of a graph given by edges, as Spark joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.llm.common import stage


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def fingerprint(edges: DataFrame) -> tuple:
    code = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(code)).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (node, component): the smallest node that each node of the graph can reach."""
    now = stage(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct())
    before = None
    while (seen := fingerprint(now)) != before:
        before = seen
        now = stage(large_star(now).distinct())
        now = stage(small_star(now).distinct())
    least = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return least.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
