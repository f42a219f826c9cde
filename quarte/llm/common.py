"""Small helpers that several of these operators share."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarte.session import stage

__all__ = ["blobs", "for_lanes", "free", "in_lanes", "join_small", "keyed", "longs", "parts", "slices", "stage", "table", "unstage"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; a missing text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that what is made of one stays small where rows are long."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def keyed(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """Deal rows by key and sort each part by the given columns (the first is the key)."""
    return df.repartition(n, F.col(cols[0])).sortWithinPartitions(*cols)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    It acts on what the driver's garbage collection finds, every 30 minutes unless asked; a job of several large
    exchanges would hold all of them until then."""
    for _ in range(2):  # the first round drops the plans, the second what they alone referred to
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


LANES = 32  #: tasks that a hot key of a join with a small table is dealt over


def in_lanes(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).alias("_lane"))


def for_lanes(small: DataFrame) -> DataFrame:
    lanes = F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))
    return small.select("*", F.explode(lanes).alias("_lane"))


def join_small(rows: DataFrame, small: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join with a table of few rows per key, so that a hot key is dealt over several tasks if it comes to a shuffle."""
    return in_lanes(rows).join(for_lanes(small), [on, "_lane"], how).drop("_lane")


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("quarte-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
