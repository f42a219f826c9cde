"""As-of joins of events to the nearest frame stamps.

Events and stamps are put in one table, ordered by time inside time chunks, and
the last and first stamp are carried to every event. One shuffle by (key, chunk);
a hot key is spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.operators.series import carry

HOUR_MS = 3_600_000


def neighbours(
    points: DataFrame,
    stamps: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    span: int = HOUR_MS,
    inclusive: bool = False,
) -> DataFrame:
    """Add ``before`` and ``after`` = struct(ts, value) of the neighbouring stamps.

    before is the last stamp earlier than the event (with ``inclusive``, not
    later), after the first stamp not earlier (with ``inclusive``, later)."""
    first, second = (1, 0) if inclusive else (0, 1)
    events = points.withColumns({"_rank": F.lit(first), "_seq": F.lit(0).cast("long")})
    marks = stamps.select(
        *keys,
        F.col(time),
        F.lit(second).alias("_rank"),
        F.col(value).cast("long").alias("_seq"),
        F.struct(F.col(time).alias("ts"), F.col(value).cast("long").alias(value)).alias("_stamp"),
    )
    rows = events.unionByName(marks, allowMissingColumns=True).withColumn("_time_chunk", F.expr(f"`{time}` div {span}"))
    found = carry(
        rows,
        keys,
        "_time_chunk",
        [time, "_rank", "_seq"],
        last={"before": F.col("_stamp")},
        first={"after": F.col("_stamp")},
    )
    return found.where(F.col("_stamp").isNull()).drop("_stamp", "_rank", "_seq", "_time_chunk")


def pick(found: DataFrame, time: str, mode: str = "nearest") -> DataFrame:
    """Add ``chosen`` by mode nearest, previous or next; both ends clamp. A tie of
    nearest goes to the earlier stamp."""
    t, b, a = F.col(time), F.col("before"), F.col("after")
    if mode == "previous":
        chosen = F.coalesce(b, a)
    elif mode == "next":
        chosen = F.coalesce(a, b)
    elif mode == "nearest":
        chosen = F.when(b.isNull() | a.isNull(), F.coalesce(b, a)).when(t - b["ts"] <= a["ts"] - t, b).otherwise(a)
    else:
        raise ValueError(f"unknown mode {mode}")
    return found.withColumn("chosen", chosen)
