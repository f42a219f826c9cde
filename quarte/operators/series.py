"""Order-dependent work over long series, cut into chunks of bounded size.

A series is one key (a phrase and side, a match, a user) with dense frame
numbers or timestamps. A plain ``Window.partitionBy(key)`` puts a whole series
in one task, which fails when one key holds a large part of the data. Every
helper here partitions by (key, chunk) instead and exchanges only small
summaries between chunks:

* ``nearby``   bounded windows (lag, lead, rows between a and b): edge rows are
               copied into the neighbouring chunk, so one shuffle is enough;
* ``carry``    last or first present value over an unbounded range: one summary
               row per chunk carries the value over chunk edges;
* ``number``   dense row numbers from per-chunk counts;
* ``running``  sums over all earlier rows from per-chunk sums;
* ``runs``     islands of flagged frames with mergeable measures; only pieces
               that touch a chunk edge are merged across chunks;
* ``overlap_join`` interval joins on equal keys and equal frame buckets;
* ``spread_join``  a join of many rows per key with one row per key, with the
               hot side spread over lanes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Frames per chunk. Bounds what one task sees of one series.
CHUNK = 8192
# Frames per bucket of an interval join. Bounds the pairs compared per bucket.
BUCKET = 256
# Lanes a hot key is spread over when it meets a one-row-per-key table.
LANES = 16

_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_START = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}

UP = (Window.unboundedPreceding, Window.currentRow)


def chunk_of(frame: str, size: int | None = None) -> Column:
    return F.expr(f"`{frame}` div {size or CHUNK}")


def nearby(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    before: int,
    after: int,
    build: Callable,
) -> DataFrame:
    """Apply ``build(df, window)`` where the window reaches ``before`` frames
    back and ``after`` frames ahead. Frames must be dense within a key."""
    size = CHUNK
    if max(before, after) > size:
        raise ValueError("a bounded window may not reach further than one chunk")
    home = chunk_of(frame)
    offset = F.expr(f"pmod(`{frame}`, {size})")
    homes = [home]
    if before:
        homes.append(F.when(offset >= size - before, home + 1))
    if after:
        homes.append(F.when(offset < after, home - 1))
    rows = df.withColumn("_chunk", F.explode(F.array_compact(F.array(*homes))))
    window = Window.partitionBy(*keys, "_chunk").orderBy(frame)
    return build(rows, window).where(F.col("_chunk") == home).drop("_chunk")


def carry(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    last: dict[str, Column] | None = None,
    first: dict[str, Column] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Add the latest present value at or before a row (``last``) and the
    earliest present value at or after it (``first``); ``strict`` leaves out the
    row itself."""
    last, first = last or {}, first or {}
    up = (Window.unboundedPreceding, -1) if strict else UP
    # Looking ahead is looking back in reverse order: a running frame is linear,
    # one that ends at the last row is recomputed for every row.
    window = Window.partitionBy(*keys, chunk).orderBy(*order)
    reverse = Window.partitionBy(*keys, chunk).orderBy(*[F.desc(c) for c in order])
    before = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(*before)
    later = Window.partitionBy(*keys).orderBy(F.desc(chunk)).rowsBetween(*before)

    local, sums, carried = df, [], []
    for name, value in last.items():
        local = local.withColumn(name, F.last(value, ignorenulls=True).over(window.rowsBetween(*up)))
        stamped = F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order], value.alias("v")))
        sums.append(F.max(stamped)["v"].alias(f"_{name}"))
        carried.append(F.last(f"_{name}", ignorenulls=True).over(earlier).alias(f"_{name}"))
    for name, value in first.items():
        local = local.withColumn(name, F.last(value, ignorenulls=True).over(reverse.rowsBetween(*up)))
        stamped = F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order], value.alias("v")))
        sums.append(F.min(stamped)["v"].alias(f"_{name}"))
        carried.append(F.last(f"_{name}", ignorenulls=True).over(later).alias(f"_{name}"))
    summary = df.groupBy(*keys, chunk).agg(*sums).select(*keys, chunk, *carried)
    out = local.join(summary, [*keys, chunk])
    for name in [*last, *first]:
        out = out.withColumn(name, F.coalesce(name, f"_{name}")).drop(f"_{name}")
    return out


def number(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence,
    name: str = "frame",
    totals: dict[str, tuple[str, Column]] | None = None,
    start: int = 0,
) -> DataFrame:
    """Number the rows of a key from ``start``. ``chunk`` must rise with the
    order. ``totals`` adds whole-key measures from the same summary."""
    totals = totals or {}
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        df.groupBy(*keys, chunk)
        .agg(F.count(F.lit(1)).alias("_n"), *[_START[how](col).alias(n) for n, (how, col) in totals.items()])
        .select(
            *keys,
            chunk,
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"),
            *[_MERGE[how](n).over(whole).alias(n) for n, (how, _) in totals.items()],
        )
    )
    row = F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(*order))
    return (
        df.withColumn("_row", row)
        .join(summary, [*keys, chunk])
        .withColumn(name, (F.col("_skip") + F.col("_row") + (start - 1)).cast("long"))
        .drop("_skip", "_row")
    )


def running(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of a key. ``chunk`` must rise with the order."""
    earlier = (Window.unboundedPreceding, -1)
    total = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(*earlier)
    total = total.select(*keys, chunk, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_skip"))
    inside = F.sum(value).over(Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(*earlier))
    rows = df.withColumn("_inside", inside).join(total, [*keys, chunk])
    return rows.withColumn(name, (F.coalesce("_inside", F.lit(0)) + F.col("_skip")).cast("long")).drop("_inside", "_skip")


def runs(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    flag: Column,
    measures: dict[str, tuple[str, Column]] | None = None,
    gap: int = 1,
) -> DataFrame:
    """Islands of flagged frames no more than ``gap`` apart.

    Returns keys, ``start_frame``, ``end_frame``, ``n_frames`` and one column per
    measure; a measure is (sum | count | min | max, column)."""
    size = CHUNK
    measures = measures or {}
    window = Window.partitionBy(*keys, "_chunk").orderBy(frame)
    opens = F.when(F.col(frame) - F.lag(frame).over(window) <= gap, 0).otherwise(1)
    pieces = (
        df.where(flag)
        .withColumn("_chunk", chunk_of(frame))
        .withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(window))
        .groupBy(*keys, "_chunk", "_run")
        .agg(
            F.min(frame).alias("start_frame"),
            F.max(frame).alias("end_frame"),
            F.count(F.lit(1)).alias("n_frames"),
            *[_START[how](col).alias(name) for name, (how, col) in measures.items()],
        )
    )
    # Pieces at a chunk edge (at most two per chunk) share one lane per key,
    # all others stay in the lane of their chunk.
    at_edge = (F.col("start_frame") - F.col("_chunk") * size < gap) | (
        (F.col("_chunk") + 1) * size - 1 - F.col("end_frame") < gap
    )
    lane = Window.partitionBy(*keys, "_lane").orderBy("start_frame")
    opens = F.when(F.col("start_frame") - F.lag("end_frame").over(lane) <= gap, 0).otherwise(1)
    return (
        pieces.withColumn("_lane", F.when(at_edge, F.lit(-1)).otherwise(F.col("_chunk")))
        .withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(lane))
        .groupBy(*keys, "_lane", "_run")
        .agg(
            F.min("start_frame").alias("start_frame"),
            F.max("end_frame").alias("end_frame"),
            F.sum("n_frames").alias("n_frames"),
            *[_MERGE[how](name).alias(name) for name, (how, _) in measures.items()],
        )
        .drop("_lane", "_run")
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
) -> DataFrame:
    """Pairs of rows with equal keys whose frame spans overlap. A span of one
    frame is a point. Each pair is compared in one bucket only."""

    def bucketed(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        first, last = (F.expr(f"`{c}` div {BUCKET}") for c in span)
        if span[0] == span[1]:
            return df.withColumn("_bucket", first)
        return df.where(F.col(span[1]) >= F.col(span[0])).withColumn(
            "_bucket", F.explode(F.sequence(first, last))
        )

    (l0, l1), (r0, r1) = left_span, right_span
    meets = bucketed(left, left_span).join(bucketed(right, right_span), [*keys, "_bucket"])
    return meets.where(
        (F.col(l0) <= F.col(r1))
        & (F.col(r0) <= F.col(l1))
        & (F.col("_bucket") == F.expr(f"greatest(`{l0}`, `{r0}`) div {BUCKET}"))
    ).drop("_bucket")


def spread_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "inner",
) -> DataFrame:
    """Join rows with a table that has one row per key. Rows of a hot key go to
    ``LANES`` partitions; the small side is repeated once per lane.

    Always a shuffled join: Spark sizes the small side before it is repeated, a
    stored table even by its packed files, and its broadcast filled the driver."""
    lanes = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))
    return (
        many.withColumn("_lane", F.pmod(F.hash(spread), F.lit(LANES)))
        .join(one.withColumn("_lane", lanes).hint("merge"), [*keys, "_lane"], how)
        .drop("_lane")
    )
