"""Per-frame motion of long series: steps, gradients, means and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarte.operators.series import carry, chunk_of, nearby, spread_join


def step(col: str, window) -> Column:
    return F.col(col) - F.lag(col).over(window)


def gradient(col: str, frame: str, window, dt: float) -> Column:
    """Central difference inside, one-sided at the ends; missing values spread."""
    prev, nxt, here = F.lag(col).over(window), F.lead(col).over(window), F.col(col)
    first, last = F.lag(frame).over(window).isNull(), F.lead(frame).over(window).isNull()
    return (
        F.when(first & last, F.lit(None))
        .when(first, (nxt - here) / dt)
        .when(last, (here - prev) / dt)
        .otherwise((nxt - prev) / (2 * dt))
    )


def with_gradients(df: DataFrame, keys: Sequence[str], frame: str, cols: dict[str, str], dt: float) -> DataFrame:
    return nearby(
        df, keys, frame, 1, 1, lambda rows, w: rows.withColumns({n: gradient(c, frame, w, dt) for n, c in cols.items()})
    )


def window_means(df, keys, frame, spans: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Mean of present values in [f+a, f+b]; spans is {name: (column, a, b)}."""
    before = max([0, *(-a for _, a, _ in spans.values())])
    after = max([0, *(b for _, _, b in spans.values())])
    return nearby(
        df,
        keys,
        frame,
        before,
        after,
        lambda rows, w: rows.withColumns(
            {n: F.avg(c).over(w.rowsBetween(a, b)) for n, (c, a, b) in spans.items()}
        ),
    )


def _present_neighbours(df: DataFrame, keys, frame: str, cols: Sequence[str]) -> DataFrame:
    """Add _before_<c> and _after_<c>: (f, v) of the nearest present value."""
    here = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(c).alias("v"))) for c in cols}
    rows = df.withColumn("_series_chunk", chunk_of(frame))
    return carry(
        rows,
        keys,
        "_series_chunk",
        [frame],
        last={f"_before_{c}": s for c, s in here.items()},
        first={f"_after_{c}": s for c, s in here.items()},
    ).drop("_series_chunk")


def _between(c: str, frame: str) -> Column:
    b, a = F.col(f"_before_{c}"), F.col(f"_after_{c}")
    return b["v"] + (a["v"] - b["v"]) * (F.col(frame) - b["f"]) / (a["f"] - b["f"])


def interpolate_gaps(df: DataFrame, keys, frame: str, cols: Sequence[str], max_gap: int) -> DataFrame:
    """Fill inner gaps linearly, at most the first ``max_gap`` frames of each."""
    rows = _present_neighbours(df, keys, frame, cols)
    out = {}
    for c in cols:
        near = F.col(frame) - F.col(f"_before_{c}")["f"] <= max_gap
        out[c] = F.coalesce(F.col(c), F.when(near, _between(c, frame)))
    return rows.withColumns(out).drop(*[f"_{s}_{c}" for c in cols for s in ("before", "after")])


def fill_all(df: DataFrame, keys, frame: str, cols: Sequence[str], empty: float | None = 0.0) -> DataFrame:
    """Linear inside, nearest value at the edges, ``empty`` for series without a value."""
    rows = _present_neighbours(df, keys, frame, cols)
    out = {
        c: F.coalesce(
            F.col(c), _between(c, frame), F.col(f"_before_{c}")["v"], F.col(f"_after_{c}")["v"], F.lit(empty)
        )
        for c in cols
    }
    return rows.withColumns(out).drop(*[f"_{s}_{c}" for c in cols for s in ("before", "after")])


def fill_edges(df: DataFrame, keys, frame: str, cols: Sequence[str]) -> DataFrame:
    """As ``fill_all``, but a series with a single value gets 0 elsewhere and an
    empty series stays empty."""
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"_n_{c}") for c in cols])
    rows = _present_neighbours(df, keys, frame, cols)
    rows = spread_join(rows, counts, keys, F.col(frame))
    out = {}
    for c in cols:
        filled = F.coalesce(_between(c, frame), F.col(f"_before_{c}")["v"], F.col(f"_after_{c}")["v"])
        out[c] = F.coalesce(
            F.col(c), F.when(F.col(f"_n_{c}") == 1, F.lit(0.0)).when(F.col(f"_n_{c}") > 1, filled)
        )
    drop = [f"_{s}_{c}" for c in cols for s in ("before", "after", "n")]
    return rows.withColumns(out).drop(*drop)


def steps_between_present(df: DataFrame, keys, frame: str, steps: dict[str, tuple[tuple[str, ...], Column]]) -> DataFrame:
    """Distance to the previous present position, skipping gaps, and its change.

    ``steps`` is {name: (columns, present)}; adds <name> (step length, NULL
    without a predecessor) and <name>_change (absolute change from the previous
    step)."""
    here = {n: F.when(ok, F.struct(*[F.col(c) for c in cols])) for n, (cols, ok) in steps.items()}
    rows = df.withColumn("_series_chunk", chunk_of(frame))
    rows = carry(rows, keys, "_series_chunk", [frame], last={f"_p_{n}": s for n, s in here.items()}, strict=True)
    lengths = {}
    for n, (cols, ok) in steps.items():
        prev = F.col(f"_p_{n}")
        gap = sum(((F.col(c) - prev[c]) * (F.col(c) - prev[c]) for c in cols[1:]), (F.col(cols[0]) - prev[cols[0]]) * (F.col(cols[0]) - prev[cols[0]]))
        lengths[n] = F.when(ok, F.sqrt(gap))
    rows = rows.withColumns(lengths).drop(*[f"_p_{n}" for n in steps])
    rows = carry(rows, keys, "_series_chunk", [frame], last={f"_q_{n}": F.col(n) for n in steps}, strict=True)
    return rows.withColumns({f"{n}_change": F.abs(F.col(n) - F.col(f"_q_{n}")) for n in steps}).drop(
        "_series_chunk", *[f"_q_{n}" for n in steps]
    )


def mean_speed_base(df: DataFrame) -> DataFrame:
    """Mean step of the front foot and mean absolute change of it, gaps skipped;
    both are 0 for a phrase of fewer than three frames."""
    keys = ["phrase_id", "side"]
    present = F.col("x16").isNotNull() & F.col("y16").isNotNull()
    rows = steps_between_present(
        df.select(*keys, "frame", "x16", "y16"), keys, "frame", {"foot": (("x16", "y16"), present)}
    )
    long_enough = F.max("frame") >= 2
    return rows.groupBy(*keys).agg(
        F.when(long_enough, F.coalesce(F.avg("foot"), F.lit(0.0))).otherwise(0.0).alias("speed"),
        F.when(long_enough, F.coalesce(F.avg("foot_change"), F.lit(0.0))).otherwise(0.0).alias("change"),
    )


def mean_speed(df: DataFrame) -> DataFrame:
    """Mean absolute x step of the front foot followed by the torso centre, and
    mean absolute change over the joined list of steps."""
    keys = ["phrase_id", "side"]
    from quarte.functions import geometry as g

    rows = df.select(*keys, "frame", "x16", g.torso_center_joint(g.pose())[0].alias("torso"))
    rows = steps_between_present(
        rows,
        keys,
        "frame",
        {"foot": (("x16",), F.col("x16").isNotNull()), "body": (("torso",), F.col("torso").isNotNull())},
    )
    n = F.count("foot") + F.count("body")
    seam = F.abs(
        F.min_by("body", F.when(F.col("body").isNotNull(), F.col("frame")))
        - F.max_by("foot", F.when(F.col("foot").isNotNull(), F.col("frame")))
    )
    changes = F.count("foot_change") + F.count("body_change") + F.when(seam.isNotNull(), 1).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.coalesce((total("foot") + total("body")) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("speed"),
        F.coalesce(
            (total("foot_change") + total("body_change") + F.coalesce(seam, F.lit(0.0))) / F.nullif(changes, F.lit(0)),
            F.lit(0.0),
        ).alias("change"),
    )
