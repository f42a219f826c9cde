"""Adapter tables: phrase data derived from the generic driver tables.

Poses come from ``embeddings``, signals and logs from ``events``, long series
from ``lineitem``. Every adapter is a distributed expression over the whole
table; row numbers come from per-chunk counts, so no key is ever sorted in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarte.functions.geometry import JOINTS
from quarte.operators.series import number

# Pixels per normalised unit in the adapter data, and the frame size they fit.
PIXELS = 400.0
FRAME_W, FRAME_H = 1200, 1200
HOUR_MS = 3_600_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds of a zoneless timestamp read as UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _coord(k: int, axis: int) -> str:
    left, right = 2 * k + axis, 2 * k + 30 + axis
    raw = f"CASE WHEN side = 'left' THEN embedding[{left}] ELSE embedding[{right}] END"
    return (
        f"CASE WHEN (vec_id * 17 + {k}) % 11 <> 0 THEN round(double({raw}) * 2 + 1.5D, 6) END AS {'xy'[axis]}{k}"
    )


#: Vectors whose ids lie together that a phrase is taken from; bounds the length of a phrase, so phrases grow in number.
TOGETHER = 500
PHRASE = f"(vec_id div {TOGETHER}) * 10 + label"


def pose_frames(spark: SparkSession, sf: str) -> DataFrame:
    """(phrase_id, frame, vec_id, embedding): a phrase is a label in one stretch of ids, frame is the rank of vec_id."""
    base = table(spark, sf, "embeddings").select(F.expr(PHRASE).alias("phrase_id"), "vec_id", "embedding")
    rank = F.row_number().over(Window.partitionBy("phrase_id").orderBy("vec_id")) - 1
    return base.withColumn("frame", rank.cast("int"))


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """Wide poses: one row per phrase, side and frame with 17 joints."""
    sided = pose_frames(spark, sf).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    return sided.selectExpr("phrase_id", "side", "frame", *[_coord(k, axis) for k in JOINTS for axis in (0, 1)])


def long_poses(wide: DataFrame, keys=("phrase_id", "side", "frame")) -> DataFrame:
    """One row per joint: keys, kp, x, y."""
    joints = ", ".join(f"named_struct('kp', {k}, 'x', x{k}, 'y', y{k})" for k in JOINTS)
    return wide.selectExpr(*keys, f"inline(array({joints}))")


def pixel_poses(spark: SparkSession, sf: str) -> DataFrame:
    cols = [f"{a}{k} * {PIXELS!r}D AS {a}{k}" for k in JOINTS for a in "xy"]
    return poses(spark, sf).selectExpr("phrase_id", "side", "frame", *cols)


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Three candidate skeletons per frame, in pixels; missing joints are 0."""
    cols = [f"coalesce({a}{k}, 0D) AS {a}{k}" for k in JOINTS for a in "xy"]
    return (
        pixel_poses(spark, sf)
        .where("side = 'left'")
        .selectExpr("phrase_id", "int(frame div 3) AS frame", "int(frame % 3) AS det_idx", *cols)
    )


def fight() -> Column:
    """Fight digit carried by an event type."""
    return (
        F.when(F.col("event_type") == "click", 3)
        .when(F.col("event_type") == "purchase", 8)
        .when(F.col("event_type") == "signup", 9)
        .when(F.col("event_type") == "error", 5)
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("match_id"),
        "user_id",
        F.col("event_id").alias("idx"),
        millis("ts").alias("signal_ts"),
        fight().cast("long").alias("fight"),
        F.when(F.col("event_type") == "view", "light").otherwise("hit").alias("source"),
        "value",
        "props",
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Video frame stamps per user."""
    views = (
        table(spark, sf, "events")
        .where(F.col("event_type") == "view")
        .select("user_id", "event_id", "ts", millis("ts").alias("ms"))
        .withColumn("_hour", F.expr(f"ms div {HOUR_MS}"))
    )
    out = number(views, ["user_id"], "_hour", ["ts", "event_id"])
    return out.select("user_id", F.col("frame").cast("int").alias("frame"), F.col("ms").alias("ts"))


def phrase_log(spark: SparkSession, sf: str) -> DataFrame:
    """(phrase_id, line_no, ms, t, line): one text log per user."""
    events = (
        table(spark, sf, "events")
        .select(F.col("user_id").alias("phrase_id"), "event_id", "event_type", "ts", millis("ts").alias("ms"))
        .withColumn("_hour", F.expr(f"ms div {HOUR_MS}"))
    )
    rows = number(
        events, ["phrase_id"], "_hour", ["ts", "event_id"], "line_no", {"t0": ("min", F.col("ms"))}, start=1
    ).withColumn("t", (F.col("ms") - F.col("t0")) / 1000.0)
    i, kind = F.col("event_id"), F.col("event_type")

    def timed(text) -> Column:
        return F.concat(F.format_string("%7.3fs | ", F.col("t")), text if isinstance(text, Column) else F.lit(text))

    tag = F.when(i % 4 == 0, " [left beat]").when(i % 4 == 1, " [Right_Defend]").when(i % 4 == 2, " [accident]")
    line = (
        F.when(
            i % 13 == 0,
            F.concat(
                F.lit("Tracking indices -> fencer 1: "), (i % 4).cast("string"),
                F.lit(", fencer 2: "), (i % 3).cast("string"),
            ),
        )
        .when(kind == "click", timed(F.concat(F.lit("Off-Target: Blade-to-blade contact."), F.coalesce(tag, F.lit("")))))
        .when((kind == "purchase") & (i % 7 == 0), timed("HIT: Simultaneous valid hits!"))
        .when(kind == "purchase", timed("HIT: Left scores on Right!"))
        .when((kind == "signup") & (i % 11 == 0), timed("Phrase recording ended"))
        .when(kind == "signup", timed("HIT: Right scores on Left!"))
        .when(kind == "error", timed("Lockout period started (0.200s window)"))
        .when(i % 5 == 0, "Scores -> Fencer 1: HIT, Fencer 2: HIT")
        .when(i % 5 == 1, "Scores -> Fencer 1: HIT, Fencer 2: MISS")
        .when(i % 5 == 2, "Confirmed result winner: Right Fencer (Green Lamp)")
        .when(i % 5 == 3, "Manual selection winner: Left")
        .otherwise(timed("Phrase recording started"))
    )
    return rows.select("phrase_id", F.col("line_no").cast("int").alias("line_no"), "ms", "t", line.alias("line"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Long series, one per supplier: (series_id, frame, x, y)."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_discount",
        F.unix_date(F.col("l_shipdate").cast("date")).alias("_day"),
    )
    out = number(lines, ["series_id"], "_day", ["l_shipdate", "l_orderkey", "l_linenumber"])
    return out.select(
        "series_id",
        F.col("frame").cast("int").alias("frame"),
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_quantity") / 50.0).alias("x"),
        (F.col("l_discount") * 10).alias("y"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("doc_id") % 3
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.col("toxic").cast("long").alias("predicted"),
        F.col("quality").cast("long").alias("label"),
        F.when(m == 0, "high").when(m == 1, "medium").otherwise("low").alias("confidence"),
    )


def bench_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        F.col("l_orderkey").alias("phrase"),
        F.col("l_quantity").alias("frames"),
        (F.col("l_extendedprice") / 1000.0).alias("seconds"),
        F.col("l_linenumber").cast("long").alias("n"),
    )


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    suffix = (
        F.when(d % 4 == 0, ".avi").when(d % 4 == 1, "_corrected.mp4").when(d % 4 == 2, "_overlay.mp4").otherwise(".json")
    )
    phrase = F.expr("doc_id div 4")
    return (
        table(spark, sf, "documents")
        .where(d % 7 != 0)
        .select(
            phrase.alias("phrase_id"),
            F.concat(F.lit("p"), phrase.cast("string"), suffix).alias("name"),
            F.col("n_chars").alias("length"),
        )
    )
