"""Phrase facts that go with the adapter poses: length, hits and contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarte.params import ArmRules, ContactRules, LungeRules, PauseRules, Rules
from quarte.sources.adapters import PHRASE, table

FPS = 30.0
# The adapter poses jump far more from frame to frame than a fencer does, so the
# adapter queries run the same rules with thresholds that fit them.
RULES = Rules(
    pause=PauseRules(speed=0.5, retreat=0.34, back_foot=0.5, y_variance=0.05, min_frames=2),
    lunge=LungeRules(
        core=0.45, expand=0.35, min_frames=2, hip_angle=100.0, far=0.6, backward=0.5, max_backward_share=0.5,
        late_pause_frames=2,
    ),
    arm=ArmRules(reach=0.25, straight_deg=140.0, body_angle_deg=40.0, overlong_frames=3),
    contact=ContactRules(wrist_forward=-2000.0, wrist_speed=1500.0),
    overlap_share=0.2,
)
BASE_RULES = PauseRules(speed=0.25, retreat=0.17, back_foot=0.25, y_variance=0.05, min_frames=2, scaled=False)


def info(spark: SparkSession, sf: str) -> DataFrame:
    """One row per phrase: length, hit frames, contact frames and lockout frame."""
    p = F.col("phrase_id")
    return (
        table(spark, sf, "embeddings")
        .groupBy(F.expr(PHRASE).alias("phrase_id"))
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
        .withColumn("late", F.expr("int(n * 4 div 5)"))
        .select(
            "phrase_id",
            "n",
            (F.col("late") - p % 3).cast("int").alias("left_hit"),
            (F.col("late") - p % 4).cast("int").alias("right_hit"),
            F.expr("int(n * 3 div 10)").alias("contact_1"),
            F.when(p % 4 != 3, F.col("late") - 6 - p % 3).cast("int").alias("contact_2"),
            F.when(p % 5 == 0, F.col("late") - 7).alias("lockout"),
        )
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """(phrase_id, side, hit_frame)."""
    return info(spark, sf).selectExpr(
        "phrase_id", "inline(array(named_struct('side', 'left', 'hit_frame', left_hit), "
        "named_struct('side', 'right', 'hit_frame', right_hit)))"
    )


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """(phrase_id, line_no, frame, time_s) of blade contacts in log order."""
    both = "inline(array(named_struct('line_no', 1, 'frame', contact_1), named_struct('line_no', 2, 'frame', contact_2)))"
    rows = info(spark, sf).selectExpr("phrase_id", both).where("frame IS NOT NULL")
    return rows.withColumn("time_s", F.col("frame") / FPS)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Phrase facts for the decisions: frames, hits, earliest hit time, lockout in seconds."""
    return info(spark, sf).select(
        "phrase_id",
        "n",
        "left_hit",
        "right_hit",
        (F.least("left_hit", "right_hit") / FPS).alias("hit_time"),
        (F.col("lockout") / FPS).alias("lockout"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """One contact frame per phrase: phrase_id, event_frame, n."""
    return info(spark, sf).select("phrase_id", F.coalesce("contact_2", "contact_1").alias("event_frame"), "n")


def attack_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Attack window per phrase and side: from a quarter of the phrase to the hit."""
    rows = info(spark, sf).select("phrase_id", F.expr("int(n div 4)").alias("w_start"))
    return hits(spark, sf).withColumnRenamed("hit_frame", "w_end").join(rows, "phrase_id")
