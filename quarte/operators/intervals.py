"""Movement intervals per phrase and side: pauses, lunges, arm extensions.

Input is a wide pose table keyed by (phrase_id, side, frame). Each operator is
islands of flagged frames with mergeable measures; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarte.functions import geometry as g
from quarte.operators.series import nearby, overlap_join, runs, spread_join
from quarte.params import ArmRules, LungeRules, PauseRules, Rules

SIDE = ["phrase_id", "side"]


def pop_variance(n: Column, s: Column, ss: Column) -> Column:
    return ss / n - (s / n) * (s / n)


def flat(rules_limit: float, n: str = "y_n", s: str = "y_sum", ss: str = "y_sq") -> Column:
    """True unless two or more heights vary too much."""
    wide = (F.col(n) > 1) & (pop_variance(F.col(n), F.col(s), F.col(ss)) >= rules_limit)
    return ~F.coalesce(wide, F.lit(False))


def _height_measures() -> dict:
    y = F.col("y16")
    return {"y_n": ("count", y), "y_sum": ("sum", y), "y_sq": ("sum", y * y)}


def foot_motion(df: DataFrame) -> DataFrame:
    """Front and back foot steps from frame 1 on; a missing end gives a zero step."""
    rows = df.select(*SIDE, "frame", "x15", "x16", "y16")

    def build(d, w):
        return d.withColumns(
            {
                "step": F.coalesce(F.col("x16") - F.lag("x16").over(w), F.lit(0.0)),
                "back_step": F.coalesce((F.col("x15") - F.lag("x15").over(w)) * g.forward(), F.lit(0.0)),
            }
        )

    return nearby(rows, SIDE, "frame", 1, 0, build).where(F.col("frame") >= 1)


def pauses(df: DataFrame, rules: PauseRules, fps: float) -> DataFrame:
    """Pause and retreat intervals: phrase_id, side, start_frame, end_frame, is_retreat.

    A run of slow or backward frames is a retreat when its mean speed is high;
    otherwise it is cut where the back foot advances and each piece must be long
    and level enough."""
    motion = foot_motion(df)
    speed = rules.per_frame(rules.speed, fps)
    slow = (F.abs("step") < speed) | (F.col("step") * g.forward() < 0)
    moving = runs(motion, SIDE, "frame", slow, {"path": ("sum", F.abs("step"))})
    moving = moving.where(F.col("n_frames") >= rules.min_frames).withColumn(
        "is_retreat", F.col("path") / F.col("n_frames") > rules.per_frame(rules.retreat, fps)
    )
    still = slow & (F.col("back_step") < rules.per_frame(rules.back_foot, fps))
    pieces = runs(motion, SIDE, "frame", still, _height_measures())
    pieces = pieces.where((F.col("n_frames") >= rules.min_frames) & flat(rules.y_variance))
    held = moving.where(~F.col("is_retreat")).select(
        *SIDE, F.col("start_frame").alias("run_start"), F.col("end_frame").alias("run_end")
    )
    kept = overlap_join(pieces, held, SIDE, ("start_frame", "end_frame"), ("run_start", "run_end"))
    out = [*SIDE, "start_frame", "end_frame", "is_retreat"]
    return moving.where("is_retreat").select(*out).unionByName(
        kept.withColumn("is_retreat", F.lit(False)).select(*out)
    )


def slow_starts(found: DataFrame, rules: Rules, fps: float) -> DataFrame:
    """Mark short opening pauses; they no longer count as pauses."""
    short = F.col("end_frame") - F.col("start_frame") + 1 < int(fps * rules.slow_start_seconds)
    return found.withColumn("is_slow_start", (F.col("start_frame") <= rules.slow_start_frame) & short)


def foot_gap() -> Column:
    return g.distance(g.joint(16), g.joint(15))


def lunge_cores(df: DataFrame, rules: LungeRules) -> DataFrame:
    cores = runs(df.select(*SIDE, "frame", foot_gap().alias("gap")), SIDE, "frame", F.col("gap") > rules.core)
    return cores.where(F.col("n_frames") >= rules.min_frames)


def expand_cores(df: DataFrame, rules: LungeRules) -> DataFrame:
    """Grow every core through its wider island while it fills more than half.

    Growing one frame left and one right in turn ends at a closed form: both arms
    whole when they fit into core length - 1, else shared as evenly as possible
    with the odd frame on the left."""
    cores = lunge_cores(df, rules).select(
        *SIDE, F.col("start_frame").alias("core_start"), F.col("end_frame").alias("core_end")
    )
    gaps = df.select(*SIDE, "frame", foot_gap().alias("gap"))
    wider = runs(gaps, SIDE, "frame", F.col("gap") > rules.expand).drop("n_frames")
    both = overlap_join(cores, wider, SIDE, ("core_start", "core_end"), ("start_frame", "end_frame"))
    left, right = F.col("core_start") - F.col("start_frame"), F.col("end_frame") - F.col("core_end")
    room = F.col("core_end") - F.col("core_start")
    half = F.ceil(room / 2)
    take_left = F.when(left + right <= room, left).otherwise(F.greatest(F.least(left, half), room - right))
    take_right = F.when(left + right <= room, right).otherwise(room - F.col("_left"))
    return (
        both.withColumn("_left", take_left.cast("int"))
        .withColumn("_right", take_right.cast("int"))
        .select(
            *SIDE,
            "core_start",
            "core_end",
            (F.col("core_start") - F.col("_left")).alias("start_frame"),
            (F.col("core_end") + F.col("_right")).alias("end_frame"),
        )
    )


def hits_in(intervals: DataFrame, hits: DataFrame, keys: list[str], grace: int) -> DataFrame:
    """Hit frames within [start, end + grace] of each interval, with first and last."""
    spans = intervals.withColumn("_reach", F.col("end_frame") + grace)
    found = overlap_join(spans, hits, SIDE, ("start_frame", "_reach"), ("hit_frame", "hit_frame"))
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_hits"), F.min("hit_frame").alias("first_hit"), F.max("hit_frame").alias("last_hit")
    )


def lunges(df: DataFrame, hits: DataFrame, rules: LungeRules, pause: PauseRules, fps: float) -> DataFrame:
    """Valid lunge intervals and whether they penalise.

    ``hits`` is (phrase_id, side, hit_frame)."""
    spans = expand_cores(df, rules)
    lunge = [*SIDE, "core_start"]
    still_speed = pause.per_frame(pause.speed, fps)
    backward = pause.per_frame(rules.backward, fps)

    def build(d, w):
        return d.withColumns(
            {
                "front_step": F.coalesce((F.col("x16") - F.lag("x16").over(w)) * g.forward(), F.lit(0.0)),
                "back_step": (F.col("x15") - F.lag("x15").over(w)) * g.forward(),
            }
        )

    angle = g.joint_angle_deg(g.joint(13), g.joint(11), g.joint(12))
    rows = df.select(*SIDE, "frame", "x15", "x16", "y16", foot_gap().alias("gap"), angle.alias("hip"))
    rows = nearby(rows, SIDE, "frame", 1, 0, build)
    inside = overlap_join(rows, spans, SIDE, ("frame", "frame"), ("start_frame", "end_frame"))
    later = F.col("frame") > F.col("start_frame")
    checks = inside.groupBy(*lunge, "core_end", "start_frame", "end_frame").agg(
        F.count_if(F.col("hip") > rules.hip_angle).alias("n_hip"),
        F.count_if(F.col("gap") > rules.far).alias("n_far"),
        F.count_if(later & (F.col("back_step") < -backward)).alias("n_back"),
    )
    still = later & ((F.abs("front_step") < still_speed) | (F.col("front_step") < 0))
    stops = runs(
        inside, lunge, "frame", still, {**_height_measures(), "lunge_end": ("max", F.col("end_frame"))}
    )
    late = (
        stops.where(
            (F.col("n_frames") >= rules.late_pause_frames)
            & (F.col("lunge_end") - F.col("end_frame") <= rules.late_pause_window)
            & flat(pause.y_variance)
        )
        .groupBy(*lunge)
        .agg(F.lit(True).alias("late_pause"))
    )
    struck = hits_in(spans, hits, lunge, rules.hit_grace)
    length = F.col("end_frame") - F.col("start_frame") + 1
    good = (
        F.col("n_hits").isNotNull()
        & F.col("late_pause").isNull()
        & (F.col("last_hit") - F.col("start_frame") < rules.late_hit_gap)
    )
    return (
        checks.where(
            ((F.col("n_hip") >= rules.hip_frames) | (F.col("n_far") >= rules.far_frames))
            & (F.col("n_back") / length <= rules.max_backward_share)
        )
        .join(struck, lunge, "left")
        .join(late, lunge, "left")
        .select(
            *lunge,
            "start_frame",
            "end_frame",
            F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
            (~F.coalesce(good, F.lit(False))).alias("is_penalizing"),
        )
    )


def arm_extensions(df: DataFrame, targets: DataFrame, rules: ArmRules) -> DataFrame:
    """Arm extension intervals with their harm flags.

    ``targets`` gives one hit_frame per (phrase_id, side)."""
    reach = F.when(F.col("y10").isNotNull() & F.col("y12").isNotNull(), F.abs(F.col("x10") - F.col("x12")))
    points = g.pose()
    rows = df.select(
        *SIDE,
        "frame",
        reach.alias("reach"),
        g.elbow_angles(points)["selected"].alias("elbow"),
        g.arm_body_angle(points).alias("body"),
    )
    found = runs(
        rows,
        SIDE,
        "frame",
        F.col("reach") >= rules.reach,
        {
            "reach_sum": ("sum", F.col("reach")),
            "elbow_sum": ("sum", F.col("elbow")),
            "elbow_n": ("count", F.col("elbow")),
            "max_body": ("max", F.when(F.col("elbow").isNotNull(), F.col("body"))),
            "effective_start": ("min", F.when(F.col("elbow") >= rules.straight_deg, F.col("frame"))),
        },
    )
    found = found.where((F.col("n_frames") >= rules.min_frames) & F.col("effective_start").isNotNull())
    gap = F.col("hit_frame") - F.col("end_frame")
    overlong, early = F.col("n_frames") > rules.overlong_frames, F.col("hit_gap") >= rules.early_end_gap
    return (
        spread_join(found, targets, SIDE, F.col("start_frame"))
        .withColumn("hit_gap", gap)
        .withColumns({"overlong": overlong, "early_end": early, "near_hit": F.col("hit_gap") <= rules.max_hit_gap})
        .where(~(F.col("overlong") | F.col("early_end")) | F.coalesce(F.col("max_body") >= rules.body_angle_deg, F.lit(False)))
        .select(
            *SIDE,
            "start_frame",
            "end_frame",
            "n_frames",
            (F.col("reach_sum") / F.col("n_frames")).alias("avg_reach"),
            (F.col("elbow_sum") / F.col("elbow_n")).alias("avg_elbow"),
            "max_body",
            "effective_start",
            "near_hit",
            "overlong",
            "early_end",
        )
    )
