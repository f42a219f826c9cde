"""Blade contacts: features around a contact frame, classifiers and simple rules.

``contacts`` has one row per phrase: phrase_id, event_frame and n (frames in the
phrase). Rows are cut to the few frames around the contact before anything is
shuffled by phrase, so every window below is over a handful of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarte.functions import geometry as g
from quarte.operators.motion import fill_all, gradient
from quarte.operators.series import spread_join
from quarte.params import ContactRules
from quarte.session import stage

SIDE = ["phrase_id", "side"]


def around(df: DataFrame, contacts: DataFrame, before: int, after: int) -> DataFrame:
    """Rows within [event - before, event + after], with event_frame and n.

    The frames wanted are a stored table of (phrase, frame) keys, so Spark knows its size: a small one is sent to the scan,
    and of a large one a filter over its keys is sent ahead of the join. Either way what is shuffled follows the contacts."""
    event = F.col("event_frame").cast(df.schema["frame"].dataType)
    frames = F.sequence(F.greatest(event - before, F.lit(0)), event + after)
    wanted = contacts.where("event_frame IS NOT NULL").select("phrase_id", "event_frame", "n", F.explode(frames).alias("frame"))
    return df.join(stage(wanted), ["phrase_id", "frame"])


def contact_motion(df: DataFrame, contacts: DataFrame, fps: float) -> DataFrame:
    """Wrist and torso motion per frame near the contact. One frame beyond the
    widest mean is kept so that inner gradients are central differences."""
    points = g.pose()
    wrist, torso = g.front_wrist(points), g.torso_center_axis(points)
    body = F.abs(g.mean_present([points[15][1], points[16][1]]) - g.mean_present([points[5][1], points[6][1]]))
    rows = around(df, contacts, 10, 10).select(
        *SIDE,
        "frame",
        "event_frame",
        "n",
        wrist[0].alias("wx"),
        wrist[1].alias("wy"),
        torso[0].alias("tx"),
        torso[1].alias("ty"),
        body.alias("body"),
    )
    w = Window.partitionBy(*SIDE).orderBy("frame")
    slopes = rows.withColumns({f"v{c}": gradient(c, "frame", w, 1.0 / fps) for c in ("wx", "wy", "tx", "ty")})
    speed = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    return slopes.withColumns(
        {
            "ahead": g.forward() * (F.col("wx") - F.col("tx")) / (F.col("body") + 1e-6),
            "torso_fwd": g.forward() * F.col("vtx"),
            "wrist_fwd": g.forward() * F.col("vwx"),
            "wrist_speed": speed("vwx", "vwy"),
            "wrist_ratio": speed("vwx", "vwy") / (speed("vtx", "vty") + 1e-6),
        }
    )


def _mean_near(side: str, value: str, center: Column, lo: int, hi: int) -> Column:
    gap = F.col("frame") - center
    return F.avg(F.when((F.col("side") == side) & (gap >= lo) & (gap <= hi), F.col(value)))


BENEFIT = ("ahead_pre", "ahead_evt", "ahead_post", "torso_evt", "torso_pre", "wrist_speed_evt", "wrist_ratio_evt", "wrist_fwd_evt")


def contact_features(motion: DataFrame) -> DataFrame:
    """One row per phrase: accident features and benefit features of both sides."""
    event = F.col("event_frame")
    pre = F.greatest(F.lit(0), event - 4)
    post = F.least(F.col("n") - 1, event + 4)
    aggs = {}
    for s in ("left", "right"):
        aggs |= {
            f"{s}_fwd_pre": _mean_near(s, "wrist_fwd", event, -8, -4),
            f"{s}_speed_post": _mean_near(s, "wrist_speed", event, 2, 6),
            f"{s}_ahead_pre": _mean_near(s, "ahead", pre, -2, 2),
            f"{s}_ahead_evt": _mean_near(s, "ahead", event, -1, 1),
            f"{s}_ahead_post": _mean_near(s, "ahead", post, -2, 2),
            f"{s}_torso_evt": _mean_near(s, "torso_fwd", event, -1, 1),
            f"{s}_torso_pre": _mean_near(s, "torso_fwd", pre, -2, 2),
            f"{s}_wrist_speed_evt": _mean_near(s, "wrist_speed", event, -1, 1),
            f"{s}_wrist_ratio_evt": _mean_near(s, "wrist_ratio", event, -1, 1),
            f"{s}_wrist_fwd_evt": _mean_near(s, "wrist_fwd", event, -1, 1),
        }
    wide = motion.groupBy("phrase_id").agg(F.max("event_frame").alias("event_frame"), *[c.alias(n) for n, c in aggs.items()])
    out = {f"delta_{f}": F.col(f"left_{f}") - F.col(f"right_{f}") for f in BENEFIT}
    # least and greatest skip missing sides, as wanted here.
    out["min_fwd_pre"] = F.least("left_fwd_pre", "right_fwd_pre")
    out["max_speed_post"] = F.greatest("left_speed_post", "right_speed_post")
    return wide.withColumns(out)


def accident(rules: ContactRules) -> dict[str, Column]:
    """Accident call from the features; a missing speed counts as the threshold."""
    wrist = F.col("min_fwd_pre") - rules.wrist_forward
    post = F.coalesce("max_speed_post", F.lit(rules.wrist_speed)) - rules.wrist_speed
    called = F.coalesce((wrist >= 0) & (post >= 0), F.lit(False))
    margin = F.least(wrist, post / 100.0)
    return {
        "is_accident": called,
        "accident_confidence": F.when(called & (margin >= 2.0), "high").when(called, "medium").otherwise("low"),
        "wrist_margin": wrist,
        "speed_margin": post,
    }


def benefit(rules: ContactRules) -> dict[str, Column]:
    """Side that profits from the contact: positive score is left."""
    evt, pre, post = (F.col(f"delta_ahead_{p}") for p in ("evt", "pre", "post"))
    has_evt, has_pre, has_post = evt.isNotNull(), pre.isNotNull(), post.isNotNull()
    method = (
        F.when(has_evt & has_pre & has_post, "ahead_evt_pre_post_score")
        .when(has_evt & has_pre, "ahead_evt_pre_legacy_fallback")
        .when(has_evt & has_post, "ahead_evt_post_score")
        .when(has_evt, "ahead_evt_only_nan_pre")
        .when(has_pre, "ahead_pre_only_nan_evt")
        .when(has_post, "ahead_post_only_nan_evt")
        .otherwise("torso_fallback_nan_ahead")
    )
    zero = F.lit(0.0)
    legacy = has_pre & ~has_post
    pre_weight = F.when(legacy, rules.legacy_pre_weight).when(has_evt, rules.pre_weight).otherwise(zero)
    # Only the pre value present, or pre with a later value but no event value.
    pre_weight = F.when(~has_evt & has_pre, rules.legacy_pre_weight).otherwise(pre_weight)
    post_weight = F.when(has_evt | ~has_pre, rules.post_weight).otherwise(zero)
    limit = F.when((has_evt & legacy) | (~has_evt & has_pre), rules.legacy_threshold).otherwise(rules.threshold)
    combined = F.coalesce(evt, zero) + pre_weight * F.coalesce(pre, zero) + post_weight * F.coalesce(post, zero)
    score = F.when(has_evt | has_pre | has_post, limit - combined)
    torso = F.when(F.coalesce(F.col("delta_torso_evt") < 0, F.lit(False)), "left").otherwise("right")
    size = F.abs(score)
    return {
        "benefit_method": method,
        "benefit_score": score,
        "benefit_side": F.when(score.isNull(), torso).when(score > 0, "left").otherwise("right"),
        "benefit_confidence": F.when(size >= rules.high_margin, "high").when(size >= rules.margin, "medium").otherwise("low"),
        "prob_left": F.coalesce(1.0 / (1.0 + F.exp(-score / max(rules.scale, 1e-6))), F.lit(0.5)),
    }


def judge_contacts(df: DataFrame, contacts: DataFrame, rules: ContactRules, fps: float) -> DataFrame:
    """Accident and benefit calls per phrase from poses in pixels."""
    rows = contact_features(contact_motion(df, contacts, fps))
    return rows.withColumns(accident(rules)).withColumns(benefit(rules))


# Trainer windows at its base rate.
BASE_FPS, BASELINE, LAG, MOMENTUM = 15.0, 5, 2, 6
SERIES = {"front": "x16", "back": "x15", "front_knee": "x14", "front_wrist": "x10", "com": "com", "height": "y16"}


def fencer_features(df: DataFrame, contacts: DataFrame, fps: float = BASE_FPS) -> DataFrame:
    """Position, progress and velocity features per phrase and side at the contact."""
    d = g.forward()
    need = ["x5", "x6", "x11", "x12", "x10", "x14", "x15", "x16", "y16"]
    filled = fill_all(df.select(*SIDE, "frame", *need), SIDE, "frame", need)
    filled = filled.withColumn("com", reduce(lambda a, b: a + b, [F.col(f"x{k}") for k in g.TORSO]) / 4)
    rows = spread_join(filled, contacts.select("phrase_id", "event_frame", "n"), ["phrase_id"], F.col("frame"))
    idx = F.greatest(F.lit(0), F.least(F.col("event_frame"), F.col("n") - 1))
    rows = rows.withColumn("idx", idx).where(F.col("frame") <= F.col("idx"))
    prev = F.greatest(F.lit(0), F.col("idx") - LAG)
    base_end = F.greatest(F.lit(1), F.least(F.col("idx"), F.lit(BASELINE)))
    picks = {}
    for name, c in SERIES.items():
        picks |= {
            f"{name}_now": F.max(F.when(F.col("frame") == F.col("idx"), F.col(c))),
            f"{name}_prev": F.max(F.when(F.col("frame") == prev, F.col(c))),
            f"{name}_base": F.avg(F.when(F.col("frame") < base_end, F.col(c))),
        }
    at = rows.groupBy(*SIDE).agg(F.max("idx").alias("idx"), *[c.alias(n) for n, c in picks.items()])
    near = rows.where(F.col("frame") >= F.col("idx") - MOMENTUM)
    w = Window.partitionBy(*SIDE).orderBy("frame")
    steps = near.select(*SIDE, (d * (F.col("x16") - F.lag("x16").over(w))).alias("step"))
    momentum = steps.groupBy(*SIDE).agg(
        F.coalesce(F.avg("step") * fps, F.lit(0.0)).alias("front_velocity_mean_window"),
        F.coalesce(F.max("step") * fps, F.lit(0.0)).alias("front_velocity_peak_window"),
    )
    lag = F.greatest(F.lit(1), F.col("idx") - F.greatest(F.lit(0), F.col("idx") - LAG))
    col = F.col
    feats = {}
    for name in ("front", "back", "front_knee", "front_wrist", "com"):
        feats[f"{name}_progress"] = d * (col(f"{name}_now") - col(f"{name}_base"))
        feats[f"{name}_velocity"] = d * (col(f"{name}_now") - col(f"{name}_prev")) * fps / lag
    feats["stance_now"] = col("front_now") - col("back_now")
    feats["stance_progress"] = d * (col("front_now") - col("back_now") - (col("front_base") - col("back_base")))
    feats["front_height_change"] = col("height_base") - col("height_now")
    feats["weapon_lead"] = d * (col("front_wrist_now") - col("front_now"))
    feats["weapon_lead_progress"] = d * (
        col("front_wrist_now") - col("front_now") - (col("front_wrist_base") - col("front_base"))
    )
    feats["weapon_vs_com"] = d * (col("front_wrist_now") - col("com_now"))
    at = at.withColumns(feats)
    started = col("front_progress") > 0
    limit = F.when(started, F.greatest(F.lit(0.02), 0.2 * col("front_progress"))).otherwise(F.lit(0.05))
    marks = at.select(*SIDE, "front_base", limit.alias("limit"))
    onset = (
        spread_join(rows.select(*SIDE, "frame", "x16"), marks, SIDE, F.col("frame"))
        .where(d * (col("x16") - col("front_base")) >= col("limit"))
        .groupBy(*SIDE)
        .agg(F.min("frame").alias("onset"))
    )
    out = at.join(momentum, SIDE).join(onset, SIDE, "left")
    out = out.withColumn("attack_start_frame", F.coalesce("onset", "idx"))
    since = F.greatest(F.lit(1), col("idx") - col("attack_start_frame"))
    return out.withColumns(
        {"attack_lead_time": since / fps, "attack_progress_rate": col("front_progress") / since}
    ).select(*SIDE, *FEATURES)


FEATURES = (
    [f"{n}_{p}" for n in ("front", "back", "front_knee", "front_wrist") for p in ("now", "progress", "velocity")]
    + ["stance_now", "stance_progress", "com_progress", "com_velocity", "front_height_change"]
    + ["weapon_lead", "weapon_lead_progress", "weapon_vs_com"]
    + ["attack_start_frame", "attack_lead_time", "attack_progress_rate"]
    + ["front_velocity_mean_window", "front_velocity_peak_window"]
)
# Features compared between the sides.
DELTAS = (
    "front_progress", "front_velocity", "front_velocity_mean_window", "front_velocity_peak_window",
    "front_wrist_progress", "front_knee_progress", "front_height_change", "weapon_lead", "weapon_lead_progress",
    "weapon_vs_com", "stance_progress", "com_progress", "attack_lead_time", "attack_progress_rate",
)


def side_pair(features: DataFrame, cols=FEATURES) -> DataFrame:
    """Left and right features of a phrase in one row, only phrases with both."""
    picks = [
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("left", "right") for c in cols
    ]
    both = features.groupBy("phrase_id").agg(F.count("side").alias("_sides"), *picks)
    return both.where("_sides = 2").drop("_sides")


def feature_deltas(pair: DataFrame) -> DataFrame:
    l, r = (lambda c: F.col(f"left_{c}")), (lambda c: F.col(f"right_{c}"))
    out = {
        "front_gap": r("front_now") - l("front_now"),
        "front_gap_change": r("front_progress") - l("front_progress"),
        "front_velocity_gap": r("front_velocity") - l("front_velocity"),
        "stance_gap": r("stance_now") - l("stance_now"),
    }
    return pair.withColumns(out | {f"delta_{c}": l(c) - r(c) for c in DELTAS})


def _duel(weights: dict[str, float], tie: str | None) -> Column:
    """Side with the larger weighted score; near ties add a second feature."""
    score = {
        s: reduce(lambda a, b: a + b, [w * F.col(f"{s}_{c}") for c, w in weights.items()]) for s in ("left", "right")
    }
    gap = score["left"] - score["right"]
    if tie:
        close = F.abs(gap) < 1e-3
        gap = F.when(close, gap + 0.2 * (F.col(f"left_{tie}") - F.col(f"right_{tie}"))).otherwise(gap)
    return F.when(gap > 0, "left").otherwise("right")


def rule_velocity() -> Column:
    return _duel({"front_velocity": 1.0, "front_progress": 0.6, "com_velocity": 0.3}, "stance_progress")


def rule_pressure() -> Column:
    weights = {"front_progress": 0.7, "front_wrist_progress": 0.3, "stance_progress": 0.4, "front_knee_progress": 0.2}
    return _duel(weights, "com_progress")


def rule_priority() -> Column:
    l, r = (lambda c: F.col(f"left_{c}")), (lambda c: F.col(f"right_{c}"))
    start = F.when(l("attack_start_frame") < r("attack_start_frame"), "left").when(
        l("attack_start_frame") > r("attack_start_frame"), "right"
    )
    gap = l("attack_progress_rate") - r("attack_progress_rate")
    rate = F.when(F.abs(gap) > 1e-3, F.when(gap > 0, "left").otherwise("right"))
    last = F.when(l("front_progress") >= r("front_progress"), "left").otherwise("right")
    return F.coalesce(start, rate, last)


# Rules are plain expressions over paired features and may be extended.
RULES: dict[str, Callable[[], Column]] = {
    "velocity": rule_velocity,
    "pressure": rule_pressure,
    "priority": rule_priority,
}
