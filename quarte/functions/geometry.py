"""Joint geometry as Column expressions.

A pose row is (phrase_id, side, frame, x0..x16, y0..y16) in COCO joint order;
a missing joint is NULL on both axes. Flat columns let Catalyst prune the
joints a query does not use.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINTS = range(17)

# COCO joint indexes used by the rules.
NOSE, L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW = 0, 5, 6, 7, 8
L_WRIST, R_WRIST, L_HIP, R_HIP, L_KNEE, R_KNEE, BACK_FOOT, FRONT_FOOT = 9, 10, 11, 12, 13, 14, 15, 16
TORSO = (5, 6, 11, 12)

# Descriptor features as (name, joints).
ANGLES = {
    "left_elbow_angle": (5, 7, 9),
    "right_elbow_angle": (6, 8, 10),
    "left_shoulder_angle": (7, 5, 11),
    "right_shoulder_angle": (8, 6, 12),
    "left_hip_angle": (5, 11, 13),
    "right_hip_angle": (6, 12, 14),
    "left_knee_angle": (11, 13, 15),
    "right_knee_angle": (12, 14, 16),
    "torso_left_chain_angle": (5, 11, 12),
    "torso_right_chain_angle": (6, 12, 11),
}
RATIOS = {
    "left_upper_to_lower_arm": (5, 7, 7, 9),
    "right_upper_to_lower_arm": (6, 8, 8, 10),
    "left_thigh_to_shin": (11, 13, 13, 15),
    "right_thigh_to_shin": (12, 14, 14, 16),
    "left_torso_to_thigh": (5, 11, 11, 13),
    "right_torso_to_thigh": (6, 12, 12, 14),
    "shoulder_to_hip_width": (5, 6, 11, 12),
    "stance_to_hip_width": (15, 16, 11, 12),
    "left_arm_to_left_leg": (5, 9, 11, 15),
    "right_arm_to_right_leg": (6, 10, 12, 16),
}
MIRRORED = ((1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16))

Point = tuple[Column, Column]


def joint(k: int, prefix: str = "") -> Point:
    return F.col(f"{prefix}x{k}"), F.col(f"{prefix}y{k}")


def valid(p: Point) -> Column:
    """Present and strictly positive on both axes."""
    return F.coalesce((p[0] > 0) & (p[1] > 0), F.lit(False))


def forward(side: str = "side") -> Column:
    """Forward direction on the x axis: left fencer +1, right fencer -1."""
    return F.when(F.col(side) == "left", F.lit(1.0)).otherwise(F.lit(-1.0))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def mean_present(cols: list[Column]) -> Column:
    """Mean of the non-null columns, NULL when all are null."""
    n = total([F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    s = total([F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(n > 0, s / n)


def distance(a: Point, b: Point) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def segment(a: Point, b: Point) -> Column:
    """Length between two present joints, NULL when nearly zero."""
    d = distance(a, b)
    return F.when(d > 1e-9, d)


def clip_unit(c: Column) -> Column:
    """Clip to [-1, 1]; NULL stays NULL (greatest and least would skip it)."""
    return F.when(c > 1.0, 1.0).when(c < -1.0, -1.0).otherwise(c)


def angle_between(u: Point, v: Point, floor: float = 0.0) -> Column:
    """Angle between two vectors in radians, NULL when either is too short."""
    nu = F.sqrt(u[0] * u[0] + u[1] * u[1])
    nv = F.sqrt(v[0] * v[0] + v[1] * v[1])
    cos = (u[0] * v[0] + u[1] * v[1]) / F.when((nu > floor) & (nv > floor), nu * nv)
    return F.acos(clip_unit(cos))


def vector(a: Point, b: Point) -> Point:
    """From b to a."""
    return a[0] - b[0], a[1] - b[1]


def joint_angle(a: Point, b: Point, c: Point) -> Column:
    """Angle at b in radians, NULL when a limb is nearly without length."""
    return angle_between(vector(a, b), vector(c, b), 1e-9)


def joint_angle_deg(a: Point, b: Point, c: Point) -> Column:
    """Angle at b in degrees, NULL when a joint is missing or a limb has no length."""
    return F.degrees(angle_between(vector(a, b), vector(c, b)))


def only_valid(df: DataFrame, prefix: str = "") -> DataFrame:
    """Normal form of a pose: both axes NULL unless both are strictly positive.
    The other functions rely on NULL running through arithmetic."""
    cols = {}
    for k in JOINTS:
        x, y = f"{prefix}x{k}", f"{prefix}y{k}"
        for c in (x, y):
            cols[c] = F.expr(f"CASE WHEN {x} > 0 AND {y} > 0 THEN {c} END")
    return df.withColumns(cols)


def centroid(points: list[Point]) -> Point:
    """Mean of present joints, the origin when there is none."""
    return tuple(F.coalesce(mean_present([p[i] for p in points]), F.lit(0.0)) for i in (0, 1))


def bbox(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """Box of present joints truncated to whole pixels, NULL under two joints."""
    xs, ys = (", ".join(f"{prefix}{axis}{k}" for k in JOINTS) for axis in "xy")
    present = " + ".join(f"int({prefix}x{k} IS NOT NULL)" for k in JOINTS)
    return tuple(
        F.expr(f"CASE WHEN {present} >= 2 THEN bigint({edge}) END")
        for edge in (f"least({xs})", f"least({ys})", f"greatest({xs})", f"greatest({ys})")
    )


def box_center(b) -> Point:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def box_area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def box_iou(a, b) -> Column:
    """Intersection over union, 0 when a box is missing or the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = F.when(a[0].isNotNull() & b[0].isNotNull(), w * h)
    union = box_area(a) + box_area(b) - inter
    return F.coalesce(inter / F.when(union > 0, union), F.lit(0.0))


def torso_scale(points: list[Point]) -> Column:
    """Largest distance among present shoulders and hips, 1.0 under two of them."""
    gaps = [distance(points[a], points[b]) for i, a in enumerate(TORSO) for b in TORSO[i + 1 :]]
    return F.coalesce(F.greatest(*gaps), F.lit(1.0))


def _length(a: int, b: int, p: str) -> str:
    return f"sqrt(power({p}x{a} - {p}x{b}, 2) + power({p}y{a} - {p}y{b}, 2))"


def with_descriptor(df: DataFrame, prefix: str = "") -> DataFrame:
    """Add ten angles a0..a9 and ten length ratios r0..r9; NULL when undefined.
    Limb lengths are computed once in a projection of their own."""
    limbs = {frozenset(pair) for a, b, c in ANGLES.values() for pair in ((a, b), (c, b))}
    limbs |= {frozenset(pair) for a, b, c, d in RATIOS.values() for pair in ((a, b), (c, d))}
    p = prefix
    name = lambda a, b: f"_{p}len{min(a, b)}_{max(a, b)}"
    lengths = {name(*limb): F.expr(f"nullif(greatest({_length(*sorted(limb), p)}, 1e-9D), 1e-9D)") for limb in limbs}
    cosines, out = {}, {}
    for i, (a, b, c) in enumerate(ANGLES.values()):
        dot = f"({p}x{a} - {p}x{b}) * ({p}x{c} - {p}x{b}) + ({p}y{a} - {p}y{b}) * ({p}y{c} - {p}y{b})"
        cosines[f"_{p}cos{i}"] = F.expr(f"({dot}) / ({name(a, b)} * {name(c, b)})")
        cos = f"_{p}cos{i}"
        out[f"{p}a{i}"] = F.expr(f"acos(CASE WHEN {cos} > 1 THEN 1D WHEN {cos} < -1 THEN -1D ELSE {cos} END)")
    for i, (a, b, c, d) in enumerate(RATIOS.values()):
        out[f"{p}r{i}"] = F.expr(f"{name(a, b)} / {name(c, d)}")
    return df.withColumns(lengths).withColumns(cosines).withColumns(out).drop(*lengths, *cosines)


def angle_gap(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.least(gap, F.lit(2.0 * math.pi) - gap) / F.lit(math.pi)


def ratio_gap(a: Column, b: Column) -> Column:
    return F.abs(F.ln(F.when((a > 0) & (b > 0), a / b)))


def with_mean_of(df: DataFrame, name: str, exprs: list[str], at_least: int = 1) -> DataFrame:
    """Add the mean of present values, NULL when fewer than ``at_least`` are present.
    The values get their own projection so that each is computed once."""
    temp = [f"_{name}{i}" for i in range(len(exprs))]
    staged = df.withColumns({t: F.expr(e) for t, e in zip(temp, exprs)})
    n = " + ".join(f"int({t} IS NOT NULL)" for t in temp)
    s = " + ".join(f"coalesce({t}, 0D)" for t in temp)
    return staged.withColumn(name, F.expr(f"CASE WHEN {n} >= {at_least} THEN ({s}) / ({n}) END")).drop(*temp)


def with_descriptor_gap(df: DataFrame, name: str, p: str, q: str) -> DataFrame:
    """Mean gap over shared descriptor features, NULL (infinite) under six."""
    turn = f"{2.0 * math.pi!r}D"
    gaps = [
        f"least(abs({p}a{i} - {q}a{i}), {turn} - abs({p}a{i} - {q}a{i})) / {math.pi!r}D" for i in range(len(ANGLES))
    ] + [f"abs(ln({p}r{i} / {q}r{i}))" for i in range(len(RATIOS))]
    return with_mean_of(df, name, gaps, 6)


def with_keypoint_gap(df: DataFrame, name: str, p: str, q: str, joints=JOINTS) -> DataFrame:
    """Mean distance over joints present in both, NULL (infinite) when none is."""
    gaps = [f"sqrt(power({p}x{k} - {q}x{k}, 2) + power({p}y{k} - {q}y{k}, 2))" for k in joints]
    return with_mean_of(df, name, gaps)


def pose(prefix: str = "") -> list[Point]:
    return [joint(k, prefix) for k in JOINTS]


def torso_center_joint(points: list[Point]) -> Point:
    """Mean of shoulders and hips; a joint counts only with both axes present."""
    ok = [p[0].isNotNull() & p[1].isNotNull() for p in (points[k] for k in TORSO)]
    return tuple(mean_present([F.when(v, points[k][i]) for v, k in zip(ok, TORSO)]) for i in (0, 1))


def torso_center_axis(points: list[Point]) -> Point:
    """Mean of shoulders and hips, each axis alone."""
    return tuple(mean_present([points[k][i] for k in TORSO]) for i in (0, 1))


def front_wrist(points: list[Point], side: str = "side") -> Point:
    """Leading wrist: 10 when strictly ahead of 9, else 9; a missing wrist loses."""
    left = F.col(side) == "left"
    worst = F.when(left, F.lit(-1e9)).otherwise(F.lit(1e9))
    a, b = F.coalesce(points[10][0], worst), F.coalesce(points[9][0], worst)
    take = F.when(left, a > b).otherwise(a < b)
    return tuple(F.when(take, points[10][i]).otherwise(points[9][i]) for i in (0, 1))


def elbow_angles(points: list[Point], weapon=(R_SHOULDER, R_ELBOW, R_WRIST)) -> dict[str, Column]:
    """Inner, reflex, signed and selected elbow angle of the weapon arm in degrees."""
    shoulder, elbow, hand = (points[k] for k in weapon)
    upper, lower = vector(shoulder, elbow), vector(hand, elbow)
    inner = F.degrees(angle_between(upper, lower))
    present = inner.isNotNull()
    dot = upper[0] * lower[0] + upper[1] * lower[1]
    cross = upper[0] * lower[1] - upper[1] * lower[0]
    signed = F.degrees(F.atan2(cross, dot))
    run = hand[0] - shoulder[0]
    on_line = shoulder[1] + (hand[1] - shoulder[1]) * (elbow[0] - shoulder[0]) / F.when(F.abs(run) > 1e-9, run)
    above = F.coalesce(elbow[1] < on_line, F.lit(False))
    return {
        "inner": inner,
        "reflex": F.lit(360.0) - inner,
        "directed": F.when(present, F.when(signed >= 0, signed).otherwise(signed + 360.0)),
        "selected": F.when(above, F.lit(360.0) - inner).otherwise(inner),
    }


def arm_body_angle(points: list[Point]) -> Column:
    """Upper arm against trunk in degrees."""
    shoulder, elbow, hip = points[R_SHOULDER], points[R_ELBOW], points[R_HIP]
    return F.degrees(angle_between(vector(elbow, shoulder), vector(hip, shoulder)))
