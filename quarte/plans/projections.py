"""Projections, filters and scalar functions over poses, detections, signals and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.functions import codes, geometry as g
from quarte.operators import tracks
from quarte.operators.series import spread_join
from quarte.plans.registry import big, query, rnd, yes
from quarte.plans import views as v
from quarte.plans.views import sql
from quarte.session import stage
from quarte.sources import adapters as src

KEY = ("phrase_id", "side", "frame")
K = "phrase_id, side, frame"
ARENA = tracks.Arena(src.FRAME_W, src.FRAME_H)
W, H = ARENA.width, ARENA.height
BOXED = {"boxed": f"SELECT phrase_id, side, frame, {', '.join(v.COORDS)}, {v.box()} FROM pixels"}
DETBOX = {"det": f"SELECT phrase_id, frame, det_idx, {', '.join(v.COORDS)}, {v.box()} FROM detections"}


def boxed(spark, sf):
    return tracks.with_box(g.only_valid(src.pixel_poses(spark, sf)))


def boxed_detections(spark, sf):
    return tracks.with_box(g.only_valid(src.detections(spark, sf)))


def pairs(spark, sf):
    """Left and right pose of a frame in one row, prefixes l_ and r_, in pixels."""
    px = g.only_valid(src.pixel_poses(spark, sf))
    side = lambda s: px.where(F.col("side") == s).select(
        "phrase_id", "frame", *[F.expr(f"{c} AS {s[0]}_{c}") for c in v.COORDS]
    )
    return side("left").join(side("right"), ["phrase_id", "frame"])


@query("valid_points", sql(f"SELECT {K}, kp::BIGINT AS kp, x, y FROM joints WHERE x > 0 AND y > 0", "joints"))
def valid_points(spark, sf):
    rows = src.long_poses(src.poses(spark, sf))
    return rows.where((F.col("x") > 0) & (F.col("y") > 0)).withColumn("kp", big("kp"))


@query(
    "centroid",
    sql(
        f"SELECT {K}, {v.rnd('coalesce(' + v.mean(v.joint_list('x')) + ', 0)')} AS cx, "
        f"{v.rnd('coalesce(' + v.mean(v.joint_list('y')) + ', 0)')} AS cy FROM poses",
        "poses",
    ),
)
def centroid(spark, sf):
    cx, cy = g.centroid(g.pose())
    return g.only_valid(src.poses(spark, sf)).select(*KEY, rnd(cx).alias("cx"), rnd(cy).alias("cy"))


@query("bbox", sql(f"SELECT {K}, bx1, by1, bx2, by2 FROM boxed", "pixels", **BOXED))
def bbox(spark, sf):
    return boxed(spark, sf).select(*KEY, "bx1", "by1", "bx2", "by2")


@query(
    "bbox_measures",
    sql(
        f"SELECT {K}, (bx1 + bx2) / 2.0::DOUBLE AS center_x, (by1 + by2) / 2.0::DOUBLE AS center_y, "
        "((bx2 - bx1) * (by2 - by1))::BIGINT AS area FROM boxed",
        "pixels",
        **BOXED,
    ),
)
def bbox_measures(spark, sf):
    b = tracks.box()
    cx, cy = g.box_center(b)
    return boxed(spark, sf).select(
        *KEY, cx.alias("center_x"), cy.alias("center_y"), big(g.box_area(b)).alias("area")
    )


@query(
    "bbox_iou",
    sql(
        f"SELECT l.phrase_id, l.frame, {v.rnd(v.iou('l.', 'r.'))} AS iou FROM boxed l JOIN boxed r "
        "ON l.phrase_id = r.phrase_id AND l.frame = r.frame AND l.side = 'left' AND r.side = 'right'",
        "pixels",
        **BOXED,
    ),
)
def bbox_iou(spark, sf):
    rows = tracks.with_box(tracks.with_box(pairs(spark, sf), "l_"), "r_")
    return rows.select("phrase_id", "frame", rnd(g.box_iou(tracks.box("l_"), tracks.box("r_"))).alias("iou"))


PAD = "greatest(24.0::DOUBLE, greatest(greatest(1, bx2 - bx1), greatest(1, by2 - by1)) * 0.3::DOUBLE)"


@query(
    "bbox_expand",
    sql(
        f"SELECT {K}, greatest(0, floor(bx1 - {PAD}))::BIGINT AS x1, greatest(0, floor(by1 - {PAD}))::BIGINT AS y1, "
        f"least({W}, ceil(bx2 + {PAD}))::BIGINT AS x2, least({H}, ceil(by2 + {PAD}))::BIGINT AS y2 "
        "FROM boxed WHERE bx1 IS NOT NULL",
        "pixels",
        **BOXED,
    ),
)
def bbox_expand(spark, sf):
    rows = boxed(spark, sf).where(F.col("bx1").isNotNull())
    edges = tracks.pad_box(tracks.box(), W, H, 0.3)
    return rows.select(*KEY, *[big(e).alias(n) for n, e in zip(("x1", "y1", "x2", "y2"), edges)])


TORSO_GAPS = ", ".join(
    f"CASE WHEN {v.ok(a)} AND {v.ok(b)} THEN {v.dist(a, b)} END"
    for i, a in enumerate(g.TORSO)
    for b in g.TORSO[i + 1 :]
)


@query("torso_scale", sql(f"SELECT {K}, {v.rnd(f'coalesce(greatest({TORSO_GAPS}), 1.0)')} AS scale FROM poses", "poses"))
def torso_scale(spark, sf):
    return g.only_valid(src.poses(spark, sf)).select(*KEY, rnd(g.torso_scale(g.pose())).alias("scale"))


@query(
    "segment_length",
    sql(
        f"SELECT {K}, {v.rnd(v.seg(5, 7))} AS upper_arm, {v.rnd(v.seg(7, 9))} AS lower_arm, "
        f"{v.rnd(v.seg(11, 13))} AS thigh FROM poses",
        "poses",
    ),
)
def segment_length(spark, sf):
    p = g.pose()
    return g.only_valid(src.poses(spark, sf)).select(
        *KEY,
        rnd(g.segment(p[5], p[7])).alias("upper_arm"),
        rnd(g.segment(p[7], p[9])).alias("lower_arm"),
        rnd(g.segment(p[11], p[13])).alias("thigh"),
    )


@query(
    "joint_angle",
    sql(
        f"SELECT {K}, {v.rnd(v.joint_angle(5, 7, 9))} AS elbow, {v.rnd(v.joint_angle(12, 14, 16))} AS knee FROM poses",
        "poses",
    ),
)
def joint_angle(spark, sf):
    p = g.pose()
    return g.only_valid(src.poses(spark, sf)).select(
        *KEY,
        rnd(g.joint_angle(p[5], p[7], p[9])).alias("elbow"),
        rnd(g.joint_angle(p[12], p[14], p[16])).alias("knee"),
    )


@query(
    "joint_angle_deg",
    sql(
        f"SELECT {K}, {v.rnd('degrees(' + v.angle(13, 11, 12) + ')')} AS hip_angle, "
        f"{v.rnd('degrees(' + v.angle(11, 12, 14) + ')')} AS other_hip_angle FROM poses",
        "poses",
    ),
)
def joint_angle_deg(spark, sf):
    p = g.pose()
    return src.poses(spark, sf).select(
        *KEY,
        rnd(g.joint_angle_deg(p[13], p[11], p[12])).alias("hip_angle"),
        rnd(g.joint_angle_deg(p[11], p[12], p[14])).alias("other_hip_angle"),
    )


DESC_OUT = [f"a{i}" for i in range(10)] + [f"r{i}" for i in range(10)]


@query(
    "pose_descriptor",
    sql(
        f"SELECT {K}, {', '.join(f'{v.rnd(c)} AS {c}' for c in DESC_OUT)} FROM d",
        "poses",
        d=f"SELECT {K}, {v.descriptor()} FROM poses",
    ),
)
def pose_descriptor(spark, sf):
    return g.with_descriptor(g.only_valid(src.poses(spark, sf))).select(*KEY, *[rnd(c).alias(c) for c in DESC_OUT])


LR_DESC = {
    "l": f"SELECT phrase_id, frame, {', '.join(v.COORDS)}, {v.box()}, {v.descriptor()} FROM pixels WHERE side = 'left'",
    "r": f"SELECT phrase_id, frame, {', '.join(v.COORDS)}, {v.box()}, {v.descriptor()} FROM pixels WHERE side = 'right'",
}


@query(
    "angle_ratio_distance",
    sql(
        "SELECT phrase_id, frame, "
        + v.rnd("least(abs(l.a0 - r.a0), 2 * pi() - abs(l.a0 - r.a0)) / pi() + 0 * (l.a0 - r.a0)")
        + " AS angle_gap, "
        + v.rnd("abs(ln(l.r6 / r.r6))")
        + " AS ratio_gap FROM l JOIN r USING (phrase_id, frame)",
        "pixels",
        **LR_DESC,
    ),
)
def angle_ratio_distance(spark, sf):
    rows = g.with_descriptor(g.with_descriptor(pairs(spark, sf), "l_"), "r_")
    return rows.select(
        "phrase_id",
        "frame",
        rnd(g.angle_gap(F.col("l_a0"), F.col("r_a0"))).alias("angle_gap"),
        rnd(g.ratio_gap(F.col("l_r6"), F.col("r_r6"))).alias("ratio_gap"),
    )


@query(
    "descriptor_distance",
    sql(
        f"SELECT phrase_id, frame, {v.rnd(v.descriptor_gap('l.', 'r.'))} AS gap FROM l JOIN r USING (phrase_id, frame)",
        "pixels",
        **LR_DESC,
    ),
)
def descriptor_distance(spark, sf):
    rows = g.with_descriptor(g.with_descriptor(pairs(spark, sf), "l_"), "r_")
    rows = g.with_descriptor_gap(rows, "gap", "l_", "r_")
    return rows.select("phrase_id", "frame", rnd("gap").alias("gap"))


@query(
    "keypoint_distance",
    sql(
        f"SELECT phrase_id, frame, {v.rnd(v.kp_gap('l.', 'r.'))} AS gap, "
        f"{v.rnd(v.kp_gap('l.', 'r.', g.TORSO))} AS torso_gap FROM l JOIN r USING (phrase_id, frame)",
        "pixels",
        **LR_DESC,
    ),
)
def keypoint_distance(spark, sf):
    rows = g.with_keypoint_gap(pairs(spark, sf), "gap", "l_", "r_")
    rows = g.with_keypoint_gap(rows, "torso_gap", "l_", "r_", g.TORSO)
    return rows.select("phrase_id", "frame", rnd("gap").alias("gap"), rnd("torso_gap").alias("torso_gap"))


COST_SQL = {
    **LR_DESC,
    "m": "SELECT phrase_id, frame, "
    f"{v.kp_gap('l.', 'r.')} AS kpt, {v.descriptor_gap('l.', 'r.')} AS posture, "
    f"CASE WHEN l.bx1 IS NULL OR r.bx1 IS NULL THEN 0.5 ELSE 1 - ({v.iou('l.', 'r.')}) END AS boxc, "
    f"coalesce(greatest({TORSO_GAPS.replace('x', 'r.x').replace('y', 'r.y').replace('greatest', 'greatest')}), 1.0) AS scale, "
    f"coalesce({v.mean(v.joint_list('x', 'r.'))}, 0) AS px, coalesce({v.mean(v.joint_list('y', 'r.'))}, 0) AS py, "
    "(l.bx1 + l.bx2) / 2.0::DOUBLE AS dx, (l.by1 + l.by2) / 2.0::DOUBLE AS dy "
    "FROM l JOIN r USING (phrase_id, frame)",
}


@query(
    "track_cost",
    sql(
        "SELECT phrase_id, frame, "
        + v.rnd(
            "CASE WHEN posture IS NULL THEN 0.7 * kpt / scale + 0.2 * boxc + 0.1 * motion "
            "ELSE 0.45 * kpt / scale + 0.35 * posture + 0.12 * boxc + 0.08 * motion END"
        )
        + f" AS cost FROM (SELECT *, coalesce(sqrt((dx - px) * (dx - px) + (dy - py) * (dy - py)) / {ARENA.diag!r}::DOUBLE, 0) AS motion FROM m)",
        "pixels",
        **COST_SQL,
    ),
)
def track_cost(spark, sf):
    """Cost of the left pose as a detection for a track last seen at the right pose."""
    rows = pairs(spark, sf)
    for p in ("l_", "r_"):
        rows = g.with_descriptor(tracks.with_box(rows, p), p)
    prev = g.pose("r_")
    rows = g.with_keypoint_gap(rows, "kpt", "l_", "r_")
    rows = g.with_descriptor_gap(rows, "posture", "l_", "r_")
    cost = tracks.track_cost(
        F.col("kpt"),
        tracks.box("l_"),
        tracks.box("r_"),
        g.centroid(prev),
        g.torso_scale(prev),
        F.col("posture"),
        ARENA.diag,
    )
    return rows.select("phrase_id", "frame", rnd(cost).alias("cost"))


EDGE_SQL = (
    f"CASE WHEN bx1 IS NULL THEN 1.0 ELSE (greatest(0, {ARENA.edge} - bx1) + greatest(0, bx2 - {W - ARENA.edge}) + "
    f"greatest(0, {ARENA.top} - by1) + greatest(0, by2 - {H - ARENA.bottom})) / {float(max(W, H))}::DOUBLE END"
)
CX_SQL = "((bx1 + bx2) / 2.0::DOUBLE)"


@query(
    "zone_penalties",
    sql(
        f"SELECT {K}, {v.rnd(EDGE_SQL)} AS edge, "
        + v.rnd(f"CASE WHEN abs({CX_SQL} - {W / 2}) >= {ARENA.deadzone} THEN 0 ELSE ({ARENA.deadzone} - abs({CX_SQL} - {W / 2})) / {ARENA.deadzone} END")
        + " AS center, "
        + v.rnd(f"greatest(0, ({CX_SQL} - {W / 2}) / {W / 2})")
        + " AS side_left, "
        + v.rnd(f"greatest(0, ({W / 2} - {CX_SQL}) / {W / 2})")
        + " AS side_right FROM boxed WHERE bx1 IS NOT NULL",
        "pixels",
        **BOXED,
    ),
)
def zone_penalties(spark, sf):
    b = tracks.box()
    cx = g.box_center(b)[0]
    return boxed(spark, sf).where(F.col("bx1").isNotNull()).select(
        *KEY,
        rnd(tracks.edge_penalty(b, ARENA)).alias("edge"),
        rnd(tracks.center_penalty(cx, ARENA)).alias("center"),
        rnd(tracks.side_penalty(F.lit(0), cx, ARENA)).alias("side_left"),
        rnd(tracks.side_penalty(F.lit(1), cx, ARENA)).alias("side_right"),
    )


SAFE_CENTER = f"abs({CX_SQL} - {W / 2}) >= {ARENA.deadzone}"
EDGE_TEST = (
    "({x} >= %d AND {x} <= %d AND {y} >= %d AND {y} <= %d)" % (ARENA.edge, W - ARENA.edge, ARENA.top, H - ARENA.bottom)
)


@query(
    "zone_filters",
    sql(
        f"SELECT {K}, {EDGE_TEST.format(x=CX_SQL, y='((by1 + by2) / 2.0::DOUBLE)')} AS edge_ok, {SAFE_CENTER} AS center_ok, "
        f"(bx1 > {ARENA.edge} AND bx2 < {W - ARENA.edge} AND by1 > {ARENA.top} AND by2 < {H - ARENA.bottom}) AS box_ok "
        "FROM boxed WHERE bx1 IS NOT NULL",
        "pixels",
        **BOXED,
    ),
)
def zone_filters(spark, sf):
    b = tracks.box()
    c = g.box_center(b)
    return boxed(spark, sf).where(F.col("bx1").isNotNull()).select(
        *KEY,
        tracks.edge_safe(c, ARENA).alias("edge_ok"),
        tracks.center_safe(c, ARENA).alias("center_ok"),
        tracks.box_edge_safe(b, ARENA).alias("box_ok"),
    )


INIT = {
    "c": f"SELECT {K}, coalesce({v.mean(v.joint_list('x'))}, 0) AS cx, coalesce({v.mean(v.joint_list('y'))}, 0) AS cy FROM pixels"
}


@query(
    "init_score",
    sql(
        f"SELECT {K}, "
        + ", ".join(
            v.rnd(
                f"CASE WHEN {EDGE_TEST.format(x='cx', y='cy')} AND abs(cx - {W / 2}) >= {ARENA.deadzone} THEN "
                f"exp(-0.5 * pow(abs(cx - {W / 2}) / {ARENA.sigma}, 2)) + CASE WHEN cx {op} {W / 2} THEN 1 ELSE 0 END ELSE -1e9 END"
            )
            + f" AS {name}_score"
            for name, op in (("left", "<"), ("right", ">="))
        )
        + " FROM c",
        "pixels",
        **INIT,
    ),
)
def init_score(spark, sf):
    cx, cy = g.centroid(g.pose())
    rows = g.only_valid(src.pixel_poses(spark, sf)).select(*KEY, cx.alias("cx"), cy.alias("cy"))
    c = F.col("cx"), F.col("cy")
    return rows.select(
        *KEY,
        rnd(tracks.init_score(c, "left", ARENA)).alias("left_score"),
        rnd(tracks.init_score(c, "right", ARENA)).alias("right_score"),
    )


def _share(ids):
    return "(" + " + ".join(f"CASE WHEN {v.ok(k)} THEN 1.0::DOUBLE ELSE 0 END" for k in ids) + f") / {len(ids)}"


def _lowest(ids):
    return f"greatest({', '.join(f'CASE WHEN {v.ok(k)} THEN y{k} END' for k in ids)})"


BOOT_SQL = {
    **DETBOX,
    "boot1": f"SELECT *, (bx2 - bx1)::DOUBLE AS w, (by2 - by1)::DOUBLE AS h, by2::DOUBLE AS bottom, "
    f"0.5 * {_share((11, 12, 13, 14, 15, 16))} + 0.3 * {_share((5, 6))} + 0.2 * {_share((15, 16))} AS quality, "
    f"coalesce({_lowest((15, 16))}, by2) AS ankle, abs({CX_SQL} - {W / 2}) AS gap FROM det WHERE bx1 IS NOT NULL",
    "boot2": f"SELECT *, coalesce({_lowest((13, 14))}, ankle) AS knee FROM boot1",
    "boot": f"SELECT phrase_id, frame, det_idx, CASE WHEN {CX_SQL} < {W / 2} THEN 'left' ELSE 'right' END AS side, "
    f"bx1, by1, bx2, by2, quality, bottom / {H} AS bottom_n, ankle / {H} AS ankle_n, knee / {H} AS knee_n, "
    f"coalesce({_lowest((11, 12))}, knee) / {H} AS hip_n, "
    f"least(1.0::DOUBLE, w * h / {W * H * 0.1!r}::DOUBLE) AS area, "
    f"CASE WHEN gap < {W * 0.04} THEN ({W * 0.04} - gap) / {W * 0.04} ELSE 0 END::DOUBLE AS cpen, "
    f"greatest(0, ({H * 0.16} - h) / {H * 0.16})::DOUBLE AS small FROM boot2 "
    f"WHERE w >= 20 AND h >= 60 AND bx1 > {W * 0.03} AND bx2 < {W - W * 0.03} AND by1 > {H * 0.05} AND by2 < {H - H * 0.05} "
    f"AND bottom >= {H * 0.22} AND quality >= 0.15",
    "booted": "SELECT *, 0.55 * bottom_n + 0.25 * ankle_n + 0.15 * knee_n + 0.05 * area AS depth, "
    "0.55 * bottom_n + 0.25 * ankle_n + 0.15 * knee_n + 0.05 * area + 0.2 * quality - 0.08 * cpen - 0.05 * small AS raw FROM boot",
}


def bootstrap_rows(spark, sf):
    """Kept starting candidates with their scores.

    The boxes are stored: read anew in every expression, their joints would make code too long to compile."""
    return tracks.bootstrap(stage(boxed_detections(spark, sf)), ARENA)


@query(
    "bootstrap_candidate",
    sql(
        f"SELECT phrase_id, frame, det_idx, side, {v.rnd('depth')} AS depth_score, {v.rnd('quality')} AS pose_quality, "
        f"{v.rnd('raw')} AS raw_score FROM booted",
        "detections",
        **BOOT_SQL,
    ),
)
def bootstrap_candidate(spark, sf):
    return bootstrap_rows(spark, sf).select(
        "phrase_id", "frame", "det_idx", "side",
        *[rnd(c).alias(c) for c in ("depth_score", "pose_quality", "raw_score")],
    )


def _swap_sql(k: int, axis: str) -> str:
    for a, b in g.MIRRORED:
        if k in (a, b):
            other = b if k == a else a
            cross = f"CASE WHEN side = 'left' THEN coalesce(x{a}, 0) > coalesce(x{b}, 0) ELSE coalesce(x{a}, 0) < coalesce(x{b}, 0) END"
            return f"CASE WHEN {cross} THEN coalesce({axis}{other}, 0) ELSE coalesce({axis}{k}, 0) END"
    return f"coalesce({axis}{k}, 0)"


SWAPPED = {"swapped": f"SELECT {K}, " + ", ".join(f"{_swap_sql(k, a)} AS {a}{k}" for k in g.JOINTS for a in "xy") + " FROM pixels"}


def mirror(df):
    """Exchange mirrored joints so that the higher index leads. The comparison
    uses raw x, where a missing joint is 0."""
    raw = {c: F.expr(f"coalesce({c}, 0D)") for c in v.COORDS}
    out = {}
    for a, b in g.MIRRORED:
        cross = f"CASE WHEN side = 'left' THEN x{a} > x{b} ELSE x{a} < x{b} END"
        for axis in "xy":
            out[f"{axis}{a}"] = F.expr(f"CASE WHEN {cross} THEN {axis}{b} ELSE {axis}{a} END")
            out[f"{axis}{b}"] = F.expr(f"CASE WHEN {cross} THEN {axis}{a} ELSE {axis}{b} END")
    return df.withColumns(raw).withColumns(out)


def to_units(df, c: float):
    """Pixels to normalised units; a joint that is not strictly positive is missing."""
    return g.only_valid(df).withColumns({k: F.expr(f"{k} / {c!r}D") for k in v.COORDS})


@query(
    "mirror_swap",
    sql(
        " UNION ALL ".join(f"SELECT {K}, {k}::BIGINT AS kp, x{k} AS x, y{k} AS y FROM swapped" for k in g.JOINTS),
        "pixels",
        **SWAPPED,
    ),
)
def mirror_swap(spark, sf):
    return src.long_poses(mirror(src.pixel_poses(spark, sf))).withColumn("kp", big("kp"))


@query(
    "normalise",
    sql(
        " UNION ALL ".join(
            f"SELECT {K}, {k}::BIGINT AS kp, {v.rnd(f'CASE WHEN {v.ok(k)} THEN x{k} / 200.0 END', 6)} AS x, "
            f"{v.rnd(f'CASE WHEN {v.ok(k)} THEN y{k} / 200.0 END', 6)} AS y, "
            f"trunc(CASE WHEN {v.ok(k)} THEN x{k} / 200.0::DOUBLE END * 200.0::DOUBLE)::BIGINT AS pixel_x FROM swapped"
            for k in g.JOINTS
        ),
        "pixels",
        **SWAPPED,
    ),
)
def normalise(spark, sf):
    units = src.long_poses(to_units(mirror(src.pixel_poses(spark, sf)), 200.0))
    return units.select(
        *KEY, big("kp").alias("kp"), rnd("x", 6).alias("x"), rnd("y", 6).alias("y"), big(F.col("x") * 200.0).alias("pixel_x")
    )


@query(
    "side_swap",
    sql(
        "SELECT l.phrase_id, l.frame, coalesce(l.bx1 + l.bx2 > r.bx1 + r.bx2, false) AS swapped, "
        "CASE WHEN coalesce(l.bx1 + l.bx2 > r.bx1 + r.bx2, false) THEN r.x16 ELSE l.x16 END AS left_foot, "
        "CASE WHEN coalesce(l.bx1 + l.bx2 > r.bx1 + r.bx2, false) THEN l.x16 ELSE r.x16 END AS right_foot "
        "FROM boxed l JOIN boxed r ON l.phrase_id = r.phrase_id AND l.frame = r.frame AND l.side = 'left' AND r.side = 'right'",
        "pixels",
        **BOXED,
    ),
)
def side_swap(spark, sf):
    rows = tracks.with_box(tracks.with_box(pairs(spark, sf), "l_"), "r_")
    swapped = yes(g.box_center(tracks.box("l_"))[0] > g.box_center(tracks.box("r_"))[0])
    return rows.withColumn("swapped", swapped).select(
        "phrase_id",
        "frame",
        "swapped",
        F.when(F.col("swapped"), F.col("r_x16")).otherwise(F.col("l_x16")).alias("left_foot"),
        F.when(F.col("swapped"), F.col("l_x16")).otherwise(F.col("r_x16")).alias("right_foot"),
    )


WRIST = "CASE WHEN side = 'left' THEN coalesce(x10, -1e9) > coalesce(x9, -1e9) ELSE coalesce(x10, 1e9) < coalesce(x9, 1e9) END"


@query(
    "front_wrist",
    sql(
        f"SELECT {K}, CASE WHEN {WRIST} THEN x10 ELSE x9 END AS wrist_x, CASE WHEN {WRIST} THEN y10 ELSE y9 END AS wrist_y FROM poses",
        "poses",
    ),
)
def front_wrist(spark, sf):
    x, y = g.front_wrist(g.pose())
    return src.poses(spark, sf).select(*KEY, x.alias("wrist_x"), y.alias("wrist_y"))


@query(
    "torso_center",
    sql(
        f"SELECT {K}, {v.rnd(v.torso('x'))} AS joint_x, {v.rnd(v.torso('y'))} AS joint_y, "
        f"{v.rnd(v.torso('x', need='axis'))} AS axis_x, {v.rnd(v.torso('y', need='axis'))} AS axis_y FROM poses",
        "poses",
    ),
)
def torso_center(spark, sf):
    p = g.pose()
    (jx, jy), (ax, ay) = g.torso_center_joint(p), g.torso_center_axis(p)
    return src.poses(spark, sf).select(
        *KEY, rnd(jx).alias("joint_x"), rnd(jy).alias("joint_y"), rnd(ax).alias("axis_x"), rnd(ay).alias("axis_y")
    )


AHEAD_SQL = (
    f"(CASE WHEN side = 'left' THEN 1 ELSE -1 END) * ((CASE WHEN {WRIST} THEN x10 ELSE x9 END) - {v.torso('x', need='axis')}) / "
    f"(abs({v.mean(v.joint_list('y', joints=(15, 16), need='axis'))} - {v.mean(v.joint_list('y', joints=(5, 6), need='axis'))}) + 1e-6)"
)


def ahead_norm(points):
    """Lead of the front wrist over the torso, in body heights."""
    body = F.abs(
        g.mean_present([points[15][1], points[16][1]]) - g.mean_present([points[5][1], points[6][1]])
    )
    return g.forward() * (g.front_wrist(points)[0] - g.torso_center_axis(points)[0]) / (body + 1e-6)


@query("ahead_norm", sql(f"SELECT {K}, {v.rnd(AHEAD_SQL, 3)} AS ahead FROM poses", "poses"))
def ahead(spark, sf):
    return src.poses(spark, sf).select(*KEY, rnd(ahead_norm(g.pose()), 3).alias("ahead"))


ELBOW = {
    "e": f"SELECT *, degrees({v.angle(6, 8, 10)}) AS inn, (x6 - x8) * (x10 - x8) + (y6 - y8) * (y10 - y8) AS dot, "
    "(x6 - x8) * (y10 - y8) - (y6 - y8) * (x10 - x8) AS crs, "
    "coalesce(y8 < y6 + (y10 - y6) * (x8 - x6) / CASE WHEN abs(x10 - x6) > 1e-9 THEN x10 - x6 END, false) AS above FROM poses"
}


@query(
    "elbow_angle",
    sql(
        f"SELECT {K}, {v.rnd('inn')} AS inner_deg, {v.rnd('360 - inn')} AS reflex_deg, "
        f"{v.rnd('CASE WHEN inn IS NOT NULL THEN CASE WHEN atan2(crs, dot) >= 0 THEN degrees(atan2(crs, dot)) ELSE degrees(atan2(crs, dot)) + 360 END END')} AS directed_deg, "
        f"{v.rnd('CASE WHEN above THEN 360 - inn ELSE inn END')} AS selected_deg FROM e",
        "poses",
        **ELBOW,
    ),
)
def elbow_angle(spark, sf):
    parts = g.elbow_angles(g.pose())
    return src.poses(spark, sf).select(*KEY, *[rnd(c).alias(f"{n}_deg") for n, c in parts.items()])


@query("arm_body_angle", sql(f"SELECT {K}, {v.rnd('degrees(' + v.angle(8, 6, 12) + ')')} AS arm_body_deg FROM poses", "poses"))
def arm_body(spark, sf):
    return src.poses(spark, sf).select(*KEY, rnd(g.arm_body_angle(g.pose())).alias("arm_body_deg"))


SAFE = "CASE WHEN fps >= 0.1 THEN fps ELSE 15.0 END"


@query(
    "fps_scaling",
    sql(
        f"SELECT p_partkey, CASE WHEN n <= 0 THEN 0 ELSE greatest(1, round_even(n * ({SAFE})::DOUBLE / 15.0, 0)::BIGINT) END::BIGINT AS frames, "
        f"{v.rnd(f'0.035 * (15.0::DOUBLE / ({SAFE}))', 6)} AS per_frame FROM "
        "(SELECT p_partkey, p_partkey % 20 AS n, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 2.0::DOUBLE END AS fps FROM part)"
    ),
)
def fps_scaling(spark, sf):
    fps = F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 2.0)
    n = F.col("p_partkey") % 20
    return src.table(spark, sf, "part").select(
        "p_partkey",
        big(codes.scale_frames(n, fps, 1)).alias("frames"),
        rnd(codes.scale_per_frame(F.lit(0.035), fps), 6).alias("per_frame"),
    )


TAG = r"regexp_extract(line, '\[([^\]]+)\]\s*$', 1)"
NORM = f"trim(regexp_replace(lower(replace({TAG}, '_', ' ')), '\\s+', ' ', 'g'))"


@query(
    "tag_labels",
    sql(
        f"SELECT phrase_id, line_no, {NORM} AS tag, CASE WHEN {NORM} = 'accident' THEN 1 "
        f"WHEN {NORM} IN ('left beat', 'left defend', 'right beat', 'right defend') THEN 0 END::BIGINT AS accident, "
        f"CASE WHEN {NORM} LIKE 'left %' THEN 'left' WHEN {NORM} LIKE 'right %' THEN 'right' WHEN {NORM} = 'accident' THEN 'accident' END AS benefit "
        f"FROM plog WHERE {TAG} <> ''",
        "plog",
    ),
)
def tag_labels(spark, sf):
    tag = F.regexp_extract("line", r"\[([^\]]+)\]\s*$", 1)
    return (
        src.phrase_log(spark, sf)
        .withColumn("raw", tag)
        .where(F.col("raw") != "")
        .select(
            "phrase_id",
            "line_no",
            codes.norm_tag(F.col("raw")).alias("tag"),
            big(codes.is_accident(F.col("raw"))).alias("accident"),
            codes.benefit(F.col("raw")).alias("benefit"),
        )
    )


@query(
    "confidence_tiers",
    sql(
        "SELECT event_id, CASE WHEN abs(m) >= 0.16 THEN 'high' WHEN abs(m) >= 0.08 THEN 'medium' ELSE 'low' END AS confidence, "
        f"{v.rnd('1 / (1 + exp(-m / 0.08))')} AS prob_left FROM (SELECT event_id, (value - 50) / 250.0::DOUBLE AS m FROM events)"
    ),
)
def confidence_tiers(spark, sf):
    m = (F.col("value") - 50) / 250.0
    tier = F.when(F.abs(m) >= 0.16, "high").when(F.abs(m) >= 0.08, "medium").otherwise("low")
    return src.table(spark, sf, "events").select(
        "event_id", tier.alias("confidence"), rnd(1 / (1 + F.exp(-m / 0.08))).alias("prob_left")
    )


@query(
    "side_codes",
    sql(
        "SELECT idx, CASE fight WHEN 8 THEN 'left' WHEN 9 THEN 'right' END AS fight_side, "
        "coalesce(lf, a, false) AS light_a, coalesce(b, false) AS light_b, "
        "CASE w WHEN 'a' THEN 'A' WHEN 'B' THEN 'B' WHEN 'Left' THEN 'A' WHEN 'right' THEN 'B' END AS winner_ab, "
        "CASE w WHEN 'a' THEN 8 WHEN 'B' THEN 9 WHEN 'Left' THEN 8 WHEN 'right' THEN 9 ELSE 0 END::BIGINT AS code, "
        "CASE w WHEN 'B' THEN 'right' WHEN 'Left' THEN 'left' WHEN 'right' THEN 'right' END AS visual FROM "
        "(SELECT idx, fight, CASE WHEN idx % 3 = 0 THEN NULL ELSE idx % 2 = 0 END AS a, CASE WHEN idx % 5 = 0 THEN NULL ELSE idx % 4 < 2 END AS b, "
        "CASE WHEN idx % 7 = 0 THEN idx % 2 = 1 END AS lf, CASE idx % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'B' WHEN 2 THEN 'Left' WHEN 3 THEN 'right' ELSE 'tie' END AS w FROM signals)",
        "signals",
    ),
)
def side_codes(spark, sf):
    i = F.col("idx")
    a, b = F.when(i % 3 != 0, i % 2 == 0), F.when(i % 5 != 0, i % 4 < 2)
    left_light = F.when(i % 7 == 0, i % 2 == 1)
    w = F.when(i % 5 == 0, "a").when(i % 5 == 1, "B").when(i % 5 == 2, "Left").when(i % 5 == 3, "right").otherwise("tie")
    ab = codes.winner_ab(w)
    return src.signals(spark, sf).select(
        "idx",
        codes.side_of_fight(F.col("fight")).alias("fight_side"),
        yes(F.coalesce(left_light, a)).alias("light_a"),
        yes(b).alias("light_b"),
        ab.alias("winner_ab"),
        big(codes.code_of_ab(ab)).alias("code"),
        codes.visual_side(w).alias("visual"),
    )


WEAPON_TEXT = ("1", "2", " 3 ", "Foil", "floret", "Épée", "EPEE", "sabre", "Saber", "重剑", "lance")


@query(
    "weapon_code",
    sql(
        "SELECT event_id, w AS weapon, coalesce(try_cast(trim(w) AS BIGINT), CASE WHEN lower(trim(w)) IN ('foil', 'floret', '花剑') THEN 1 "
        "WHEN lower(trim(w)) IN ('epee', 'épée', '重剑') THEN 2 WHEN lower(trim(w)) IN ('sabre', 'saber', '佩剑') THEN 3 END)::BIGINT AS code "
        f"FROM (SELECT event_id, CASE event_id % {len(WEAPON_TEXT)} "
        + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WEAPON_TEXT))
        + " END AS w FROM events)"
    ),
)
def weapon_code(spark, sf):
    w = F.element_at(F.array(*[F.lit(x) for x in WEAPON_TEXT]), (F.col("event_id") % len(WEAPON_TEXT) + 1).cast("int"))
    return src.table(spark, sf, "events").select(
        "event_id", w.alias("weapon"), big(codes.weapon_code(w)).alias("code")
    )


@query(
    "light_result",
    sql(
        "SELECT event_id, CASE WHEN a AND NOT b THEN 8 WHEN b AND NOT a THEN 9 WHEN a AND b THEN 10 ELSE 0 END::BIGINT AS result "
        "FROM (SELECT event_id, value > 40 AS a, event_id % 3 = 0 AS b FROM events)"
    ),
)
def light_result(spark, sf):
    return src.table(spark, sf, "events").select(
        "event_id", big(codes.light_result(F.col("value") > 40, F.col("event_id") % 3 == 0)).alias("result")
    )


# Decision texts the reason rules look for, picked by event number.
REASON_TEXTS = (
    "Blade contact analysis unavailable; fallback",
    "Non-accident blade contact overrode context",
    "Non-accident blade contact favored left",
    "Left wins: near-hit arm extension",
    "Left wins: beneficial lunge in window",
    "left's weighted signal start is earlier",
    "left loses on slow-start penalty",
    "Right faster (speed: 0.1)",
    "",
)
SOURCES = (
    "final_lights_no_touch", "final_lights_single_touch", "final_lights_double_touch_epee",
    "final_lights_double_touch", "local_streaming_analyzer", "local_streaming_analyzer",
    "local_streaming_analyzer", "other",
)


def _pick(texts, n):
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (n % len(texts) + 1).cast("int"))


def _pick_sql(texts, n):
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"([{listed}])[(({n}) % {len(texts)} + 1)::INT]"


REASON_SQL = {
    "q": f"SELECT event_id, {_pick_sql(SOURCES, 'event_id')} AS src, {_pick_sql(REASON_TEXTS, 'event_id // 8')} AS txt, "
    "event_id % 10 <> 9 AS has_result, event_id % 17 = 0 AS tied, CASE WHEN event_id % 3 = 0 THEN 'left' WHEN event_id % 3 = 1 THEN 'right' ELSE '' END AS es, "
    f"{_pick_sql(('pause', 'retreat', 'harmful_lunge', 'harmful_arm_extension', 'none'), 'event_id // 3')} AS et, "
    "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS vs, event_id % 13 = 0 AS err FROM events",
    "qq": "SELECT *, CASE "
    "WHEN src = 'final_lights_no_touch' THEN 'no_touch' WHEN src = 'final_lights_single_touch' THEN 'single_light' "
    "WHEN src = 'final_lights_double_touch_epee' THEN 'epee_double_touch' "
    "WHEN src = 'final_lights_double_touch' THEN CASE WHEN err THEN 'analysis_unavailable' WHEN has_result THEN 'analysis_no_winner' ELSE 'unclear_double_touch' END "
    "WHEN src <> 'local_streaming_analyzer' THEN CASE WHEN vs IS NOT NULL THEN 'analysis_reason_unknown' ELSE 'analysis_unavailable' END "
    "WHEN NOT has_result OR vs IS NULL THEN 'analysis_no_winner' "
    "WHEN contains(lower(txt), 'blade contact analysis unavailable') THEN 'blade_unavailable_fallback' "
    "WHEN contains(lower(txt), 'non-accident blade contact overrode') THEN 'blade_override' "
    "WHEN contains(lower(txt), 'non-accident blade contact favored') THEN 'blade_favored' "
    "WHEN tied THEN 'system_tiebreak_right' "
    "WHEN es <> '' AND es <> vs AND et = 'pause' THEN 'opponent_pause' WHEN es <> '' AND es <> vs AND et = 'retreat' THEN 'opponent_retreat' "
    "WHEN es <> '' AND es <> vs AND et = 'harmful_lunge' THEN 'opponent_late_lunge' "
    "WHEN es <> '' AND es <> vs AND et = 'harmful_arm_extension' THEN 'opponent_arm_reset' "
    "WHEN contains(lower(txt), 'near-hit arm extension') THEN 'arm_first' WHEN contains(lower(txt), 'beneficial lunge') THEN 'lunge_first' "
    "WHEN contains(lower(txt), 'weighted signal start is earlier') THEN 'attack_first' WHEN contains(lower(txt), 'slow-start penalty') THEN 'slow_start' "
    "WHEN contains(lower(txt), 'faster') THEN 'faster_attack' ELSE 'analysis_reason_unknown' END AS code FROM q",
    "sided": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in codes.SIDE_REASONS.items()) + ") t(code, text)",
    "neutral": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in codes.NEUTRAL_REASONS.items()) + ") t(code, text)",
}


@query(
    "reason_code",
    sql(
        "SELECT event_id, code AS reason_code, CASE WHEN vs IS NOT NULL AND s.text IS NOT NULL THEN replace(s.text, '{side}', CASE vs WHEN 'left' THEN '左方' ELSE '右方' END) "
        "ELSE coalesce(n.text, '') END AS spoken, CASE WHEN vs IS NOT NULL AND s.text IS NOT NULL THEN 'reason_' || code || '_' || vs ELSE 'reason_' || code END AS audio_key "
        "FROM qq LEFT JOIN sided s USING (code) LEFT JOIN neutral n USING (code)",
        **REASON_SQL,
    ),
)
def reason_code(spark, sf):
    i = F.col("event_id")
    visual = F.when(i % 11 == 0, F.lit(None)).when(i % 2 == 0, "left").otherwise("right")
    code = codes.reason_code(
        _pick(SOURCES, i),
        _pick(REASON_TEXTS, F.expr("event_id div 8")),
        i % 10 != 9,
        i % 17 == 0,
        F.when(i % 3 == 0, "left").when(i % 3 == 1, "right").otherwise(""),
        _pick(("pause", "retreat", "harmful_lunge", "harmful_arm_extension", "none"), F.expr("event_id div 3")),
        visual,
        i % 13 == 0,
    )
    rows = src.table(spark, sf, "events").select("event_id", code.alias("reason_code"), visual.alias("visual"))
    return rows.select(
        "event_id",
        "reason_code",
        codes.spoken_reason(F.col("reason_code"), F.col("visual")).alias("spoken"),
        codes.audio_key(F.col("reason_code"), F.col("visual")).alias("audio_key"),
    )


@query(
    "sync_offset",
    sql(
        "SELECT idx, signal_ts + 60 AS signal_ts, CASE WHEN source = 'hit' THEN signal_ts * 1000000 + 60000000 ELSE 0 END::BIGINT AS signal_mono_ns FROM signals",
        "signals",
    ),
)
def sync_offset(spark, sf):
    mono = F.when(F.col("source") == "hit", F.col("signal_ts") * 1_000_000)
    return src.signals(spark, sf).select(
        "idx",
        (F.col("signal_ts") + 60).alias("signal_ts"),
        F.coalesce(mono + 60 * 1_000_000, F.lit(0)).cast("long").alias("signal_mono_ns"),
    )


SCORE = r"regexp_extract(line, 'Fencer {n}:\s*([^,]*)', 1)"


@query(
    "score_summary",
    sql(
        "SELECT phrase_id, line_no, "
        + ", ".join(f"upper(trim({SCORE.format(n=n)})) = 'HIT' AS {s}_hit" for n, s in ((1, "right"), (2, "left")))
        + " FROM plog WHERE contains(line, 'Scores ->')",
        "plog",
    ),
)
def score_summary(spark, sf):
    hit = lambda n: F.upper(F.trim(F.regexp_extract("line", rf"Fencer {n}:\s*([^,]*)", 1))) == "HIT"
    return (
        src.phrase_log(spark, sf)
        .where(F.col("line").contains("Scores ->"))
        .select("phrase_id", "line_no", hit(1).alias("right_hit"), hit(2).alias("left_hit"))
    )


WINNERS = (" Left ", "RIGHT", "none", "right", "tie")


@query(
    "winner_normalise",
    sql(
        "SELECT event_id, CASE WHEN lower(trim(w)) IN ('left', 'right') THEN lower(trim(w)) WHEN r AND NOT l THEN 'right' WHEN l AND NOT r THEN 'left' END AS winner, "
        "lower(trim(w)) IN ('left', 'right') AS from_analyser FROM "
        f"(SELECT event_id, {_pick_sql(WINNERS, 'event_id')} AS w, event_id % 3 = 0 AS r, event_id % 4 = 0 AS l FROM events)"
    ),
)
def winner_normalise(spark, sf):
    i = F.col("event_id")
    given = codes.normalise_winner(_pick(WINNERS, i))
    return src.table(spark, sf, "events").select(
        "event_id",
        F.coalesce(given, codes.lone_hit(i % 3 == 0, i % 4 == 0)).alias("winner"),
        given.isNotNull().alias("from_analyser"),
    )


# Voice end per user: 3 days after the first frame; some users have a given start frame.
@query(
    "active_rebase",
    sql(
        "SELECT user_id, s.start_frame::BIGINT AS start_frame, (frame - s.start_frame)::BIGINT AS frame, ts FROM frames JOIN s USING (user_id) WHERE frame >= s.start_frame",
        "frames",
        s="SELECT user_id, CASE WHEN user_id % 4 = 0 THEN least(2, count(*)) ELSE coalesce(min(frame) FILTER (ts >= t0 + 259200000), count(*)) END AS start_frame "
        "FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0 FROM frames) GROUP BY user_id",
    ),
)
def active_rebase(spark, sf):
    rows = src.frames(spark, sf)
    first = rows.groupBy("user_id").agg(F.min("ts").alias("t0"), F.count(F.lit(1)).alias("n"))
    voiced = spread_join(rows, first, ["user_id"], F.col("frame"))
    starts = voiced.groupBy("user_id").agg(
        F.min(F.when(F.col("ts") >= F.col("t0") + 259_200_000, F.col("frame"))).alias("at"), F.max("n").alias("n")
    )
    given = F.when(F.col("user_id") % 4 == 0, F.least(F.lit(2), F.col("n")))
    starts = starts.select("user_id", F.coalesce(given, F.col("at"), F.col("n")).alias("start_frame"))
    return (
        spread_join(rows, starts, ["user_id"], F.col("frame"))
        .where(F.col("frame") >= F.col("start_frame"))
        .select(
            "user_id",
            big("start_frame").alias("start_frame"),
            big(F.col("frame") - F.col("start_frame")).alias("frame"),
            "ts",
        )
    )


@query(
    "decision_summary",
    sql(
        "SELECT event_id, 'Winner: ' || w || chr(10) || 'Reason: ' || txt || chr(10) || 'Left pauses: ' || lp || ', Right pauses: ' || rp || chr(10) || "
        "'Blade analysis: ' || w || chr(10) || 'Speed comparison: ' || format('{:.3f}', value * 2) || chr(10) AS summary FROM "
        f"(SELECT event_id, value, {_pick_sql(('left', 'right', 'none'), 'event_id')} AS w, {_pick_sql(REASON_TEXTS, 'event_id')} AS txt, event_id % 4 AS lp, event_id % 3 AS rp FROM events)"
    ),
)
def decision_summary(spark, sf):
    i = F.col("event_id")
    w = _pick(("left", "right", "none"), i)
    text = F.format_string(
        "Winner: %s\nReason: %s\nLeft pauses: %d, Right pauses: %d\nBlade analysis: %s\nSpeed comparison: %.3f\n",
        w, _pick(REASON_TEXTS, i), i % 4, i % 3, w, F.col("value") * 2,
    )
    return src.table(spark, sf, "events").select("event_id", text.alias("summary"))


@query(
    "id_path_checks",
    sql(
        "SELECT page_id, regexp_full_match(path, '[0-9]+') AS id_ok, (starts_with(url, 'https://example.org/') AND NOT contains(url, '..')) AS in_dir, "
        "regexp_full_match(path, '[a-z0-9_]+') AS key_ok FROM (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN page_id::VARCHAR "
        "WHEN 1 THEN '../' || page_id WHEN 2 THEN 'slow_start_' || page_id WHEN 3 THEN page_id || '.5' ELSE '' END AS path FROM pages)"
    ),
)
def id_path_checks(spark, sf):
    p, s = F.col("page_id"), F.col("page_id").cast("string")
    path = (
        F.when(p % 5 == 0, s)
        .when(p % 5 == 1, F.concat(F.lit("../"), s))
        .when(p % 5 == 2, F.concat(F.lit("slow_start_"), s))
        .when(p % 5 == 3, F.concat(s, F.lit(".5")))
        .otherwise("")
    )
    return src.table(spark, sf, "pages").select(
        "page_id",
        path.rlike(r"^[0-9]+$").alias("id_ok"),
        (F.col("url").startswith("https://example.org/") & ~F.col("url").contains("..")).alias("in_dir"),
        path.rlike(r"^[a-z0-9_]+$").alias("key_ok"),
    )


@query(
    "stamp_coalesce",
    sql(
        "SELECT event_id, coalesce(try_cast(a AS BIGINT), try_cast(b AS BIGINT), try_cast(props->>'$.k' AS BIGINT), ms) AS stamp FROM "
        "(SELECT event_id, props, (epoch_us(ts) // 1000) AS ms, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'soon' END AS a, "
        "CASE WHEN event_id % 5 = 0 THEN (event_id * 2)::VARCHAR END AS b FROM events)"
    ),
)
def stamp_coalesce(spark, sf):
    i = F.col("event_id")
    a = F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, "soon")
    b = F.when(i % 5 == 0, (i * 2).cast("string"))
    k = F.get_json_object("props", "$.k")
    return src.table(spark, sf, "events").select(
        "event_id", F.coalesce(*[c.try_cast("bigint") for c in (a, b, k)], src.millis("ts")).alias("stamp")
    )


@query(
    "result_lines",
    sql(
        "SELECT event_id, 'Remote winner: ' || CASE w WHEN 'left' THEN 'Left Fencer (Red Lamp)' WHEN 'right' THEN 'Right Fencer (Green Lamp)' ELSE w END AS winner_line, "
        "'Pi judge result, winner=' || w || CASE WHEN txt <> '' THEN ' (' || txt || ')' ELSE '' END AS summary, "
        "CASE w WHEN 'left' THEN 'Only one light. Left fencer wins.' WHEN 'right' THEN 'Only one light. Right fencer wins.' ELSE 'Only one light recorded.' END AS broadcast FROM "
        f"(SELECT event_id, {_pick_sql(('left', 'right', 'none'), 'event_id')} AS w, {_pick_sql(REASON_TEXTS, 'event_id')} AS txt FROM events)"
    ),
)
def result_lines(spark, sf):
    i = F.col("event_id")
    w, text = _pick(("left", "right", "none"), i), _pick(REASON_TEXTS, i)
    reason = F.when(text != "", F.concat(F.lit(" ("), text, F.lit(")"))).otherwise("")
    return src.table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("Remote winner: "), codes.winner_label(w)).alias("winner_line"),
        F.concat(F.lit("Pi judge result, winner="), w, reason).alias("summary"),
        codes.single_hit_message(w).alias("broadcast"),
    )


@query(
    "result_payload",
    sql(
        "SELECT event_id, '{\"winner\":\"' || w || '\"' || CASE WHEN r IS NOT NULL THEN ',\"reason\":\"' || r || '\",\"natural_language_reason\":\"' || r || '\"' ELSE '' END "
        "|| ',\"result_code\":' || c || CASE WHEN e IS NOT NULL THEN ',\"processing_error\":\"' || e || '\"' ELSE '' END || '}' AS payload FROM "
        f"(SELECT event_id, {_pick_sql(('A', 'B', 'tie'), 'event_id')} AS w, CASE WHEN event_id % 4 <> 0 THEN {_pick_sql(REASON_TEXTS[:5], 'event_id')} END AS r, "
        "CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 9 ELSE 0 END AS c, CASE WHEN event_id % 9 = 0 THEN 'no frames' END AS e FROM events)"
    ),
)
def result_payload(spark, sf):
    """JSON result; keys without a value are left out, the reason is repeated as the spoken one."""
    i = F.col("event_id")
    w = _pick(("A", "B", "tie"), i)
    reason = F.when(i % 4 != 0, _pick(REASON_TEXTS[:5], i))
    body = F.struct(
        w.alias("winner"),
        reason.alias("reason"),
        reason.alias("natural_language_reason"),
        codes.code_of_ab(w).alias("result_code"),
        F.when(i % 9 == 0, "no frames").alias("processing_error"),
    )
    return src.table(spark, sf, "events").select("event_id", F.to_json(body).alias("payload"))


@query(
    "phrase_start_host",
    sql(
        "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id * 7000 + event_id * 1000000 END, CASE WHEN event_id % 4 < 2 THEN (epoch_us(ts) // 1000) * 1000000 END, event_id)::BIGINT AS start_ns FROM events"
    ),
)
def phrase_start_host(spark, sf):
    """Device clock plus offset, else command time, else receipt time."""
    i = F.col("event_id")
    device = F.when(i % 3 == 0, i * 7000 + i * 1_000_000)
    command = F.when(i % 4 < 2, src.millis("ts") * 1_000_000)
    return src.table(spark, sf, "events").select("event_id", F.coalesce(device, command, i).alias("start_ns"))
