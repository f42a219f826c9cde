"""Detection geometry: boxes, zones, match costs and bootstrap scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarte.functions import geometry as g


@dataclass(frozen=True)
class Arena:
    """Frame size and the zone margins derived from it."""

    width: int
    height: int
    edge_frac: float = 0.06
    top_frac: float = 0.12
    bottom_frac: float = 0.20
    sigma_frac: float = 0.22
    deadzone_frac: float = 0.06

    @property
    def diag(self) -> float:
        return (self.width**2 + self.height**2) ** 0.5

    @property
    def edge(self) -> int:
        return int(self.width * self.edge_frac)

    @property
    def top(self) -> int:
        return int(self.height * self.top_frac)

    @property
    def bottom(self) -> int:
        return int(self.height * self.bottom_frac)

    @property
    def deadzone(self) -> float:
        return self.width * self.deadzone_frac

    @property
    def sigma(self) -> float:
        return self.width * self.sigma_frac


def with_box(df, prefix: str = ""):
    """Add bx1, by1, bx2, by2 with the prefix."""
    names = [f"{prefix}b{n}" for n in ("x1", "y1", "x2", "y2")]
    return df.withColumns(dict(zip(names, g.bbox(prefix))))


def box(prefix: str = ""):
    return tuple(F.col(f"{prefix}b{n}") for n in ("x1", "y1", "x2", "y2"))


def pad_box(b, width: int, height: int, pad_fraction: float):
    """Grow a box by max(24, fraction of its longer side) and clip it to the frame."""
    bw, bh = F.greatest(F.lit(1.0), b[2] - b[0]), F.greatest(F.lit(1.0), b[3] - b[1])
    pad = F.greatest(F.lit(24.0), F.greatest(bw, bh) * pad_fraction)
    return (
        F.greatest(F.lit(0), F.floor(b[0] - pad)),
        F.greatest(F.lit(0), F.floor(b[1] - pad)),
        F.least(F.lit(width), F.ceil(b[2] + pad)),
        F.least(F.lit(height), F.ceil(b[3] + pad)),
    )


def edge_penalty(b, a: Arena) -> Column:
    over = g.total(
        [
            F.greatest(F.lit(0.0), c.cast("double"))
            for c in (a.edge - b[0], b[2] - (a.width - a.edge), a.top - b[1], b[3] - (a.height - a.bottom))
        ]
    )
    return F.when(b[0].isNull(), F.lit(1.0)).otherwise(over / float(max(a.width, a.height, 1)))


def center_penalty(cx: Column, a: Arena) -> Column:
    gap = F.abs(cx - a.width / 2.0)
    return F.when(gap >= a.deadzone, F.lit(0.0)).otherwise((a.deadzone - gap) / a.deadzone)


def side_penalty(track: Column, cx: Column, a: Arena) -> Column:
    half = a.width / 2.0
    wrong = F.when(track == 0, cx - half).otherwise(half - cx)
    return F.greatest(F.lit(0.0), wrong / half)


def center_safe(c, a: Arena) -> Column:
    return F.abs(c[0] - a.width / 2.0) >= a.deadzone


def edge_safe(c, a: Arena) -> Column:
    return (c[0] >= a.edge) & (c[0] <= a.width - a.edge) & (c[1] >= a.top) & (c[1] <= a.height - a.bottom)


def box_edge_safe(b, a: Arena) -> Column:
    inside = (b[0] > a.edge) & (b[2] < a.width - a.edge) & (b[1] > a.top) & (b[3] < a.height - a.bottom)
    return F.coalesce(inside, F.lit(False))


def init_score(c, side: str, a: Arena) -> Column:
    half = a.width / 2.0
    gauss = F.exp(F.lit(-0.5) * F.pow(F.abs(c[0] - half) / a.sigma, F.lit(2.0)))
    right_half = c[0] < half if side == "left" else c[0] >= half
    score = gauss + F.when(right_half, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(edge_safe(c, a) & center_safe(c, a), score).otherwise(F.lit(-1e9))


def track_cost(kpt_gap, det_box, prev_box, pred_center, scale, posture, diag: float) -> Column:
    """Soft cost of a detection against a track; NULL when no joint is shared."""
    boxed = det_box[0].isNotNull() & prev_box[0].isNotNull()
    box_cost = F.when(boxed, 1.0 - g.box_iou(det_box, prev_box)).otherwise(F.lit(0.5))
    motion = F.coalesce(g.distance(g.box_center(det_box), pred_center) / diag, F.lit(0.0))
    kpt = kpt_gap / F.when(scale > 0, scale).otherwise(F.lit(1.0))
    plain = 0.7 * kpt + 0.2 * box_cost + 0.1 * motion
    full = 0.45 * kpt + 0.35 * posture + 0.12 * box_cost + 0.08 * motion
    return F.when(posture.isNull(), plain).otherwise(full)


def log_ratio(a: Column, b: Column) -> Column:
    """Absolute log of an area ratio, areas of at least one pixel below the line."""
    return F.abs(F.ln(F.greatest(a / F.greatest(b, F.lit(1.0)), F.lit(1e-6))))


def match_cost(base, area, prev_area, anchor_posture, anchor_area, side, center, edge) -> Column:
    """Track cost with the penalties of identity matching."""
    return (
        base
        + 0.20 * log_ratio(area, prev_area)
        + 0.35 * side
        + 0.10 * center
        + 0.30 * edge
        + 0.55 * F.coalesce(anchor_posture, F.lit(1.0))
        + 0.20 * log_ratio(area, anchor_area)
    )


def box_match_score(target, b, diag: float) -> Column:
    """Overlap less a quarter of the centre distance; -1 without a box."""
    gap = g.distance(g.box_center(target), g.box_center(b)) / max(diag, 1.0)
    return F.coalesce(g.box_iou(target, b) - 0.25 * gap, F.lit(-1.0))


def bootstrap(df, a: Arena):
    """Score boxed detections as starting candidates and keep the usable ones."""
    points, b = g.pose(), box()
    width, height = float(a.width), float(a.height)

    def share(ids) -> Column:
        return g.total([F.when(points[k][0].isNotNull(), 1.0).otherwise(0.0) for k in ids]) / float(len(ids))

    def lowest(i, j, fallback) -> Column:
        return F.coalesce(F.greatest(points[i][1], points[j][1]), fallback)

    gap = F.abs((b[0] + b[2]) * 0.5 - width / 2)
    dead = width * 0.04
    mx, my = max(1.0, width * 0.03), max(1.0, height * 0.05)
    measured = df.withColumns(
        {
            "_w": (b[2] - b[0]).cast("double"),
            "_h": (b[3] - b[1]).cast("double"),
            "pose_quality": 0.5 * share((11, 12, 13, 14, 15, 16)) + 0.3 * share((5, 6)) + 0.2 * share((15, 16)),
            "_ankle": lowest(15, 16, b[3]),
            "center_penalty": F.when(gap < dead, (dead - gap) / max(dead, 1.0)).otherwise(F.lit(0.0)),
            "side": F.when((b[0] + b[2]) * 0.5 < width / 2, "left").otherwise("right"),
        }
    ).where(
        (F.col("_w") >= 20)
        & (F.col("_h") >= 60)
        & (b[0] > mx)
        & (b[2] < width - mx)
        & (b[1] > my)
        & (b[3] < height - my)
        & (b[3] >= height * 0.22)
        & (F.col("pose_quality") >= 0.15)
    )
    kneed = measured.withColumn("_knee", lowest(13, 14, F.col("_ankle")))
    normed = kneed.withColumns(
        {
            "bottom_y_norm": b[3] / height,
            "ankle_y_norm": F.col("_ankle") / height,
            "knee_y_norm": F.col("_knee") / height,
            "hip_y_norm": lowest(11, 12, F.col("_knee")) / height,
            "area_score": F.least(F.lit(1.0), F.col("_w") * F.col("_h") / (max(width * height, 1.0) * 0.10)),
            "small_penalty": F.greatest(F.lit(0.0), (height * 0.16 - F.col("_h")) / max(height * 0.16, 1.0)),
        }
    )
    depth = (
        0.55 * F.col("bottom_y_norm")
        + 0.25 * F.col("ankle_y_norm")
        + 0.15 * F.col("knee_y_norm")
        + 0.05 * F.col("area_score")
    )
    raw = (
        F.col("depth_score")
        + 0.20 * F.col("pose_quality")
        - 0.08 * F.col("center_penalty")
        - 0.05 * F.col("small_penalty")
    )
    return (
        normed.withColumn("depth_score", depth)
        .withColumn("raw_score", raw)
        .drop("_w", "_h", "_ankle", "_knee")
    )
