"""Two-identity tracking of detections over the frames of a phrase.

Tracking is sequential by nature: the state at a frame depends on the frame
before. Spark partitions by phrase and sorts by frame; each task streams its
rows through a small tracker, so memory does not grow with the phrase. The
geometry of a detection (box, centre, scale, descriptor) is computed as Column
expressions before the Python step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarte.functions import geometry as g
from quarte.operators import tracks as tk
from quarte.operators.tracks import Arena

POINTS = [f"{a}{k}" for a in "xy" for k in g.JOINTS]
DESC = [f"a{i}" for i in range(10)] + [f"r{i}" for i in range(10)]
BOX = ["bx1", "by1", "bx2", "by2"]
COLUMNS = [*POINTS, *BOX, "cx", "cy", "scale", *DESC]
OUTPUT = "phrase_id int, frame int, track_id int, det_idx int, observed boolean"


def prepared(detections: DataFrame) -> DataFrame:
    """Detections with box, centroid, torso scale and descriptor."""
    rows = g.with_descriptor(tk.with_box(g.only_valid(detections)))
    cx, cy = g.centroid(g.pose())
    rows = rows.withColumns({"cx": cx, "cy": cy, "scale": g.torso_scale(g.pose())})
    return rows.select("phrase_id", "frame", "det_idx", *COLUMNS)


@dataclass(frozen=True)
class TrackRules:
    """Tracker thresholds; ``gated`` adds the jump limits."""

    arena: Arena
    gated: bool = False
    active: float = 1.85
    recovering: float = 2.35
    reacquire: float = 3.2
    unmatched: float = 2.8
    crossing: float = 0.9
    max_miss: int = 45


def jump_safe(arena: Arena) -> TrackRules:
    return TrackRules(arena, gated=True, active=1.35, recovering=1.85, reacquire=2.35)


class Detection:
    """One prepared detection row as arrays."""

    __slots__ = ("idx", "pts", "box", "center", "mean", "scale", "desc", "area")

    def __init__(self, idx: int, row: np.ndarray):
        self.idx = idx
        self.pts = row[:34].reshape(2, 17)
        self.box = row[34:38]
        self.center = (self.box[:2] + self.box[2:]) / 2
        self.mean, self.scale, self.desc = row[38:40], row[40], row[41:61]
        self.area = float((self.box[2] - self.box[0]) * (self.box[3] - self.box[1]))


@dataclass
class Track:
    now: Detection
    anchor: Detection
    before: np.ndarray | None = None

    def expected(self) -> np.ndarray:
        return self.now.mean if self.before is None else 2 * self.now.mean - self.before


def posture_gap(p: np.ndarray, q: np.ndarray) -> float:
    """Mean descriptor gap over shared features, NaN under six."""
    turn = np.abs(p[:10] - q[:10])
    with np.errstate(divide="ignore", invalid="ignore"):
        gaps = np.concatenate([np.minimum(turn, 2 * math.pi - turn) / math.pi, np.abs(np.log(p[10:] / q[10:]))])
    gaps = gaps[np.isfinite(gaps)]
    return float(gaps.mean()) if len(gaps) >= 6 else math.nan


def joint_gap(p: Detection, q: Detection, joints=slice(None)) -> float:
    d = np.hypot(*(p.pts[:, joints] - q.pts[:, joints]))
    d = d[np.isfinite(d)]
    return float(d.mean()) if len(d) else math.nan


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    w = np.maximum(0, np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2]))
    inter = float(w[0] * w[1])
    union = float(np.prod(a[2:] - a[:2]) + np.prod(b[2:] - b[:2])) - inter
    return inter / union if union > 0 else 0.0


def area_gap(a: float, b: float) -> float:
    return abs(math.log(max(a / max(b, 1.0), 1e-6)))


@dataclass
class Tracker:
    """State of one phrase: two tracks, their last lost forms and miss counts."""

    rules: TrackRules
    tracks: list = field(default_factory=lambda: [None, None])
    lost: list = field(default_factory=lambda: [None, None])
    misses: list = field(default_factory=lambda: [0, 0])
    started: bool = False

    def zone_cost(self, tid: int, d: Detection) -> float:
        a, half = self.rules.arena, self.rules.arena.width / 2
        side = max(0.0, (d.center[0] - half) / half * (1 if tid == 0 else -1))
        gap = abs(d.center[0] - half)
        center = max(0.0, (a.deadzone - gap) / a.deadzone)
        over = np.maximum(0, [a.edge - d.box[0], d.box[2] - (a.width - a.edge), a.top - d.box[1], d.box[3] - (a.height - a.bottom)])
        return 0.35 * side + 0.10 * center + 0.30 * float(over.sum()) / max(a.width, a.height)

    def cost(self, tid: int, t: Track, d: Detection) -> float:
        """Soft match cost, infinite when the detection cannot be this track."""
        kpt = joint_gap(d, t.now)
        if not (d.area > 0 and np.isfinite(kpt)) or (self.rules.gated and self.rejected(tid, t, d)):
            return math.inf
        kpt /= t.now.scale if t.now.scale > 0 else 1.0
        box = 1.0 - overlap(d.box, t.now.box)
        motion = float(np.hypot(*(d.center - t.expected()))) / self.rules.arena.diag
        posture = posture_gap(d.desc, t.now.desc)
        if math.isnan(posture):
            base = 0.7 * kpt + 0.2 * box + 0.1 * motion
        else:
            base = 0.45 * kpt + 0.35 * posture + 0.12 * box + 0.08 * motion
        anchor = posture_gap(d.desc, t.anchor.desc)
        base += 0.55 * (1.0 if math.isnan(anchor) else anchor)
        return base + 0.20 * area_gap(d.area, t.now.area) + 0.20 * area_gap(d.area, t.anchor.area) + self.zone_cost(tid, d)

    def rejected(self, tid: int, t: Track, d: Detection) -> bool:
        """Hard limits on jumps of centre, torso, area, posture and joints."""
        w, h = np.maximum(t.now.box[2:] - t.now.box[:2], 1.0)
        diag, miss = max(math.hypot(w, h), 1.0), self.misses[tid]
        px, frac = 18.0 * miss, 0.10 * miss
        dx, dy = np.abs(d.center - t.expected())
        torso, posture = joint_gap(d, t.now, list(g.TORSO)), posture_gap(d.desc, t.now.desc)
        ratio = max(d.area / max(t.now.area, 1.0), max(t.now.area, 1.0) / max(d.area, 1.0))
        kpt = joint_gap(d, t.now) / max(t.now.scale, 1.0)
        bonus = 0.22 if miss > 0 and overlap(t.now.box, d.box) >= 0.25 else 0.0
        return bool(
            math.hypot(dx, dy) > max(72.0 + px, diag * (0.42 + frac))
            or dy > max(52.0 + px, h * (0.34 + frac))
            or dx > max(96.0 + px, w * (0.70 + frac))
            or torso > max(44.0 + px, diag * (0.36 + frac))
            or abs(math.log(max(ratio, 1e-6))) > 0.75 + 0.18 * miss
            or posture > 1.05 + 0.12 * miss
            or kpt > 0.95 + 0.10 * miss + bonus
        )

    def start(self, dets: list[Detection]) -> None:
        """Largest edge-safe detection of each half of the frame."""
        a, half = self.rules.arena, self.rules.arena.width / 2
        inside = [
            d for d in dets
            if d.box[0] > a.edge and d.box[2] < a.width - a.edge and d.box[1] > a.top and d.box[3] < a.height - a.bottom
        ]
        sides = [[d for d in inside if d.center[0] < half], [d for d in inside if d.center[0] >= half]]
        if all(sides):
            self.seed(*(max(s, key=lambda d: d.area) for s in sides))

    def seed(self, left: Detection, right: Detection) -> None:
        self.tracks = [Track(left, left), Track(right, right)]
        self.lost, self.misses, self.started = [None, None], [0, 0], True

    def assign(self, dets: list[Detection]) -> dict[int, Detection]:
        """Cheapest joint assignment of both tracks, unmatched or crossing at a price."""
        r = self.rules
        none = [(None, r.unmatched)]
        options = []
        for tid, t in enumerate(self.tracks):
            if t is None:
                options.append([(None, 0.0)])
                continue
            limit = r.recovering if self.misses[tid] else r.active
            priced = sorted(((d, self.cost(tid, t, d)) for d in dets), key=lambda item: item[1])
            options.append(none + [(d, c) for d, c in priced if c <= limit])
        best, chosen = math.inf, (None, None)
        for left, lc in options[0]:
            for right, rc in options[1]:
                if left is not None and left is right:
                    continue
                total = lc + rc
                if left is not None and right is not None:
                    over = left.center[0] - right.center[0] - 0.02 * r.arena.width
                    total += r.crossing * max(0.0, over) / max(0.25 * r.arena.width, 1.0)
                if total < best:
                    best, chosen = total, (left, right)
        return {tid: d for tid, d in enumerate(chosen) if d is not None}

    def miss(self, tid: int) -> None:
        if self.tracks[tid] is not None:
            self.misses[tid] += 1
            if self.misses[tid] > self.rules.max_miss:
                self.lost[tid], self.tracks[tid] = self.tracks[tid], None

    def skip(self, frames: int) -> None:
        """Frames without any detection."""
        for _ in range(min(frames, self.rules.max_miss + 1)):
            for tid in (0, 1):
                self.miss(tid)

    def update(self, dets: list[Detection]) -> dict[int, Detection]:
        """Observed detection per track in this frame."""
        if not self.started:
            self.start(dets)
            return {tid: t.now for tid, t in enumerate(self.tracks) if t is not None}
        chosen = self.assign(dets)
        for tid in (0, 1):
            t = self.tracks[tid]
            if tid in chosen:
                t.before, t.now = t.now.mean, chosen[tid]
                self.lost[tid], self.misses[tid] = None, 0
            else:
                self.miss(tid)
        for tid in (0, 1):
            if self.tracks[tid] is None:
                used = [d.idx for d in chosen.values()]
                free = [d for d in dets if d.idx not in used]
                old = self.lost[tid]
                price = (lambda d: self.cost(tid, old, d)) if old else (lambda d: self.zone_cost(tid, d))
                costs = [(price(d), d) for d in free]
                if costs:
                    c, d = min(costs, key=lambda item: item[0])
                    if c <= self.rules.reacquire:
                        self.tracks[tid] = Track(d, old.anchor if old else d)
                        self.misses[tid], chosen[tid] = 0, d
        return chosen


def run_rows(batches: Iterator[pd.DataFrame], rules: TrackRules, backwards: bool = False) -> Iterator[pd.DataFrame]:
    """Track rows sorted by phrase and frame. Holds one frame and one tracker."""
    phrase, frame, dets, tracker = None, None, [], None
    out: list[tuple] = []

    def close() -> None:
        seen = tracker.update(dets)
        for tid in (0, 1):
            d = seen.get(tid)
            out.append((phrase, frame, tid, d.idx if d else None, d is not None))

    for pdf in batches:
        values = pdf[COLUMNS].to_numpy(dtype=float)
        for p, f, i, row in zip(pdf["phrase_id"], pdf["frame"], pdf["det_idx"], values):
            if (p, f) != (phrase, frame):
                if tracker is not None:
                    close()
                if p != phrase:
                    tracker = Tracker(rules)
                elif tracker.started:
                    tracker.skip(abs(int(f) - int(frame)) - 1)
                phrase, frame, dets = p, f, []
            if np.isfinite(row[34]):
                dets.append(Detection(int(i), row))
        if out:
            yield as_rows(out)
            out.clear()
    if tracker is not None:
        close()
        yield as_rows(out)


def as_rows(rows: list[tuple]) -> pd.DataFrame:
    columns = ["phrase_id", "frame", "track_id", "det_idx", "observed"]
    return pd.DataFrame(rows, columns=columns).astype({"det_idx": "Int32"})


def track(detections: DataFrame, rules: TrackRules, backwards: bool = False) -> DataFrame:
    """Tracks per frame: phrase_id, frame, track_id, det_idx (NULL when unseen), observed."""
    order = F.desc("frame") if backwards else F.asc("frame")
    rows = prepared(detections).repartition("phrase_id").sortWithinPartitions("phrase_id", order, "det_idx")
    return rows.mapInPandas(lambda batches: run_rows(batches, rules, backwards), OUTPUT)


def pair_costs(detections: DataFrame, tracks: DataFrame, arena: Arena) -> DataFrame:
    """Cost of every detection against the tracks of the frame before.

    Both inputs are prepared rows; ``tracks`` has track_id instead of det_idx."""
    det = detections.select("phrase_id", "frame", "det_idx", *[F.col(c).alias(f"d_{c}") for c in COLUMNS])
    old = tracks.select("phrase_id", (F.col("frame") + 1).alias("frame"), "track_id", *[F.col(c).alias(f"t_{c}") for c in COLUMNS])
    rows = det.join(old, ["phrase_id", "frame"])
    rows = g.with_keypoint_gap(rows, "kpt", "d_", "t_")
    rows = g.with_descriptor_gap(rows, "posture", "d_", "t_")
    d, t = tk.box("d_"), tk.box("t_")
    center = g.box_center(d)
    base = tk.track_cost(F.col("kpt"), d, t, (F.col("t_cx"), F.col("t_cy")), F.col("t_scale"), F.col("posture"), arena.diag)
    area, prev = g.box_area(d), g.box_area(t)
    cost = tk.match_cost(
        base, area, prev, F.col("posture"), prev,
        tk.side_penalty(F.col("track_id"), center[0], arena), tk.center_penalty(center[0], arena), tk.edge_penalty(d, arena),
    )
    return rows.where(area > 0).select("phrase_id", "frame", "det_idx", "track_id", cost.alias("cost"))


def match_targets(detections: DataFrame, left: tuple, right: tuple, arena: Arena) -> DataFrame:
    """Detections for two target boxes per frame; on a collision the left target
    takes its second best, else the right one does."""
    lit = lambda b: tuple(F.lit(float(c)) for c in b)
    scored = detections.select(
        "phrase_id", "frame", "det_idx",
        F.inline(
            F.array(
                F.struct(F.lit("l").alias("target"), tk.box_match_score(lit(left), tk.box(), arena.diag).alias("score")),
                F.struct(F.lit("r").alias("target"), tk.box_match_score(lit(right), tk.box(), arena.diag).alias("score")),
            )
        ),
    )
    w = Window.partitionBy("phrase_id", "frame", "target").orderBy(F.desc("score"), "det_idx")
    top = scored.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    pick = lambda t, r, c: F.max(F.when((F.col("target") == t) & (F.col("rank") == r), F.col(c)))
    wide = top.groupBy("phrase_id", "frame").agg(
        *[pick(t, r, c).alias(f"{t}{r}_{c}") for t in "lr" for r in (1, 2) for c in ("det_idx", "score")]
    )
    clash = F.col("l1_det_idx") == F.col("r1_det_idx")
    second_left, second_right = F.col("l2_score") > 0, F.col("r2_score") > 0
    good = (F.col("l1_score") > 0) & (F.col("r1_score") > 0) & (
        ~clash | F.coalesce(second_left, F.lit(False)) | F.coalesce(second_right, F.lit(False))
    )
    return wide.where(good).select(
        "phrase_id", "frame",
        F.when(clash & second_left, F.col("l2_det_idx")).otherwise(F.col("l1_det_idx")).alias("left_idx"),
        F.when(clash & ~F.coalesce(second_left, F.lit(False)), F.col("r2_det_idx")).otherwise(F.col("r1_det_idx")).alias("right_idx"),
    )


def drop_duplicates_by_iou(recovered: DataFrame, existing: DataFrame, limit: float = 0.7) -> DataFrame:
    """Recovered detections that overlap no existing one of the frame too much."""
    old = existing.select(*[F.col(c).alias(f"e_{c}") for c in ("phrase_id", "frame", *BOX)])
    same = (F.col("phrase_id") == F.col("e_phrase_id")) & (F.col("frame") == F.col("e_frame"))
    return recovered.join(old, same & (g.box_iou(tk.box(), tk.box("e_")) > limit), "left_anti")


def top_candidates(detections: DataFrame, reference: DataFrame, arena: Arena) -> DataFrame:
    """Per frame and half: the three largest edge-safe detections, then the one
    closest to the reference posture (larger area on a tie).

    ``reference`` is one prepared row; without a usable posture distance the
    largest area wins."""
    half = F.when(g.box_center(tk.box())[0] < arena.width / 2, "left").otherwise("right")
    rows = detections.where(tk.box_edge_safe(tk.box(), arena)).withColumns({"half": half, "area": g.box_area(tk.box())})
    w = Window.partitionBy("phrase_id", "frame", "half").orderBy(F.desc("area"), "det_idx")
    rows = rows.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    # One reference row: a broadcast of fixed size.
    ref = F.broadcast(reference.limit(1).select(*[F.col(c).alias(f"ref_{c}") for c in DESC]))
    rows = g.with_descriptor_gap(rows.join(ref), "gap", "", "ref_")
    best = F.min(F.struct(F.coalesce("gap", F.lit(float("inf"))).alias("gap"), (-F.col("area")).alias("neg"), "det_idx"))
    out = rows.groupBy("phrase_id", "frame", "half").agg(best.alias("b"))
    return out.select("phrase_id", "frame", "half", "b.det_idx", F.when(F.col("b.gap") < float("inf"), F.col("b.gap")).alias("gap"))


SCORES = (
    "bottom_y_norm", "ankle_y_norm", "knee_y_norm", "hip_y_norm", "pose_quality", "area_score", "center_penalty",
    "small_penalty", "raw_score",
)


def cluster_summary(members: DataFrame, totals: DataFrame) -> DataFrame:
    """Medians, persistence and score per cluster (phrase_id, side, cluster).

    ``totals`` gives total_frames per phrase."""
    from quarte.operators.quantiles import middle

    keys = ["phrase_id", "side", "cluster"]
    items = ", ".join(f"named_struct('measure', '{c}', 'v', double({c}))" for c in SCORES)
    long = members.selectExpr(*keys, f"inline(array({items}))")
    med = middle(long, [*keys, "measure"], F.col("v"), "v")
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == c, F.col("v"))).alias(f"median_{c}") for c in SCORES])
    frames = members.groupBy(*keys, "frame").agg(F.count("det_idx").alias("m"))
    sizes = frames.groupBy(*keys).agg(F.sum("m").alias("members"), F.count("frame").alias("frames"))
    rows = wide.join(sizes, keys).join(totals, "phrase_id")
    m = lambda c: F.col(f"median_{c}")
    rows = rows.withColumn("persistence", F.col("frames") / F.greatest("total_frames", F.lit(1)))
    score = (
        0.55 * m("bottom_y_norm") + 0.20 * m("ankle_y_norm") + 0.10 * m("knee_y_norm") + 0.10 * m("pose_quality")
        + 0.05 * m("area_score") + 0.20 * F.col("persistence") - 0.08 * m("center_penalty") - 0.05 * m("small_penalty")
    )
    return rows.withColumn("score", score)


def cluster_pairs(members: DataFrame, summary: DataFrame) -> DataFrame:
    """Left and right clusters that share frames: pair score and best shared frame."""
    best = members.groupBy("phrase_id", "side", "cluster", "frame").agg(F.max("raw_score").alias("raw"))
    side = lambda s: best.where(F.col("side") == s).select(
        "phrase_id", "frame", F.col("cluster").alias(f"{s}_cluster"), F.col("raw").alias(f"{s}_raw")
    )
    shared = side("left").join(side("right"), ["phrase_id", "frame"])
    top = F.max(F.struct((F.col("left_raw") + F.col("right_raw")).alias("raw"), (-F.col("frame")).alias("neg")))
    keys = ["phrase_id", "left_cluster", "right_cluster"]
    pairs = shared.groupBy(*keys).agg(F.count("frame").alias("common"), (-top["neg"]).alias("frame"))
    score = lambda s: summary.where(F.col("side") == s).select(
        "phrase_id", F.col("cluster").alias(f"{s}_cluster"), F.col("score").alias(f"{s}_score"), F.col("total_frames").alias(f"{s}_total")
    )
    rows = pairs.join(score("left"), ["phrase_id", "left_cluster"]).join(score("right"), ["phrase_id", "right_cluster"])
    pair = F.col("left_score") + F.col("right_score") + 0.15 * F.col("common") / F.greatest("left_total", F.lit(1))
    return rows.select(*keys, "common", "frame", pair.alias("pair_score"))


def bootstrap_clusters(candidates: DataFrame, arena: Arena, frames: int = 8) -> DataFrame:
    """Greedy clusters of starting candidates over the opening frames of a phrase.

    The opening is a handful of frames by definition, so a group is small."""
    cols = ["phrase_id", "frame", "det_idx", "side", *BOX, "raw_score"]
    opening = candidates.where(F.col("frame") < frames).select(*cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[dict] = []
        ids = []
        pdf = pdf.sort_values(["frame", "det_idx"])
        for r in pdf.itertuples():
            b = np.array([r.bx1, r.by1, r.bx2, r.by2], dtype=float)
            c = (b[:2] + b[2:]) / 2
            best, at = -math.inf, None
            for i, k in enumerate(found):
                if k["side"] != r.side or not 0 < r.frame - k["frame"] <= 2:
                    continue
                iou, gap = overlap(b, k["box"]), float(np.hypot(*(c - k["center"]))) / arena.diag
                if (iou >= 0.10 or gap <= 0.08) and iou - 0.6 * gap > best:
                    best, at = iou - 0.6 * gap, i
            if at is None:
                at = len(found)
                found.append({"side": r.side})
            found[at].update(frame=r.frame, box=b, center=c)
            ids.append(at)
        return pdf.assign(cluster=ids)[["phrase_id", "frame", "det_idx", "side", "cluster"]]

    return opening.groupBy("phrase_id").applyInPandas(grow, "phrase_id int, frame int, det_idx int, side string, cluster int")
