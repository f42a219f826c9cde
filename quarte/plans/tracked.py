"""Tracking queries over detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.operators import tracking as tr, tracks as tk
from quarte.operators.evaluate import top_per_key
from quarte.plans import views as v
from quarte.plans.projections import ARENA, BOOT_SQL, CX_SQL, DETBOX, EDGE_SQL, H, W, bootstrap_rows, boxed, boxed_detections
from quarte.plans.registry import big, query, rnd
from quarte.plans.views import sql
from quarte.session import stage
from quarte.sources import adapters as src

TARGETS = (400, 400, 700, 700), (500, 500, 800, 800)


def target_score(t) -> str:
    box = dict(zip(("bx1", "by1", "bx2", "by2"), t))
    iou = v.iou("", "t.")
    for k, c in box.items():
        iou = iou.replace(f"t.{k}", f"{c}.0::DOUBLE")
    cx, cy = (t[0] + t[2]) / 2, (t[1] + t[3]) / 2
    return f"coalesce({iou} - 0.25 * sqrt(power({cx} - (bx1 + bx2) / 2.0, 2) + power({cy} - (by1 + by2) / 2.0, 2)) / {ARENA.diag!r}::DOUBLE, -1)"


@query(
    "box_match",
    sql(
        "SELECT phrase_id, frame, CASE WHEN l1 = r1 AND coalesce(ls2 > 0, false) THEN l2 ELSE l1 END::BIGINT AS left_idx, CASE WHEN l1 = r1 AND NOT coalesce(ls2 > 0, false) THEN r2 ELSE r1 END::BIGINT AS right_idx FROM "
        "(SELECT phrase_id, frame, "
        + ", ".join(f"max(det_idx) FILTER ({t}r = {n}) AS {t}{n}, max({t}s) FILTER ({t}r = {n}) AS {t}s{n}" for t in "lr" for n in (1, 2))
        + " FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id, frame ORDER BY ls DESC, det_idx) AS lr, row_number() OVER (PARTITION BY phrase_id, frame ORDER BY rs DESC, det_idx) AS rr FROM "
        f"(SELECT phrase_id, frame, det_idx, {target_score(TARGETS[0])} AS ls, {target_score(TARGETS[1])} AS rs FROM det)) GROUP BY phrase_id, frame) "
        "WHERE ls1 > 0 AND rs1 > 0 AND (l1 <> r1 OR coalesce(ls2 > 0, false) OR coalesce(rs2 > 0, false))",
        "detections", **DETBOX,
    ),
)
def box_match(spark, sf):
    rows = tr.match_targets(boxed_detections(spark, sf), *TARGETS, ARENA)
    return rows.select("phrase_id", "frame", big("left_idx").alias("left_idx"), big("right_idx").alias("right_idx"))


REC = {**DETBOX, "rec": f"SELECT phrase_id, (frame // 3)::INT AS frame, (frame % 3)::INT AS slot, {v.box()} FROM pixels WHERE side = 'right'"}


@query(
    "det_dedup_iou",
    sql(f"SELECT phrase_id, frame, slot FROM rec r WHERE NOT EXISTS (SELECT 1 FROM det e WHERE e.phrase_id = r.phrase_id AND e.frame = r.frame AND {v.iou('r.', 'e.')} > 0.7)", "detections", "pixels", **REC),
)
def det_dedup_iou(spark, sf):
    """Right poses stand for detections recovered in the frame."""
    recovered = boxed(spark, sf).where("side = 'right'").selectExpr("phrase_id", "int(frame div 3) AS frame", "int(frame % 3) AS slot", *tr.BOX)
    return tr.drop_duplicates_by_iou(recovered, boxed_detections(spark, sf)).select("phrase_id", "frame", "slot")


GAPS = ", ".join(f"CASE WHEN {v.ok(a)} AND {v.ok(b)} THEN {v.dist(a, b)} END" for i, a in enumerate((5, 6, 11, 12)) for b in (5, 6, 11, 12)[i + 1 :])
PREP = {
    "prep": f"SELECT phrase_id, frame, det_idx, {', '.join(v.COORDS)}, {v.box()}, {v.descriptor()}, coalesce({v.mean(v.joint_list('x'))}, 0) AS cx, coalesce({v.mean(v.joint_list('y'))}, 0) AS cy, coalesce(greatest({GAPS}), 1.0) AS scale FROM detections",
}
LOGR = "abs(ln(greatest(da / greatest(ta, 1.0), 1e-6)))"


@query(
    "det_track_costs",
    sql(
        "SELECT phrase_id, frame, det_idx, track_id, "
        + v.rnd(
            f"CASE WHEN posture IS NULL THEN 0.7 * kpt / scale + 0.2 * boxc + 0.1 * motion ELSE 0.45 * kpt / scale + 0.35 * posture + 0.12 * boxc + 0.08 * motion END + 0.4 * {LOGR} + 0.55 * coalesce(posture, 1.0) "
            f"+ 0.35 * greatest(0, CASE WHEN track_id = 0 THEN (cxm - {W / 2}) ELSE ({W / 2} - cxm) END / {W / 2}) + 0.1 * CASE WHEN abs(cxm - {W / 2}) >= {ARENA.deadzone} THEN 0 ELSE ({ARENA.deadzone} - abs(cxm - {W / 2})) / {ARENA.deadzone} END + 0.3 * edge"
        )
        + f" AS cost FROM (SELECT d.phrase_id, d.frame, d.det_idx, t.det_idx AS track_id, {v.kp_gap('d.', 't.')} AS kpt, {v.descriptor_gap('d.', 't.')} AS posture, 1 - ({v.iou('d.', 't.')}) AS boxc, t.scale, "
        f"sqrt(power((d.bx1 + d.bx2) / 2.0 - t.cx, 2) + power((d.by1 + d.by2) / 2.0 - t.cy, 2)) / {ARENA.diag!r}::DOUBLE AS motion, (d.bx2 - d.bx1) * (d.by2 - d.by1) AS da, (t.bx2 - t.bx1) * (t.by2 - t.by1) AS ta, "
        f"(d.bx1 + d.bx2) / 2.0::DOUBLE AS cxm, {EDGE_SQL.replace('bx', 'd.bx').replace('by', 'd.by')} AS edge FROM prep d JOIN prep t ON t.phrase_id = d.phrase_id AND t.frame = d.frame - 1 AND t.det_idx < 2) WHERE da > 0",
        "detections", **PREP,
    ),
)
def det_track_costs(spark, sf):
    """The first two detections of the frame before stand for the tracks."""
    rows = prepared(spark, sf)
    tracks = rows.where("det_idx < 2").withColumnRenamed("det_idx", "track_id")
    return tr.pair_costs(rows, tracks, ARENA).withColumn("cost", rnd("cost"))


REF = {
    **PREP,
    "refp": "SELECT a0 AS ra0, " + ", ".join(f"{c} AS ref_{c}" for c in tr.DESC) + " FROM prep WHERE phrase_id = 0 AND frame = 0 AND det_idx = 0",
    "cand": f"SELECT *, CASE WHEN {CX_SQL} < {W / 2} THEN 'left' ELSE 'right' END AS half, (bx2 - bx1) * (by2 - by1) AS area FROM prep WHERE bx1 > {ARENA.edge} AND bx2 < {W - ARENA.edge} AND by1 > {ARENA.top} AND by2 < {H - ARENA.bottom}",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY phrase_id, frame, half ORDER BY area DESC, det_idx) AS r FROM cand",
    "gapped": f"SELECT phrase_id, frame, half, det_idx, area, {v.descriptor_gap('ranked.', 'refp.ref_')} AS gap FROM ranked, refp WHERE r <= 3",
}


def prepared(spark, sf):
    """Prepared detections as a stored table: they are read more than once, and a
    filter on a box must not be pushed into the joint expressions."""
    return stage(tr.prepared(src.detections(spark, sf)))


def reference_row(spark, sf):
    return tr.prepared(src.detections(spark, sf).where("phrase_id = 0 AND frame = 0 AND det_idx = 0"))


@query(
    "top_candidates",
    sql("SELECT phrase_id, frame, half, det_idx::BIGINT AS det_idx FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id, frame, half ORDER BY coalesce(gap, 1e300), area DESC, det_idx) AS k FROM gapped) WHERE k = 1", "detections", **REF),
)
def top_candidates(spark, sf):
    rows = tr.top_candidates(prepared(spark, sf), reference_row(spark, sf), ARENA)
    return rows.select("phrase_id", "frame", "half", big("det_idx").alias("det_idx"))


@query(
    "reference_posture",
    sql(f"SELECT phrase_id, frame, det_idx, {v.rnd(v.descriptor_gap('prep.', 'refp.ref_'))} AS gap FROM prep, refp", "detections", **REF),
)
def reference_posture(spark, sf):
    from quarte.functions import geometry as g

    rows = prepared(spark, sf)
    # One reference row: a broadcast of fixed size.
    ref = F.broadcast(reference_row(spark, sf).limit(1).select(*[F.col(c).alias(f"ref_{c}") for c in tr.DESC]))
    return g.with_descriptor_gap(rows.join(ref), "gap", "", "ref_").select("phrase_id", "frame", "det_idx", rnd("gap").alias("gap"))


def members(spark, sf):
    """Candidates with the detection slot as the cluster."""
    return bootstrap_rows(spark, sf).withColumn("cluster", F.col("det_idx"))


def totals(spark, sf):
    return src.detections(spark, sf).groupBy("phrase_id").agg((F.max("frame") + 1).alias("total_frames"))


SUMS = {
    **BOOT_SQL,
    "tf": "SELECT phrase_id, max(frame) + 1 AS total FROM detections GROUP BY phrase_id",
    "cs": "SELECT phrase_id, side, det_idx AS cluster, count(*) AS members, count(DISTINCT frame) AS frames, median(bottom_n) AS mb, median(ankle_n) AS ma, median(knee_n) AS mk, median(hip_n) AS mh, median(quality) AS mq, median(area) AS mr, median(cpen) AS mc, median(small) AS ms, median(raw) AS mw FROM booted GROUP BY phrase_id, side, det_idx",
    "su": "SELECT *, frames / total AS persistence, 0.55 * mb + 0.2 * ma + 0.1 * mk + 0.1 * mq + 0.05 * mr + 0.2 * frames / total - 0.08 * mc - 0.05 * ms AS score FROM cs JOIN tf USING (phrase_id)",
}


@query(
    "cluster_summary",
    sql(f"SELECT phrase_id, side, cluster, members::BIGINT AS members, frames, {v.rnd('persistence')} AS persistence, {v.rnd('mw')} AS median_raw_score, {v.rnd('mh')} AS median_hip, {v.rnd('score')} AS score FROM su", "detections", **SUMS),
)
def cluster_summary(spark, sf):
    rows = tr.cluster_summary(stage(members(spark, sf)), totals(spark, sf))
    return rows.select(
        "phrase_id", "side", "cluster", "members", "frames", rnd("persistence").alias("persistence"), rnd("median_raw_score").alias("median_raw_score"),
        rnd("median_hip_y_norm").alias("median_hip"), rnd("score").alias("score"),
    )


@query("top_clusters", sql("SELECT phrase_id, side, cluster FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id, side ORDER BY round(score, 9) DESC, cluster) AS r FROM su) WHERE r <= 3", "detections", **SUMS))
def top_clusters(spark, sf):
    rows = tr.cluster_summary(stage(members(spark, sf)), totals(spark, sf)).withColumn("score", rnd("score", 9))
    return top_per_key(rows, ["phrase_id", "side"], [F.desc("score"), F.asc("cluster")], 3).select("phrase_id", "side", "cluster")


@query(
    "bootstrap_pairs",
    sql(
        f"SELECT p.phrase_id, lc AS left_cluster, rc AS right_cluster, common, p.frame::BIGINT AS frame, {v.rnd('l.score + r.score + 0.15 * common / l.total')} AS pair_score FROM "
        "(SELECT a.phrase_id, a.det_idx AS lc, b.det_idx AS rc, count(*) AS common, arg_max(a.frame, round(a.raw + b.raw, 12) * 1e6 - a.frame * 1e-7) AS frame FROM booted a JOIN booted b ON a.phrase_id = b.phrase_id AND a.frame = b.frame AND a.side = 'left' AND b.side = 'right' GROUP BY ALL) p "
        "JOIN su l ON l.phrase_id = p.phrase_id AND l.side = 'left' AND l.cluster = lc JOIN su r ON r.phrase_id = p.phrase_id AND r.side = 'right' AND r.cluster = rc",
        "detections", **SUMS,
    ),
)
def bootstrap_pairs(spark, sf):
    rows = stage(members(spark, sf))
    pairs = tr.cluster_pairs(rows, tr.cluster_summary(rows, totals(spark, sf)))
    return pairs.select("phrase_id", "left_cluster", "right_cluster", "common", big("frame").alias("frame"), rnd("pair_score").alias("pair_score"))


@query("bootstrap_clusters")
def bootstrap_clusters(spark, sf):
    return tr.bootstrap_clusters(bootstrap_rows(spark, sf), ARENA)


@query("track_two")
def track_two(spark, sf):
    return tr.track(src.detections(spark, sf), tr.TrackRules(ARENA))


@query("track_jump_safe")
def track_jump_safe(spark, sf):
    return tr.track(src.detections(spark, sf), tr.jump_safe(ARENA))


@query("backfill_tracks")
def backfill_tracks(spark, sf):
    """Tracks followed backwards from the last frame."""
    return tr.track(src.detections(spark, sf), tr.TrackRules(ARENA), backwards=True)
