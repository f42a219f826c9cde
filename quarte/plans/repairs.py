"""Outlier and repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.operators import repair as rp
from quarte.operators.quantiles import middle
from quarte.plans import views as v
from quarte.plans.registry import big, query, rnd
from quarte.plans.views import sql
from quarte.plans.windows import WIN
from quarte.session import stage
from quarte.sources import adapters as src

SIDE = ["phrase_id", "side"]
S = "phrase_id, side"


def stored_poses(spark, sf):
    return stage(src.poses(spark, sf))


def measure_ctes(source: str, tag: str = "") -> dict[str, str]:
    """CTEs ending in an<tag>: flagged joints."""
    cols = []
    for k in rp.TARGETS:
        d = lambda o: f"sqrt(power(x{k} - {o}(x{k}) {WIN}, 2) + power(y{k} - {o}(y{k}) {WIN}, 2))"
        mid = " + ".join(f"power({a}{k} - 0.5 * (lag({a}{k}) {WIN} + lead({a}{k}) {WIN}), 2)" for a in "xy")
        cols += [f"{d('lag')} AS in_{k}", f"coalesce(greatest({d('lag')}, {d('lead')}), 0) AS step_{k}", f"sqrt({mid}) AS pred_{k}"]
    cols += [f"sqrt(power(x{a} - x{b}, 2) + power(y{a} - y{b}, 2)) AS len_{a}_{b}" for a, b in rp.ALL_BONES]
    moves = [f"{m}_{k}" for m in ("in", "pred") for k in rp.TARGETS]
    lens = [f"len_{a}_{b}" for a, b in rp.ALL_BONES]
    rows = []
    for k in rp.TARGETS:
        st, pr = f"coalesce(lim_in_{k}, 0.3)", f"coalesce(lim_pred_{k}, 0.18)"
        odd = " + ".join(
            f"CASE WHEN lim_len_{a}_{b} > 1e-6 AND (len_{a}_{b} < 0.55 * lim_len_{a}_{b} OR len_{a}_{b} > 1.6 * lim_len_{a}_{b}) THEN 1 ELSE 0 END" for a, b in rp.BONES[k]
        )
        rows.append(
            f"SELECT {S}, frame, {k} AS joint, CASE WHEN x{k} IS NULL THEN NULL WHEN step_{k} >= 1.35 * {st} OR pred_{k} >= 1.35 * {pr} THEN 'strong_temporal_outlier' "
            f"WHEN (step_{k} >= {st} OR pred_{k} >= {pr}) AND {odd} >= 1 THEN 'temporal_plus_bone_outlier' WHEN {odd} >= 2 THEN 'multi_bone_outlier' END AS reason, step_{k} AS max_step, pred_{k} AS pred_error FROM mj{tag}"
        )
    return {
        f"me{tag}": f"SELECT *, {', '.join(cols)} FROM {source}",
        f"md{tag}": f"SELECT {S}, " + ", ".join(f"median({c}) AS md_{c}" for c in moves + lens) + f" FROM me{tag} GROUP BY {S}",
        f"ma{tag}": f"SELECT m.{S.replace(', ', ', m.')}, " + ", ".join(f"median(abs({c} - md_{c})) AS ma_{c}" for c in moves) + f" FROM me{tag} m JOIN md{tag} USING (phrase_id, side) GROUP BY m.phrase_id, m.side",
        f"li{tag}": f"SELECT phrase_id, side, " + ", ".join(f"greatest({0.3 if c[0] == 'i' else 0.18}, md_{c} * 3.0, md_{c} + 4.0 * ma_{c}) AS lim_{c}" for c in moves)
        + ", " + ", ".join(f"md_{c} AS lim_{c}" for c in lens) + f" FROM md{tag} JOIN ma{tag} USING (phrase_id, side)",
        f"mj{tag}": f"SELECT * FROM me{tag} JOIN li{tag} USING (phrase_id, side)",
        f"an{tag}": "SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE reason IS NOT NULL",
    }


# Milder limits than the rules would flag little of the adapter data; the poses
# are used as they are, so flags come from steps and bones that really stand out.
AN = measure_ctes("poses")


@query("bone_medians", sql("SELECT phrase_id, side, bone AS measure, " + v.rnd("med", 5) + " AS med FROM (" + " UNION ALL ".join(f"SELECT phrase_id, side, 'len_{a}_{b}' AS bone, md_len_{a}_{b} AS med FROM md" for a, b in rp.ALL_BONES) + ")", "poses", **AN))
def bone_medians(spark, sf):
    return rp.bone_medians(src.poses(spark, sf)).select(*SIDE, "measure", rnd("med", 5).alias("med"))


@query(
    "mad_threshold",
    sql(f"SELECT series_id, {v.rnd('med', 6)} AS med, {v.rnd('mad', 6)} AS mad, {v.rnd('greatest(0.3, med * 3.0, med + 4.0 * mad)', 6)} AS limit_value FROM (SELECT s.series_id, any_value(med) AS med, median(abs(x - med)) AS mad FROM series s JOIN (SELECT series_id, median(x) AS med FROM series GROUP BY series_id) m ON s.series_id = m.series_id GROUP BY s.series_id)", "series"),
)
def mad_threshold(spark, sf):
    values = src.series(spark, sf).select("series_id", F.col("x").alias("v")).where("v IS NOT NULL")
    rows = rp.outlier_limit(values, ["series_id"], F.lit(rp.STEP_FLOOR))
    return rows.select("series_id", rnd("med", 6).alias("med"), rnd("mad", 6).alias("mad"), rnd("limit", 6).alias("limit_value"))


@query("limb_anomalies", sql(f"SELECT phrase_id, side, frame, joint, reason, {v.rnd('max_step')} AS max_step, {v.rnd('pred_error')} AS pred_error FROM an", "poses", **AN))
def limb_anomalies(spark, sf):
    rows = rp.anomalies(stored_poses(spark, sf))
    return rows.select(*SIDE, "frame", "joint", "reason", rnd("max_step").alias("max_step"), rnd("pred_error").alias("pred_error"))


@query("anomaly_counts", sql("SELECT phrase_id, side, joint::BIGINT AS joint, count(*) AS n_flags FROM an GROUP BY ALL", "poses", **AN))
def anomaly_counts(spark, sf):
    rows = rp.anomalies(stored_poses(spark, sf))
    return rows.groupBy(*SIDE, big("joint").alias("joint")).agg(F.count("frame").alias("n_flags"))


@query("top_frames", sql("SELECT phrase_id, side, frame, n_flags FROM (SELECT phrase_id, side, frame, count(*) AS n_flags, row_number() OVER (PARTITION BY phrase_id, side ORDER BY count(*) DESC, min(joint), frame) AS r FROM an GROUP BY phrase_id, side, frame) WHERE r <= 10", "poses", **AN))
def top_frames(spark, sf):
    """Ten frames with most flags; ties by first seen, joints being scanned in order."""
    from pyspark.sql import Window

    counts = rp.anomalies(stored_poses(spark, sf)).groupBy(*SIDE, "frame").agg(F.count("joint").alias("n_flags"), F.min("joint").alias("first"))
    w = Window.partitionBy(*SIDE).orderBy(F.desc("n_flags"), "first", "frame")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 10").select(*SIDE, "frame", "n_flags")


def limb_of(j: str) -> str:
    return f"CASE WHEN {j} IN (7, 9) THEN 'left_arm' WHEN {j} IN (8, 10) THEN 'right_arm' WHEN {j} IN (13, 15) THEN 'left_leg' ELSE 'right_leg' END"


def run_ctes(flags: str, source: str, key: str, limit: int, tag: str, only: str | None) -> dict[str, str]:
    """CTEs: rl<tag> runs with status, fx<tag> cells to write."""
    keep = f" JOIN {only} USING (phrase_id, side, {key})" if only else ""
    kps = " UNION ALL ".join(f"SELECT phrase_id, side, frame, {k} AS kp, x{k} AS x, y{k} AS y FROM {source}" for k in rp.TARGETS)
    belongs = f"r.{key} = {limb_of('k.kp')}" if key == "limb" else "r.joint = k.kp"
    part = f"OVER (PARTITION BY phrase_id, side, {key} ORDER BY frame)"
    return {
        f"jl{tag}": kps,
        f"fr{tag}": f"SELECT DISTINCT phrase_id, side, {key}, frame FROM {flags}{keep}",
        f"rg{tag}": f"SELECT *, sum(CASE WHEN d <= 2 THEN 0 ELSE 1 END) {part} AS g FROM (SELECT *, frame - lag(frame) {part} AS d FROM fr{tag})",
        f"rr{tag}": f"SELECT phrase_id, side, {key}, min(frame) AS s, max(frame) AS e FROM rg{tag} GROUP BY phrase_id, side, {key}, g",
        f"nn{tag}": f"SELECT phrase_id, side, max(frame) + 1 AS n FROM {source} GROUP BY phrase_id, side",
        f"rk{tag}": f"SELECT r.*, n, k.kp FROM rr{tag} r JOIN nn{tag} USING (phrase_id, side) JOIN (SELECT unnest([{', '.join(map(str, rp.TARGETS))}]) AS kp) k ON {belongs}",
        f"rb{tag}": f"SELECT rk{tag}.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by2 FROM rk{tag} LEFT JOIN jl{tag} a ON a.phrase_id = rk{tag}.phrase_id AND a.side = rk{tag}.side AND a.kp = rk{tag}.kp AND a.frame = s - 1 "
        f"LEFT JOIN jl{tag} b ON b.phrase_id = rk{tag}.phrase_id AND b.side = rk{tag}.side AND b.kp = rk{tag}.kp AND b.frame = e + 1",
        f"rl{tag}": f"SELECT phrase_id, side, {key}, s, e, CASE WHEN e - s + 1 > {limit} THEN 'skipped_long_run' WHEN s <= 0 OR e >= max(n) - 1 THEN 'skipped_edge_run' "
        f"WHEN count(*) FILTER (ax IS NULL OR bx IS NULL) > 0 THEN 'skipped_missing_anchor' ELSE 'interpolated' END AS status FROM rb{tag} GROUP BY phrase_id, side, {key}, s, e",
        f"fx{tag}": f"SELECT phrase_id, side, kp, f AS frame, ax + (bx - ax) * ((f - (s - 1)) / (e + 1 - (s - 1))::DOUBLE) AS nx, ay + (by2 - ay) * ((f - (s - 1)) / (e + 1 - (s - 1))::DOUBLE) AS ny "
        f"FROM (SELECT b.*, unnest(range(b.s, b.e + 1)) AS f FROM rb{tag} b JOIN rl{tag} l ON b.phrase_id = l.phrase_id AND b.side = l.side AND b.{key} = l.{key} AND b.s = l.s WHERE status = 'interpolated')",
        f"fp{tag}": "SELECT phrase_id, side, frame, " + ", ".join(f"max(n{a}) FILTER (kp = {k}) AS n{a}{k}" for k in rp.TARGETS for a in "xy") + f" FROM fx{tag} GROUP BY phrase_id, side, frame",
        f"po{tag}": "SELECT p.* REPLACE (" + ", ".join(f"coalesce(n{a}{k}, {a}{k}) AS {a}{k}" for k in rp.TARGETS for a in "xy") + f") FROM {source} p LEFT JOIN fp{tag} USING (phrase_id, side, frame)",
    }


REPAIR = {
    **AN,
    "anl": f"SELECT *, {limb_of('joint')} AS limb FROM an",
    "act": "SELECT phrase_id, side, limb FROM anl GROUP BY ALL HAVING count(DISTINCT joint) >= 2",
    **run_ctes("anl", "poses", "limb", rp.LIMB_RUN, "1", "act"),
    "pol": "SELECT phrase_id, side, frame, " + ", ".join(f"{a}{k}" for k in range(17) for a in "xy") + " FROM po1",
    **measure_ctes("pol", "2"),
    **run_ctes("an2", "pol", "joint", rp.JOINT_RUN, "2", None),
    "pof": "SELECT phrase_id, side, frame, " + ", ".join(f"{a}{k}" for k in range(17) for a in "xy") + " FROM po2",
    **measure_ctes("pof", "3"),
}


@query(
    "limb_repair",
    sql(
        "SELECT phrase_id, side, limb AS target, s AS start_frame, e AS end_frame, status FROM rl1 UNION ALL SELECT phrase_id, side, 'joint_' || joint, s, e, status FROM rl2",
        "poses", **REPAIR,
    ),
)
def limb_repair(spark, sf):
    done = rp.repair(stored_poses(spark, sf))
    cols = [*SIDE, "target", "start_frame", "end_frame", "status"]
    limbs = done["limb_log"].withColumnRenamed("limb", "target").select(*cols)
    joints = done["joint_log"].withColumn("target", F.concat(F.lit("joint_"), F.col("joint").cast("string"))).select(*cols)
    return limbs.unionByName(joints)


@query(
    "repaired_poses",
    sql("SELECT phrase_id, side, frame, " + ", ".join(f"{v.rnd(f'{a}{k}', 9)} AS {a}{k}" for k in rp.TARGETS for a in "xy") + " FROM pof", "poses", **REPAIR),
)
def repaired_poses(spark, sf):
    done = rp.repair(stored_poses(spark, sf))
    return done["poses"].select(*SIDE, "frame", *[rnd(f"{a}{k}", 9).alias(f"{a}{k}") for k in rp.TARGETS for a in "xy"])


@query(
    "anomaly_before_after",
    sql("SELECT phrase_id, side, coalesce(b, 0) AS before_flags, coalesce(a, 0) AS after_flags FROM (SELECT DISTINCT phrase_id, side FROM poses) LEFT JOIN (SELECT phrase_id, side, count(*) AS b FROM an GROUP BY ALL) USING (phrase_id, side) LEFT JOIN (SELECT phrase_id, side, count(*) AS a FROM an3 GROUP BY ALL) USING (phrase_id, side)", "poses", **REPAIR),
)
def anomaly_before_after(spark, sf):
    poses = stored_poses(spark, sf)
    done = rp.repair(poses)
    both = done["before"].select(*SIDE, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        done["after"].select(*SIDE, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    zero = poses.select(*SIDE, F.lit(0).alias("b"), F.lit(0).alias("a"))
    return both.unionByName(zero).groupBy(*SIDE).agg(F.sum("b").alias("before_flags"), F.sum("a").alias("after_flags"))
