"""Joins, aggregates and decisions at phrase level."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.functions import geometry as g
from quarte.operators import contacts as ct, decide as dc, intervals as iv, motion
from quarte.operators.series import overlap_join, spread_join
from quarte.plans import views as v
from quarte.plans.projections import WRIST
from quarte.plans.registry import big, query, rnd
from quarte.plans.views import sql
from quarte.plans.windows import DIR, WIN, arm_ctes, island, lunge_ctes, pause_ctes
from quarte.session import stage
from quarte.sources import adapters as src, phrases as ph

SIDE = ["phrase_id", "side"]
R, FPS = ph.RULES, ph.FPS
FACTS = {
    "facts": "SELECT *, least(left_hit, right_hit) AS first_hit, least(left_hit, right_hit) / 30.0::DOUBLE AS hit_time, lockout / 30.0::DOUBLE AS lock_s FROM info",
    "ev": "SELECT p.* FROM poses p JOIN hits h USING (phrase_id, side) WHERE frame <= hit_frame",
}
BASE = ("poses", "hits", "info", "contacts")
SLOW = f"(start_frame <= {R.slow_start_frame} AND end_frame - start_frame + 1 < {int(FPS * R.slow_start_seconds)})"


def stored_poses(spark, sf):
    """The adapter poses as a stored table, as a pose archive would be."""
    return stage(src.poses(spark, sf))


def eval_poses(spark, sf):
    return dc.truncate(stored_poses(spark, sf), dc.cutoffs(ph.facts(spark, sf)))


@query(
    "hit_rollup",
    sql(
        "SELECT phrase_id, min(hit_frame)::BIGINT AS first_hit, count(DISTINCT least(greatest(hit_frame, 0), n - 1)) AS n_frames, "
        f"{v.rnd('min(hit_frame) / 30.0')} AS hit_time FROM hits JOIN info USING (phrase_id) GROUP BY phrase_id",
        "hits", "info",
    ),
)
def hit_rollup(spark, sf):
    rows = ph.hits(spark, sf).join(ph.info(spark, sf).select("phrase_id", "n"), "phrase_id")
    rows = rows.withColumn("at", F.greatest(F.lit(0), F.least("hit_frame", F.col("n") - 1)))
    distinct = rows.groupBy("phrase_id", "at").agg(F.min("hit_frame").alias("hit_frame"))
    first = F.min("hit_frame")
    return distinct.groupBy("phrase_id").agg(
        big(first).alias("first_hit"), F.count("at").alias("n_frames"), rnd(first / FPS).alias("hit_time")
    )


A2_SQL = {
    "a2p": f"SELECT *, lag(x16) {WIN} AS px, lag(y16) {WIN} AS py FROM poses WHERE x16 IS NOT NULL AND y16 IS NOT NULL",
    "a2s": "SELECT *, sqrt(power(x16 - px, 2) + power(y16 - py, 2)) AS d FROM a2p",
    "a2c": f"SELECT *, abs(d - lag(d) {WIN}) AS c FROM a2s",
    "a2": "SELECT phrase_id, side, coalesce(avg(d), 0) AS speed, coalesce(avg(c), 0) AS change FROM a2c GROUP BY phrase_id, side",
}


@query("speed_base", sql(f"SELECT phrase_id, side, {v.rnd('speed')} AS speed, {v.rnd('change')} AS change FROM a2", "poses", **A2_SQL))
def speed_base(spark, sf):
    rows = motion.mean_speed_base(src.poses(spark, sf))
    return rows.select(*SIDE, rnd("speed").alias("speed"), rnd("change").alias("change"))


def a3_ctes(source: str, tag: str = "") -> dict[str, str]:
    vals = (
        f"SELECT phrase_id, side, 1 AS part, frame, x16 AS v FROM {source} WHERE x16 IS NOT NULL UNION ALL "
        f"SELECT phrase_id, side, 2, frame, {v.torso('x')} FROM {source} WHERE {v.torso('x')} IS NOT NULL"
    )
    return {
        f"a3v{tag}": vals,
        f"a3s{tag}": f"SELECT *, abs(v - lag(v) OVER (PARTITION BY phrase_id, side, part ORDER BY frame)) AS d FROM a3v{tag}",
        f"a3c{tag}": f"SELECT *, abs(d - lag(d) OVER (PARTITION BY phrase_id, side ORDER BY part, frame)) AS c FROM a3s{tag} WHERE d IS NOT NULL",
        f"a3{tag}": f"SELECT phrase_id, side, avg(d) AS speed, avg(c) AS change FROM a3c{tag} GROUP BY phrase_id, side",
    }


@query("speed_fps30", sql(f"SELECT phrase_id, side, {v.rnd('speed')} AS speed, {v.rnd('change')} AS change FROM a3", "poses", **a3_ctes("poses")))
def speed_fps30(spark, sf):
    rows = motion.mean_speed(src.poses(spark, sf))
    return rows.select(*SIDE, rnd("speed").alias("speed"), rnd("change").alias("change"))


VAR_SQL = {
    "ce": "SELECT phrase_id, coalesce(contact_2, contact_1) AS event_frame, n FROM info",
    "vw": "SELECT phrase_id, side, CASE WHEN side = 'left' THEN x10 ELSE x9 END AS x, CASE WHEN side = 'left' THEN y10 ELSE y9 END AS y "
    "FROM poses JOIN ce USING (phrase_id) WHERE frame BETWEEN event_frame - 8 AND event_frame + 3",
    "vs": "SELECT phrase_id, side, count(*) AS samples, coalesce(var_samp(x), 0) + coalesce(var_samp(y), 0) AS variance FROM vw WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL",
    "vv": "SELECT phrase_id, coalesce(max(samples) FILTER (side = 'left'), 0) AS left_samples, coalesce(max(samples) FILTER (side = 'right'), 0) AS right_samples, "
    "coalesce(max(variance) FILTER (side = 'left'), 0) AS left_variance, coalesce(max(variance) FILTER (side = 'right'), 0) AS right_variance FROM ce LEFT JOIN vs USING (phrase_id) GROUP BY phrase_id",
}


@query(
    "contact_variance",
    sql(
        f"SELECT phrase_id, left_samples, right_samples, {v.rnd('left_variance')} AS left_variance, {v.rnd('right_variance')} AS right_variance, "
        "CASE WHEN left_variance > right_variance THEN 'left' ELSE 'right' END AS free_winner, CASE WHEN left_variance > 0.01 THEN 'left' ELSE 'right' END AS left_winner FROM vv",
        "poses", "info", **VAR_SQL,
    ),
)
def contact_variance(spark, sf):
    rows = dc.contact_variance(src.poses(spark, sf), ph.events(spark, sf))
    return rows.select(
        "phrase_id",
        "left_samples",
        "right_samples",
        rnd("left_variance").alias("left_variance"),
        rnd("right_variance").alias("right_variance"),
        dc.variance_winner(F.lit("none"), 0.01).alias("free_winner"),
        dc.variance_winner(F.lit("left"), 0.01).alias("left_winner"),
    )


J5_SQL = {
    **FACTS,
    "sc": "SELECT phrase_id, arg_max(frame, line_no) AS contact_frame, arg_max(time_s, line_no) AS contact_time FROM contacts JOIN facts USING (phrase_id) "
    "WHERE time_s >= hit_time - 1.0 AND time_s < hit_time AND (lock_s IS NULL OR time_s < lock_s) AND frame <= first_hit GROUP BY phrase_id",
}


@query("contact_window", sql(f"SELECT phrase_id, contact_frame::BIGINT AS contact_frame, {v.rnd('contact_time')} AS contact_time FROM sc", *BASE, **J5_SQL))
def contact_window(spark, sf):
    rows = dc.select_contact(ph.contacts(spark, sf), ph.facts(spark, sf), R.contact_seconds)
    return rows.select("phrase_id", big("contact_frame").alias("contact_frame"), rnd("contact_time").alias("contact_time"))


PV = {**FACTS, **pause_ctes(R.pause, "ev", "v"), "pp": f"SELECT * FROM pzv WHERE NOT {SLOW}", "ss": f"SELECT DISTINCT phrase_id, side FROM pzv WHERE {SLOW}"}
J6_SQL = {
    "pf": "SELECT phrase_id, side, unnest(range(start_frame, end_frame + 1)) AS f FROM pp",
    "pt": "SELECT phrase_id, count(DISTINCT f) FILTER (side = 'left') AS lt, count(DISTINCT f) FILTER (side = 'right') AS rt FROM pf GROUP BY phrase_id",
    "pl": "SELECT phrase_id, max(end_frame) FILTER (side = 'left') AS le, max(end_frame) FILTER (side = 'right') AS re FROM pp GROUP BY phrase_id",
    "po": "SELECT phrase_id, count(*) AS shared FROM (SELECT phrase_id, f FROM pf WHERE side = 'left' INTERSECT SELECT phrase_id, f FROM pf WHERE side = 'right') GROUP BY phrase_id",
    "ov": "SELECT phrase_id, lt, rt, le, re, coalesce(shared, 0) AS shared, "
    f"coalesce(lt > 0 AND rt > 0 AND lt < {FPS * R.overlap_seconds} AND rt < {FPS * R.overlap_seconds} AND coalesce(shared, 0) / greatest(lt, rt) >= {R.overlap_share} AND abs(le - re) <= {R.overlap_end_gap}, false) AS overlap_ok "
    "FROM pt JOIN pl USING (phrase_id) LEFT JOIN po USING (phrase_id)",
}


def eval_pauses(spark, sf):
    found = iv.slow_starts(iv.pauses(eval_poses(spark, sf), R.pause, FPS), R, FPS)
    return found.where(~F.col("is_slow_start"))


@query(
    "pause_overlap",
    sql("SELECT phrase_id, coalesce(lt, 0)::BIGINT AS left_paused, coalesce(rt, 0)::BIGINT AS right_paused, shared::BIGINT AS shared, overlap_ok FROM ov", *BASE, **PV, **J6_SQL),
)
def pause_overlap(spark, sf):
    rows = dc.pause_overlap(eval_pauses(spark, sf), R, FPS)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("phrase_id", zero("left_paused"), zero("right_paused"), zero("shared"), "overlap_ok")


@query(
    "pause_markers",
    sql("SELECT phrase_id, side, max(end_frame)::BIGINT AS last_end, min(start_frame) FILTER (end_frame = m)::BIGINT AS last_start FROM (SELECT *, max(end_frame) OVER (PARTITION BY phrase_id, side) AS m FROM pp) GROUP BY phrase_id, side", *BASE, **PV),
)
def pause_markers(spark, sf):
    rows = dc.latest_pauses(eval_pauses(spark, sf))
    return rows.select(*SIDE, big("last_end").alias("last_end"), big("last_start").alias("last_start"))


@query(
    "frame_intersect",
    sql("SELECT phrase_id, f::BIGINT AS frame FROM pf WHERE side = 'left' INTERSECT SELECT phrase_id, f::BIGINT FROM pf WHERE side = 'right'", *BASE, **PV, **J6_SQL),
)
def frame_intersect(spark, sf):
    frames = eval_pauses(spark, sf).select(*SIDE, F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    side = lambda s: frames.where(F.col("side") == s).select("phrase_id", big("frame").alias("frame"))
    return side("left").intersect(side("right"))


@query("distinct_frames", sql("SELECT DISTINCT phrase_id, f::BIGINT AS frame FROM pf", *BASE, **PV, **J6_SQL))
def distinct_frames(spark, sf):
    frames = eval_pauses(spark, sf).select("phrase_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return frames.select("phrase_id", big("frame").alias("frame")).distinct()


HARM_SQL = {
    **lunge_ctes("ev", "hits", "v"),
    **arm_ctes("ev", "hits", "v"),
    "harm": "SELECT phrase_id, side, 'harmful_arm_extension' AS type, start_frame, end_frame FROM axv WHERE overlong OR early_end UNION ALL "
    "SELECT phrase_id, side, 'harmful_lunge', start_frame, end_frame FROM lgv WHERE is_penalizing",
}


def eval_harm(spark, sf):
    rows = eval_poses(spark, sf)
    hits = ph.hits(spark, sf)
    return dc.harmful(iv.arm_extensions(rows, hits, R.arm), iv.lunges(rows, hits, R.lunge, R.pause, FPS))


WINDOW_SQL = {"win": "SELECT phrase_id, side, n // 4 AS w_start, hit_frame AS w_end FROM hits JOIN info USING (phrase_id)"}


@query(
    "harm_in_window",
    sql("SELECT phrase_id, count(*) AS n_harm FROM harm JOIN win USING (phrase_id, side) WHERE end_frame >= w_start AND start_frame <= w_end GROUP BY phrase_id", *BASE, **FACTS, **HARM_SQL, **WINDOW_SQL),
)
def harm_in_window(spark, sf):
    return dc.harm_in_windows(eval_harm(spark, sf), ph.attack_spans(spark, sf))


@query(
    "hits_in_interval",
    sql("SELECT phrase_id, side, core_start::BIGINT AS core_start, n_hits, last_hit::BIGINT AS last_hit FROM hhv", *BASE, **FACTS, **lunge_ctes("poses", "hits", "v")),
)
def hits_in_interval(spark, sf):
    spans = iv.expand_cores(src.poses(spark, sf), R.lunge)
    rows = iv.hits_in(spans, ph.hits(spark, sf), [*SIDE, "core_start"], R.lunge.hit_grace)
    return rows.select(*SIDE, big("core_start").alias("core_start"), "n_hits", big("last_hit").alias("last_hit"))


EVENT_SQL = {
    **PV,
    **HARM_SQL,
    "evs": "SELECT phrase_id, side, CASE WHEN is_retreat THEN 'retreat' ELSE 'pause' END AS type, start_frame, end_frame, end_frame AS until, 0 AS ord FROM pp UNION ALL "
    "SELECT phrase_id, side, type, start_frame, end_frame, end_frame + 6, CASE type WHEN 'harmful_lunge' THEN 1 ELSE 2 END FROM harm",
    "evt": "SELECT * FROM evs QUALIFY rank() OVER (PARTITION BY phrase_id ORDER BY until DESC, start_frame DESC) = 1",
    "lat": "SELECT phrase_id, CASE WHEN count(DISTINCT side) > 1 THEN 'tie' ELSE max(side) END AS loser, CASE WHEN count(DISTINCT side) = 1 AND max(side) = 'right' THEN 'left' ELSE 'right' END AS right_of_way, "
    "max(until) AS until_frame, CASE WHEN count(DISTINCT side) > 1 THEN 'tie' ELSE arg_min(type, ord) END AS event_type FROM evt GROUP BY phrase_id",
}


@query("event_union", sql("SELECT phrase_id, side, type, start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame FROM evs", *BASE, **EVENT_SQL))
def event_union(spark, sf):
    kinds = eval_pauses(spark, sf).withColumn("type", F.when(F.col("is_retreat"), "retreat").otherwise("pause"))
    cols = [*SIDE, "type", "start_frame", "end_frame"]
    rows = kinds.select(*cols).unionByName(eval_harm(spark, sf))
    return rows.select(*SIDE, "type", big("start_frame").alias("start_frame"), big("end_frame").alias("end_frame"))


@query("latest_event", sql("SELECT phrase_id, loser, right_of_way, until_frame::BIGINT AS until_frame, event_type FROM lat", *BASE, **EVENT_SQL))
def latest_event(spark, sf):
    rows = dc.latest_event(eval_pauses(spark, sf), eval_harm(spark, sf), R)
    return rows.withColumn("until_frame", big("until_frame"))


@query(
    "trim_phrase",
    sql(
        "SELECT phrase_id, count(*) FILTER (frame <= n // 2) AS kept, max(frame) FILTER (frame <= n // 2)::BIGINT AS last_contact, "
        f"{v.rnd('max(CASE WHEN first_hit <= n // 2 THEN hit_time END)')} AS hit_time, {v.rnd('max(CASE WHEN lockout <= n // 2 THEN lock_s END)')} AS lockout "
        "FROM facts LEFT JOIN contacts USING (phrase_id) GROUP BY phrase_id",
        *BASE, facts=FACTS["facts"],
    ),
)
def trim_phrase(spark, sf):
    """Facts of phrases cut at half their frames: later contacts, hits and lockouts are dropped."""
    facts = ph.facts(spark, sf).withColumn("max_frame", F.expr("int(n div 2)"))
    cut = F.col("max_frame") / FPS
    keep = F.col("frame") <= F.col("max_frame")
    rows = spread_join(ph.contacts(spark, sf), facts.select("phrase_id", "max_frame"), ["phrase_id"], F.col("line_no"))
    kept = rows.where(keep).groupBy("phrase_id").agg(F.count("frame").alias("kept"), F.max("frame").alias("last_contact"))
    return facts.join(kept, "phrase_id", "left").select(
        "phrase_id",
        F.coalesce("kept", F.lit(0)).alias("kept"),
        big("last_contact").alias("last_contact"),
        rnd(F.when(F.col("hit_time") <= cut, F.col("hit_time"))).alias("hit_time"),
        rnd(F.when(F.col("lockout") <= cut, F.col("lockout"))).alias("lockout"),
    )


@query("cutoff_truncate", sql("SELECT phrase_id, side, frame, x16 FROM ev", *BASE, **FACTS))
def cutoff_truncate(spark, sf):
    return eval_poses(spark, sf).select(*SIDE, "frame", "x16")


def contact_ctes(events: str, tag: str = "") -> dict[str, str]:
    """CTEs ending in cj<tag>: features and calls per phrase. ``events`` has phrase_id, event_frame, n."""
    c = R.contact
    wx = f"CASE WHEN {WRIST} THEN x10 ELSE x9 END"
    wy = wx.replace("x10 ELSE x9", "y10 ELSE y9")
    body = f"abs({v.mean(v.joint_list('y', joints=(15, 16), need='axis'))} - {v.mean(v.joint_list('y', joints=(5, 6), need='axis'))})"
    grad = lambda a: (
        f"CASE WHEN frame = 0 THEN (lead({a}) {WIN} - {a}) * 30 WHEN frame = last THEN ({a} - lag({a}) {WIN}) * 30 ELSE (lead({a}) {WIN} - lag({a}) {WIN}) * 15 END AS v{a}"
    )
    near = lambda s, x, center, lo, hi: f"avg({x}) FILTER (side = '{s}' AND frame BETWEEN {center} + {lo} AND {center} + {hi})"
    pre, post = "greatest(0, event_frame - 4)", "least(n - 1, event_frame + 4)"
    cols = []
    for s in ("left", "right"):
        cols += [
            f"{near(s, 'wrist_fwd', 'event_frame', -8, -4)} AS {s}_fwd_pre",
            f"{near(s, 'wrist_speed', 'event_frame', 2, 6)} AS {s}_speed_post",
            f"{near(s, 'ahead', pre, -2, 2)} AS {s}_ahead_pre",
            f"{near(s, 'ahead', 'event_frame', -1, 1)} AS {s}_ahead_evt",
            f"{near(s, 'ahead', post, -2, 2)} AS {s}_ahead_post",
            f"{near(s, 'torso_fwd', 'event_frame', -1, 1)} AS {s}_torso_evt",
            f"{near(s, 'torso_fwd', pre, -2, 2)} AS {s}_torso_pre",
            f"{near(s, 'wrist_speed', 'event_frame', -1, 1)} AS {s}_wrist_speed_evt",
            f"{near(s, 'wrist_ratio', 'event_frame', -1, 1)} AS {s}_wrist_ratio_evt",
            f"{near(s, 'wrist_fwd', 'event_frame', -1, 1)} AS {s}_wrist_fwd_evt",
        ]
    e, p, q = "delta_ahead_evt", "delta_ahead_pre", "delta_ahead_post"
    return {
        f"m1{tag}": f"SELECT phrase_id, side, frame, max(frame) OVER (PARTITION BY phrase_id, side) AS last, {wx} AS wx, {wy} AS wy, {v.torso('x', need='axis')} AS tx, {v.torso('y', need='axis')} AS ty, {body} AS body FROM pixels",
        f"m2{tag}": f"SELECT *, {', '.join(grad(a) for a in ('wx', 'wy', 'tx', 'ty'))} FROM m1{tag}",
        f"m3{tag}": f"SELECT *, {DIR} * (wx - tx) / (body + 1e-6) AS ahead, {DIR} * vtx AS torso_fwd, {DIR} * vwx AS wrist_fwd, sqrt(vwx * vwx + vwy * vwy) AS wrist_speed, "
        f"sqrt(vwx * vwx + vwy * vwy) / (sqrt(vtx * vtx + vty * vty) + 1e-6) AS wrist_ratio FROM m2{tag}",
        f"cf{tag}": f"SELECT phrase_id, max(event_frame) AS event_frame, {', '.join(cols)} FROM m3{tag} JOIN {events} USING (phrase_id) GROUP BY phrase_id",
        f"cd{tag}": f"SELECT *, {', '.join(f'left_{f} - right_{f} AS delta_{f}' for f in ct.BENEFIT)}, least(left_fwd_pre, right_fwd_pre) AS min_fwd_pre, greatest(left_speed_post, right_speed_post) AS max_speed_post FROM cf{tag}",
        f"ca{tag}": f"SELECT *, min_fwd_pre - ({c.wrist_forward}) AS wrist_margin, coalesce(max_speed_post, {c.wrist_speed}) - {c.wrist_speed} AS speed_margin, "
        f"CASE WHEN {e} IS NOT NULL AND {p} IS NOT NULL AND {q} IS NOT NULL THEN {c.threshold} - ({e} + {c.pre_weight} * {p} + {c.post_weight} * {q}) "
        f"WHEN {e} IS NOT NULL AND {p} IS NOT NULL THEN {c.legacy_threshold} - ({e} + {c.legacy_pre_weight} * {p}) "
        f"WHEN {e} IS NOT NULL AND {q} IS NOT NULL THEN {c.threshold} - ({e} + {c.post_weight} * {q}) WHEN {e} IS NOT NULL THEN {c.threshold} - {e} "
        f"WHEN {p} IS NOT NULL THEN {c.legacy_threshold} - {c.legacy_pre_weight} * {p} WHEN {q} IS NOT NULL THEN {c.threshold} - {c.post_weight} * {q} END AS score, "
        f"CASE WHEN {e} IS NOT NULL AND {p} IS NOT NULL AND {q} IS NOT NULL THEN 'ahead_evt_pre_post_score' WHEN {e} IS NOT NULL AND {p} IS NOT NULL THEN 'ahead_evt_pre_legacy_fallback' "
        f"WHEN {e} IS NOT NULL AND {q} IS NOT NULL THEN 'ahead_evt_post_score' WHEN {e} IS NOT NULL THEN 'ahead_evt_only_nan_pre' WHEN {p} IS NOT NULL THEN 'ahead_pre_only_nan_evt' "
        f"WHEN {q} IS NOT NULL THEN 'ahead_post_only_nan_evt' ELSE 'torso_fallback_nan_ahead' END AS method FROM cd{tag}",
        f"cj{tag}": "SELECT *, coalesce(wrist_margin >= 0 AND speed_margin >= 0, false) AS is_accident, "
        "CASE WHEN coalesce(wrist_margin >= 0 AND speed_margin >= 0, false) THEN CASE WHEN least(wrist_margin, speed_margin / 100) >= 2 THEN 'high' ELSE 'medium' END ELSE 'low' END AS accident_confidence, "
        "CASE WHEN score IS NULL THEN CASE WHEN coalesce(delta_torso_evt < 0, false) THEN 'left' ELSE 'right' END WHEN score > 0 THEN 'left' ELSE 'right' END AS benefit_side, "
        f"CASE WHEN abs(score) >= {c.high_margin} THEN 'high' WHEN abs(score) >= {c.margin} THEN 'medium' ELSE 'low' END AS benefit_confidence, "
        f"coalesce(1 / (1 + exp(-score / {c.scale})), 0.5) AS prob_left FROM ca{tag}",
    }


CJ = {"ce": VAR_SQL["ce"], **contact_ctes("ce")}
BENEFIT_COLS = [f"delta_{f}" for f in ct.BENEFIT] + ["left_ahead_evt", "right_ahead_evt", "left_torso_evt", "right_torso_evt"]


def contact_rows(spark, sf):
    return ct.contact_features(ct.contact_motion(src.pixel_poses(spark, sf), ph.events(spark, sf), FPS))


@query("contact_features_benefit", sql(f"SELECT phrase_id, event_frame::BIGINT AS event_frame, {', '.join(f'{v.rnd(c, 3)} AS {c}' for c in BENEFIT_COLS)} FROM cd", "pixels", "info", **CJ))
def contact_features_benefit(spark, sf):
    return contact_rows(spark, sf).select("phrase_id", big("event_frame").alias("event_frame"), *[rnd(c, 3).alias(c) for c in BENEFIT_COLS])


ACC_COLS = ["left_fwd_pre", "right_fwd_pre", "min_fwd_pre", "left_speed_post", "right_speed_post", "max_speed_post"]


@query("contact_features_accident", sql(f"SELECT phrase_id, {', '.join(f'{v.rnd(c, 3)} AS {c}' for c in ACC_COLS)} FROM cd", "pixels", "info", **CJ))
def contact_features_accident(spark, sf):
    return contact_rows(spark, sf).select("phrase_id", *[rnd(c, 3).alias(c) for c in ACC_COLS])


@query("accident_contact", sql(f"SELECT phrase_id, is_accident, accident_confidence, {v.rnd('wrist_margin', 3)} AS wrist_margin, {v.rnd('speed_margin', 3)} AS speed_margin FROM cj", "pixels", "info", **CJ))
def accident_contact(spark, sf):
    rows = contact_rows(spark, sf).withColumns(ct.accident(R.contact))
    return rows.select("phrase_id", "is_accident", "accident_confidence", rnd("wrist_margin", 3).alias("wrist_margin"), rnd("speed_margin", 3).alias("speed_margin"))


@query("benefit_side", sql(f"SELECT phrase_id, benefit_side, method, benefit_confidence, {v.rnd('score')} AS score, {v.rnd('prob_left')} AS prob_left FROM cj", "pixels", "info", **CJ))
def benefit_side(spark, sf):
    rows = contact_rows(spark, sf).withColumns(ct.benefit(R.contact))
    return rows.select("phrase_id", "benefit_side", F.col("benefit_method").alias("method"), "benefit_confidence", rnd("benefit_score").alias("score"), rnd("prob_left").alias("prob_left"))


@query(
    "contact_case",
    sql(
        "SELECT phrase_id, is_accident, benefit_side, CASE WHEN is_accident THEN 'Accident classifier triggered; treat this blade contact as non-decisive and continue with the no-blade-contact path.' "
        "ELSE 'Non-accident blade contact; benefit classifier favors ' || benefit_side || ' (' || benefit_confidence || ' confidence).' END AS rationale FROM cj",
        "pixels", "info", **CJ,
    ),
)
def contact_case(spark, sf):
    rows = ct.judge_contacts(src.pixel_poses(spark, sf), ph.events(spark, sf), R.contact, FPS)
    favoured = F.concat(
        F.lit("Non-accident blade contact; benefit classifier favors "), "benefit_side", F.lit(" ("), "benefit_confidence", F.lit(" confidence).")
    )
    accident = F.lit(
        "Accident classifier triggered; treat this blade contact as non-decisive and continue with the no-blade-contact path."
    )
    return rows.select("phrase_id", "is_accident", "benefit_side", F.when(F.col("is_accident"), accident).otherwise(favoured).alias("rationale"))


def _fill(c: str) -> str:
    up = f"OVER (PARTITION BY phrase_id, side ORDER BY frame)"
    down = "OVER (PARTITION BY phrase_id, side ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    f = f"CASE WHEN {c} IS NOT NULL THEN frame END"
    return (
        f"last_value({f} IGNORE NULLS) {up} AS bf_{c}, last_value({c} IGNORE NULLS) {up} AS bv_{c}, "
        f"first_value({f} IGNORE NULLS) {down} AS af_{c}, first_value({c} IGNORE NULLS) {down} AS av_{c}"
    )


FILL = ["x5", "x6", "x11", "x12", "x10", "x14", "x15", "x16", "y16"]
SER = {"front": "x16", "back": "x15", "front_knee": "x14", "front_wrist": "x10", "com": "com", "height": "y16"}
FEAT_SQL = {
    "ce": VAR_SQL["ce"],
    "f1": f"SELECT phrase_id, side, frame, {', '.join(FILL)}, {', '.join(_fill(c) for c in FILL)} FROM poses",
    "f2": "SELECT phrase_id, side, frame, " + ", ".join(f"coalesce({c}, bv_{c} + (av_{c} - bv_{c}) * (frame - bf_{c}) / (af_{c} - bf_{c}), bv_{c}, av_{c}, 0) AS {c}" for c in FILL) + " FROM f1",
    "f3": f"SELECT *, (x5 + x6 + x11 + x12) / 4 AS com, {DIR} * (x16 - lag(x16) {WIN}) AS step FROM f2",
    "f4": "SELECT f3.*, greatest(0, least(event_frame, n - 1)) AS idx FROM f3 JOIN ce USING (phrase_id)",
    "f5": "SELECT phrase_id, side, max(idx) AS idx, "
    + ", ".join(
        f"max({c}) FILTER (frame = idx) AS {n}_now, max({c}) FILTER (frame = greatest(0, idx - 2)) AS {n}_prev, avg({c}) FILTER (frame < greatest(1, least(idx, 5))) AS {n}_base"
        for n, c in SER.items()
    )
    + ", coalesce(avg(step) FILTER (frame > idx - 6 AND frame <= idx) * 15, 0) AS front_velocity_mean_window, coalesce(max(step) FILTER (frame > idx - 6 AND frame <= idx) * 15, 0) AS front_velocity_peak_window FROM f4 GROUP BY phrase_id, side",
    "f6": "SELECT *, "
    + ", ".join(
        f"{DIR} * ({n}_now - {n}_base) AS {n}_progress, {DIR} * ({n}_now - {n}_prev) * 15 / greatest(1, idx - greatest(0, idx - 2)) AS {n}_velocity"
        for n in ("front", "back", "front_knee", "front_wrist", "com")
    )
    + f", front_now - back_now AS stance_now, {DIR} * (front_now - back_now - (front_base - back_base)) AS stance_progress, height_base - height_now AS front_height_change, "
    f"{DIR} * (front_wrist_now - front_now) AS weapon_lead, {DIR} * (front_wrist_now - front_now - (front_wrist_base - front_base)) AS weapon_lead_progress, {DIR} * (front_wrist_now - com_now) AS weapon_vs_com FROM f5",
    "f7": f"SELECT f6.*, coalesce((SELECT min(frame) FROM f4 WHERE f4.phrase_id = f6.phrase_id AND f4.side = f6.side AND f4.frame <= f6.idx AND (CASE WHEN f4.side = 'left' THEN 1 ELSE -1 END) * (f4.x16 - front_base) >= "
    "CASE WHEN front_progress > 0 THEN greatest(0.02, 0.2 * front_progress) ELSE 0.05 END), idx) AS attack_start_frame FROM f6",
    "feat": "SELECT *, greatest(1, idx - attack_start_frame) / 15.0::DOUBLE AS attack_lead_time, front_progress / greatest(1, idx - attack_start_frame) AS attack_progress_rate FROM f7",
}
FEAT_OUT = [c for c in ct.FEATURES if c != "attack_start_frame"]


def features(spark, sf):
    return ct.fencer_features(stored_poses(spark, sf), ph.events(spark, sf))


# A single step times 15 has six digits; four would round ties.
DIGITS = {"front_velocity_peak_window": 6}


def _featured(name, cols):
    @query(name, sql(f"SELECT phrase_id, side, {', '.join('attack_start_frame::BIGINT AS attack_start_frame' if c == 'attack_start_frame' else f'{v.rnd(c, DIGITS.get(c, 4))} AS {c}' for c in cols)} FROM feat", "poses", "info", **FEAT_SQL))
    def run(spark, sf):
        return features(spark, sf).select(*SIDE, *[big(c).alias(c) if c == "attack_start_frame" else rnd(c, DIGITS.get(c, 4)).alias(c) for c in cols])

    return run


_featured("contact_features_btr", [c for c in ct.FEATURES[:20]])
_featured("attack_onset", ["attack_start_frame", "attack_lead_time", "attack_progress_rate"])
_featured("momentum_window", ["front_velocity_mean_window", "front_velocity_peak_window"])

PAIR_SQL = {**FEAT_SQL, "lr": "SELECT l.phrase_id, " + ", ".join(f"l.{c} AS left_{c}, r.{c} AS right_{c}" for c in ct.FEATURES) + " FROM feat l JOIN feat r ON l.phrase_id = r.phrase_id AND l.side = 'left' AND r.side = 'right'"}
DELTA_EXPR = {
    "front_gap": "right_front_now - left_front_now",
    "front_gap_change": "right_front_progress - left_front_progress",
    "front_velocity_gap": "right_front_velocity - left_front_velocity",
    "stance_gap": "right_stance_now - left_stance_now",
} | {f"delta_{c}": f"left_{c} - right_{c}" for c in ct.DELTAS}


@query("side_pair", sql(f"SELECT phrase_id, {v.rnd('left_front_now')} AS left_front, {v.rnd('right_front_now')} AS right_front FROM lr", "poses", "info", **PAIR_SQL))
def side_pair(spark, sf):
    pair = ct.side_pair(features(spark, sf))
    return pair.select("phrase_id", rnd("left_front_now").alias("left_front"), rnd("right_front_now").alias("right_front"))


@query("feature_deltas", sql(f"SELECT phrase_id, {', '.join(f'{v.rnd(e)} AS {n}' for n, e in DELTA_EXPR.items())} FROM lr", "poses", "info", **PAIR_SQL))
def feature_deltas(spark, sf):
    rows = ct.feature_deltas(ct.side_pair(features(spark, sf)))
    return rows.select("phrase_id", *[rnd(n).alias(n) for n in DELTA_EXPR])


def _score(weights):
    return {s: " + ".join(f"{w} * {s}_{c}" for c, w in weights.items()) for s in ("left", "right")}


def _duel_sql(weights, tie):
    sc = _score(weights)
    gap = f"(({sc['left']}) - ({sc['right']}))"
    return f"CASE WHEN {gap} + CASE WHEN abs({gap}) < 1e-3 THEN 0.2 * (left_{tie} - right_{tie}) ELSE 0 END > 0 THEN 'left' ELSE 'right' END"


RULE_SQL = {
    "rule_velocity": _duel_sql({"front_velocity": 1.0, "front_progress": 0.6, "com_velocity": 0.3}, "stance_progress"),
    "rule_pressure": _duel_sql({"front_progress": 0.7, "front_wrist_progress": 0.3, "stance_progress": 0.4, "front_knee_progress": 0.2}, "com_progress"),
    "rule_priority": "CASE WHEN left_attack_start_frame < right_attack_start_frame THEN 'left' WHEN left_attack_start_frame > right_attack_start_frame THEN 'right' "
    "WHEN abs(left_attack_progress_rate - right_attack_progress_rate) > 1e-3 THEN CASE WHEN left_attack_progress_rate > right_attack_progress_rate THEN 'left' ELSE 'right' END "
    "WHEN left_front_progress >= right_front_progress THEN 'left' ELSE 'right' END",
}
for _name, _text in RULE_SQL.items():

    @query(_name, sql(f"SELECT phrase_id, {_text} AS winner FROM lr", "poses", "info", **PAIR_SQL))
    def _rule(spark, sf, rule=_name.split("_")[1]):
        return ct.side_pair(features(spark, sf)).select("phrase_id", ct.RULES[rule]().alias("winner"))


def attack_ctes(source: str, windows: str, lunges: str, slow: str, tag: str = "") -> dict[str, str]:
    """CTEs ending in aw<tag>: phrase_id, winner, basis."""
    per = lambda c: f"max({c}) FILTER (side = 'left') AS l_{c}, max({c}) FILTER (side = 'right') AS r_{c}"
    return {
        f"ws{tag}": f"SELECT phrase_id, side, w_start, greatest(w_start, w_end) AS w_end FROM {windows}",
        f"wr{tag}": f"SELECT p.* FROM {source} p JOIN ws{tag} w USING (phrase_id, side) WHERE frame BETWEEN w_start AND w_end",
        f"wh{tag}": f"SELECT phrase_id, side, w_end AS hit_frame FROM ws{tag} WHERE w_end - w_start >= 1",
        **arm_ctes(f"wr{tag}", f"wh{tag}", f"w{tag}"),
        f"na{tag}": f"SELECT phrase_id, side, arg_max(effective_start, start_frame) AS arm FROM axw{tag} WHERE near_hit GROUP BY phrase_id, side",
        f"gl{tag}": f"SELECT phrase_id, side, arg_max(start_frame, end_frame * 1000000 + start_frame) AS lunge FROM {lunges} JOIN ws{tag} USING (phrase_id, side) WHERE NOT is_penalizing AND start_frame >= w_start AND end_frame <= w_end GROUP BY phrase_id, side",
        **a3_ctes(f"wr{tag}", f"w{tag}"),
        f"al{tag}": f"SELECT phrase_id, {per('arm')}, {per('lunge')}, {per('slow')}, {per('speed')} FROM (SELECT w.phrase_id, w.side, arm, lunge, CASE WHEN s.side IS NOT NULL THEN 1 ELSE 0 END AS slow, coalesce(speed, 0) AS speed "
        f"FROM ws{tag} w LEFT JOIN na{tag} USING (phrase_id, side) LEFT JOIN gl{tag} USING (phrase_id, side) LEFT JOIN {slow} s USING (phrase_id, side) LEFT JOIN a3w{tag} USING (phrase_id, side)) GROUP BY phrase_id",
        f"ap{tag}": "SELECT *, l_arm IS NOT NULL AS la, r_arm IS NOT NULL AS ra, l_lunge IS NOT NULL AS ll, r_lunge IS NOT NULL AS rl, "
        + ", ".join(f"CASE WHEN l_arm IS NOT NULL AND r_arm IS NOT NULL THEN CASE WHEN l_lunge IS NOT NULL AND r_lunge IS NOT NULL THEN ({s}_arm * 0.6 + {s}_lunge * 0.4) ELSE {s}_arm END WHEN l_lunge IS NOT NULL AND r_lunge IS NOT NULL THEN {s}_lunge END AS {s}w" for s in "lr")
        + f" FROM al{tag}",
        f"aw{tag}": "SELECT phrase_id, CASE WHEN la <> ra THEN CASE WHEN la THEN 'left' ELSE 'right' END WHEN ll <> rl THEN CASE WHEN ll THEN 'left' ELSE 'right' END "
        "WHEN lw < rw THEN 'left' WHEN rw < lw THEN 'right' WHEN l_slow > r_slow THEN 'right' WHEN r_slow > l_slow THEN 'left' WHEN l_speed > r_speed THEN 'left' ELSE 'right' END AS winner, "
        "CASE WHEN la <> ra THEN 'near-hit arm extension' WHEN ll <> rl THEN 'beneficial lunge' WHEN lw <> rw THEN 'weighted signal start is earlier' WHEN l_slow <> r_slow THEN 'slow-start penalty' ELSE 'faster' END AS basis "
        f"FROM ap{tag}",
    }


@query("attack_window", sql("SELECT phrase_id, winner, basis FROM aw", *BASE, **PV, **HARM_SQL, **WINDOW_SQL, **attack_ctes("ev", "win", "lgv", "ss")))
def attack_window(spark, sf):
    rows = eval_poses(spark, sf)
    marked = iv.slow_starts(iv.pauses(rows, R.pause, FPS), R, FPS)
    slow = marked.where("is_slow_start").select(*SIDE).distinct()
    lunges = iv.lunges(rows, ph.hits(spark, sf), R.lunge, R.pause, FPS)
    return dc.attack_window(rows, ph.attack_spans(spark, sf), lunges, slow, R)


BASE_SQL = {
    **pause_ctes(ph.BASE_RULES, "poses", "b"),
    **A2_SQL,
    "fb": "SELECT phrase_id, min(start_frame) FILTER (side = 'left') AS lp, min(start_frame) FILTER (side = 'right') AS rp FROM pzb GROUP BY phrase_id",
    "sb": "SELECT phrase_id, max(speed) FILTER (side = 'left') AS ls, max(speed) FILTER (side = 'right') AS rs FROM a2 GROUP BY phrase_id",
    **(VAR_SQL | {"ce": "SELECT phrase_id, contact_1 AS event_frame, n FROM info"}),
    "wb": "SELECT i.phrase_id, ls, rs, left_variance, right_variance, CASE WHEN lp IS NOT NULL AND rp IS NULL THEN 'right' WHEN rp IS NOT NULL AND lp IS NULL THEN 'left' WHEN lp < rp THEN 'right' WHEN lp IS NOT NULL THEN 'left' ELSE 'none' END AS way "
    "FROM info i LEFT JOIN fb USING (phrase_id) LEFT JOIN sb USING (phrase_id) LEFT JOIN vv USING (phrase_id)",
    "bb": "SELECT *, CASE way WHEN 'left' THEN CASE WHEN left_variance > 0.1 THEN 'left' ELSE 'right' END WHEN 'right' THEN CASE WHEN right_variance > 0.1 THEN 'right' ELSE 'left' END ELSE CASE WHEN left_variance > right_variance THEN 'left' ELSE 'right' END END AS blade FROM wb",
}


@query("decide_base", sql("SELECT phrase_id, CASE WHEN way <> 'none' THEN way ELSE blade END AS winner, way AS right_of_way, blade AS blade_analysis FROM bb", *BASE, **BASE_SQL))
def decide_base(spark, sf):
    return dc.judge_base(stored_poses(spark, sf), ph.contacts(spark, sf), ph.info(spark, sf), ph.BASE_RULES, FPS)


JUDGE_SQL = {
    **EVENT_SQL,
    **J6_SQL,
    "sc": J5_SQL["sc"],
    "ce": "SELECT phrase_id, round_even(contact_time * 30, 0)::INT AS event_frame, n FROM sc JOIN info USING (phrase_id) WHERE contact_frame <= first_hit_cut".replace("first_hit_cut", "least(left_hit, right_hit)"),
    **contact_ctes("ce"),
    "base": "SELECT i.phrase_id, least(left_hit, right_hit) AS shared_max, le, re, CASE WHEN is_accident = false THEN benefit_side END AS blade_side, is_accident, "
    "CASE WHEN is_accident = false THEN NULL WHEN coalesce(overlap_ok, false) THEN 'overlap' WHEN coalesce(lt, 0) = 0 AND coalesce(rt, 0) = 0 THEN 'no_pause' END AS mode "
    "FROM info i LEFT JOIN ov USING (phrase_id) LEFT JOIN cj USING (phrase_id)",
    "jw": "SELECT h.phrase_id, h.side, CASE WHEN mode = 'overlap' THEN coalesce(CASE WHEN side = 'left' THEN le ELSE re END, 0) ELSE 0 END AS w_start, hit_frame AS w_end FROM hits h JOIN base USING (phrase_id) WHERE mode IS NOT NULL",
    "blk": "SELECT DISTINCT phrase_id FROM harm JOIN jw USING (phrase_id, side) WHERE end_frame >= w_start AND start_frame <= w_end",
    "jo": "SELECT jw.* FROM jw WHERE phrase_id NOT IN (SELECT phrase_id FROM blk)",
    **attack_ctes("ev", "jo", "lgv", "ss", "j"),
    "verdict": "SELECT b.phrase_id, coalesce(a.winner, blade_side, right_of_way, 'none') AS winner, CASE WHEN a.winner IS NOT NULL THEN mode || ': ' || basis WHEN blade_side IS NOT NULL AND blade_side = coalesce(right_of_way, 'none') THEN 'blade contact favored' "
    "WHEN blade_side IS NOT NULL THEN 'blade contact overrode' ELSE coalesce(event_type, 'no event') END AS reason, coalesce(right_of_way, 'none') AS right_of_way, is_accident IS NOT NULL AS contact_judged, coalesce(is_accident, false) AS accident "
    "FROM base b LEFT JOIN awj a USING (phrase_id) LEFT JOIN lat USING (phrase_id)",
}


@query("decide_fps30", sql("SELECT phrase_id, winner, reason, right_of_way, contact_judged, accident FROM verdict", *BASE, "pixels", **JUDGE_SQL))
def decide_fps30(spark, sf):
    return dc.judge(
        stored_poses(spark, sf), ph.facts(spark, sf), ph.contacts(spark, sf), ph.hits(spark, sf), R, FPS, src.PIXELS
    )
