"""Whole phrase jobs: poses and logs in, verdicts out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quarte.operators import decide as dc, logs, motion
from quarte.operators.series import spread_join
from quarte.plans.decisions import BASE_SQL, JUDGE_SQL, R, stored_poses
from quarte.plans.evaluation import norm_constant
from quarte.plans.projections import SWAPPED, mirror
from quarte.functions import geometry as g
from quarte.plans import views as v
from quarte.plans.registry import query
from quarte.plans.views import sql
from quarte.session import stage
from quarte.sources import adapters as src, phrases as ph

FPS = ph.FPS
SIDE = ["phrase_id", "side"]


def phrase_text(spark, sf):
    """A text log per pose phrase."""
    rows = ph.info(spark, sf)
    at = lambda c: F.format_string("%7.3fs | ", F.col(c) / FPS)
    both = F.greatest("left_hit", "right_hit")
    line = lambda n, cond, text: F.struct(F.lit(n).alias("line_no"), F.when(cond, text).alias("line"))
    always = F.lit(True)
    items = [
        line(1, always, F.lit("  0.000s | Phrase recording started")),
        line(2, always, F.concat(at("contact_1"), F.lit("Off-Target: Blade-to-blade contact."))),
        line(3, F.col("contact_2").isNotNull(), F.concat(at("contact_2"), F.lit("Off-Target: Blade-to-blade contact. [left beat]"))),
        line(4, F.col("lockout").isNotNull(), F.concat(at("lockout"), F.lit("Lockout period started (0.200s window)"))),
        line(5, always, F.concat(at("left_hit"), F.lit("HIT: Left scores on Right!"))),
        line(6, always, F.concat(at("right_hit"), F.lit("HIT: Right scores on Left!"))),
        line(7, always, F.concat(F.format_string("%7.3fs | ", both / FPS), F.lit("Simultaneous valid hits detected."))),
        line(8, always, F.lit("Scores -> Fencer 1: HIT, Fencer 2: HIT")),
        line(9, always, F.lit("Confirmed result winner: Left Fencer (Red Lamp)")),
    ]
    return rows.select("phrase_id", F.inline(F.array(*items))).where("line IS NOT NULL")


def log_tables(log, sizes, fps):
    """Facts, contacts and hits of phrases from their text logs."""
    parsed = logs.parse_fps30(log, fps)
    hit_rows = logs.side_hits(log, fps)
    firsts = hit_rows.groupBy("phrase_id").agg(
        F.min(F.when(F.col("scorer") == "left", F.col("frame"))).alias("left"),
        F.min(F.when(F.col("scorer") == "right", F.col("frame"))).alias("right"),
        F.min("time_s").alias("first_time"),
    )
    rows = sizes.join(parsed, "phrase_id").join(firsts, "phrase_id", "left")
    last = (F.col("n") - 1) / fps
    hit_time = F.when(F.col("hit_time") <= last, F.col("hit_time"))
    facts = rows.withColumn("_hit", hit_time).select(
        "phrase_id",
        "n",
        F.coalesce("left", (F.col("_hit") * fps).cast("long")).cast("int").alias("left_hit"),
        F.coalesce("right", (F.col("_hit") * fps).cast("long")).cast("int").alias("right_hit"),
        F.least("first_time", "_hit").alias("hit_time"),
        F.when(F.col("lockout") <= last, F.col("lockout")).alias("lockout"),
    )
    t = F.when(F.col("line").contains("Off-Target: Blade-to-blade contact"), logs.stamp())
    contacts = log.select("phrase_id", "line_no", t.alias("time_s")).where("time_s IS NOT NULL")
    contacts = spread_join(contacts, sizes, ["phrase_id"], F.col("line_no"))
    contacts = contacts.withColumn("frame", (F.col("time_s") * fps).cast("int")).where(F.col("frame") < F.col("n")).drop("n")
    explicit = hit_rows.select("phrase_id", F.col("scorer").alias("side"), F.col("frame").cast("int").alias("hit_frame"))
    return facts, contacts, explicit


T3 = "format('{:.3f}', %s / 30.0::DOUBLE)::DOUBLE"
LOGGED = {
    "base_info": v.VIEWS["info"][1],
    "tt": f"SELECT phrase_id, n, {T3 % 'contact_1'} AS c1, {T3 % 'contact_2'} AS c2, {T3 % 'lockout'} AS lk, {T3 % 'left_hit'} AS lt, {T3 % 'right_hit'} AS rt FROM base_info",
    "info": "SELECT phrase_id, n, trunc(lt * 30)::INT AS left_hit, trunc(rt * 30)::INT AS right_hit, least(lt, rt) AS hit_time, CASE WHEN lk <= (n - 1) / 30.0::DOUBLE THEN lk END AS lock_s FROM tt",
    "hits": "SELECT phrase_id, 'left' AS side, left_hit AS hit_frame FROM info UNION ALL SELECT phrase_id, 'right', right_hit FROM info",
    "contacts": "SELECT * FROM (SELECT phrase_id, 2 AS line_no, trunc(c1 * 30)::INT AS frame, c1 AS time_s, n FROM tt UNION ALL SELECT phrase_id, 3, trunc(c2 * 30)::INT, c2, n FROM tt WHERE c2 IS NOT NULL) WHERE frame < n",
    "facts": "SELECT *, least(left_hit, right_hit) AS first_hit FROM info",
}


@query(
    "judge_all_fps30",
    sql(
        "SELECT phrase_id, winner, reason, contact_judged, accident, 30.0::DOUBLE AS fps FROM verdict",
        "poses", "pixels",
        **{**LOGGED, **{k: t for k, t in JUDGE_SQL.items() if k not in LOGGED}},
    ).replace("contacts JOIN facts USING (phrase_id) WHERE", "(SELECT phrase_id, line_no, frame, time_s FROM contacts) JOIN facts USING (phrase_id) WHERE"),
)
def judge_all_fps30(spark, sf):
    poses = stored_poses(spark, sf)
    facts, contacts, hits = log_tables(phrase_text(spark, sf), ph.info(spark, sf).select("phrase_id", "n"), FPS)
    verdicts = dc.judge(poses, facts, contacts, hits, R, FPS, src.PIXELS)
    return verdicts.select("phrase_id", "winner", "reason", "contact_judged", "accident", F.lit(FPS).alias("fps"))


# Joints divided by the foot gap are larger numbers than the stored poses.
WIDE_RULES = replace(ph.BASE_RULES, speed=5.0, retreat=3.5, back_foot=5.0, y_variance=25.0)
W6 = lambda c: (
    f"coalesce({c}, CASE WHEN frame - last_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) {{up}} <= 2 THEN last_value({c} IGNORE NULLS) {{up}} + (first_value({c} IGNORE NULLS) {{down}} - last_value({c} IGNORE NULLS) {{up}}) "
    f"* (frame - last_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) {{up}}) / (first_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) {{down}} - last_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) {{up}}) END) AS {c}"
)
USED = ["x9", "y9", "x10", "y10", "x15", "y15", "x16", "y16"]


def _w6(c: str) -> str:
    return W6(c).format(up="OVER (PARTITION BY phrase_id, side ORDER BY frame)", down="OVER (PARTITION BY phrase_id, side ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")


from quarte.plans.projections import BOXED  # noqa: E402
from quarte.plans.windows import pause_ctes  # noqa: E402

NC = (
    "SELECT phrase_id, round(abs(vals[3] - vals[2]) / 4, 4) AS c FROM (SELECT l.phrase_id, list_sort([l.x15, l.x16, r.x15, r.x16]) AS vals, row_number() OVER (PARTITION BY l.phrase_id ORDER BY l.frame) AS rk "
    "FROM boxed l JOIN boxed r ON l.phrase_id = r.phrase_id AND l.frame = r.frame AND l.side = 'left' AND r.side = 'right' WHERE l.x15 > 0 AND l.x16 > 0 AND r.x15 > 0 AND r.x16 > 0) WHERE rk = 1"
)


@query(
    "judge_all_base",
    sql(
        "SELECT phrase_id, CASE WHEN way <> 'none' THEN way ELSE blade END AS winner, way AS right_of_way, blade AS blade_analysis FROM bb",
        "pixels", "info", "contacts",
        **{
            **BOXED, **SWAPPED, "nc": NC,
            "unit": "SELECT phrase_id, side, frame, " + ", ".join(f"CASE WHEN {v.ok(int(c[1:]))} THEN {c} / c END AS {c}" for c in USED) + " FROM swapped JOIN nc USING (phrase_id)",
            "filled": "SELECT phrase_id, side, frame, " + ", ".join(_w6(c) for c in USED) + " FROM unit",
            **{
                k: t.replace("FROM poses", "FROM filled")
                for k, t in {**BASE_SQL, **pause_ctes(WIDE_RULES, "poses", "b")}.items()
            },
        },
    ),
)
def judge_all_base(spark, sf):
    """Tracked joints in pixels to verdicts: mirror, normalise, fill short gaps, judge."""
    constants = norm_constant(spark, sf).select("phrase_id", "c")
    rows = g.only_valid(mirror(src.pixel_poses(spark, sf))).select(*SIDE, "frame", *USED)
    rows = spread_join(rows, constants, ["phrase_id"], F.col("frame"))
    rows = rows.withColumns({c: F.col(c) / F.col("c") for c in USED}).drop("c")
    filled = stage(motion.interpolate_gaps(stage(rows), SIDE, "frame", USED, 2))
    return dc.judge_base(filled, ph.contacts(spark, sf), ph.info(spark, sf), WIDE_RULES, FPS)
