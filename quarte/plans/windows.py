"""Window and time-series queries: motion, gaps, islands and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.functions import geometry as g
from quarte.operators import intervals as iv, motion
from quarte.operators.series import nearby, runs
from quarte.params import PauseRules
from quarte.plans import views as v
from quarte.plans.registry import big, query, rnd
from quarte.plans.views import sql
from quarte.sources import adapters as src, phrases as ph

SIDE = ["phrase_id", "side"]
FPS = ph.FPS
L, P, A = ph.RULES.lunge, ph.RULES.pause, ph.RULES.arm
DIR = "(CASE WHEN side = 'left' THEN 1.0::DOUBLE ELSE -1.0 END)"
WIN = "OVER (PARTITION BY phrase_id, side ORDER BY frame)"


def island(table: str, keys: str, flag: str, cols: str = "") -> str:
    """Flagged rows of a table with an island number."""
    return (
        f"SELECT *, frame - row_number() OVER (PARTITION BY {keys} ORDER BY frame) AS isl FROM {table} WHERE {flag}"
    )


@query(
    "velocity",
    sql(
        f"SELECT phrase_id, side, frame, {v.rnd('step', 6)} AS velocity FROM "
        f"(SELECT phrase_id, side, frame, coalesce(x16 - lag(x16) {WIN}, 0) AS step FROM poses) WHERE frame >= 1",
        "poses",
    ),
)
def velocity(spark, sf):
    return iv.foot_motion(src.poses(spark, sf)).select(*SIDE, "frame", rnd("step", 6).alias("velocity"))


SW = "OVER (PARTITION BY series_id ORDER BY frame)"


@query(
    "gradient",
    sql(
        "SELECT series_id, frame, "
        + v.rnd(
            f"CASE WHEN pf IS NULL AND nf IS NULL THEN NULL WHEN pf IS NULL THEN (nx - x) * 30 WHEN nf IS NULL THEN (x - px) * 30 ELSE (nx - px) * 15 END"
        )
        + f" AS slope FROM (SELECT *, lag(x) {SW} AS px, lead(x) {SW} AS nx, lag(frame) {SW} AS pf, lead(frame) {SW} AS nf FROM series)",
        "series",
    ),
)
def gradient(spark, sf):
    rows = motion.with_gradients(src.series(spark, sf), ["series_id"], "frame", {"slope": "x"}, 1 / FPS)
    return rows.select("series_id", "frame", rnd("slope").alias("slope"))


@query(
    "window_mean",
    sql(
        f"SELECT series_id, frame, {v.rnd('avg(x) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 4 PRECEDING)')} AS pre, "
        f"{v.rnd('avg(x) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)')} AS around, "
        f"{v.rnd('avg(y) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING)')} AS post FROM series",
        "series",
    ),
)
def window_mean(spark, sf):
    spans = {"pre": ("x", -8, -4), "around": ("x", -1, 1), "post": ("y", 2, 6)}
    rows = motion.window_means(src.series(spark, sf), ["series_id"], "frame", spans)
    return rows.select("series_id", "frame", *[rnd(c).alias(c) for c in spans])


@query(
    "run_islands",
    sql(
        "SELECT series_id, min(frame)::BIGINT AS start_frame, max(frame)::BIGINT AS end_frame, count(*) AS n_frames FROM s GROUP BY series_id, isl HAVING count(*) >= 2",
        "series",
        s=island("series", "series_id", "x > 0.5"),
    ),
)
def run_islands(spark, sf):
    found = runs(src.series(spark, sf), ["series_id"], "frame", F.col("x") > 0.5).where("n_frames >= 2")
    return found.select("series_id", big("start_frame").alias("start_frame"), big("end_frame").alias("end_frame"), "n_frames")


@query(
    "bridged_runs",
    sql(
        "SELECT series_id, min(frame)::BIGINT AS start_frame, max(frame)::BIGINT AS end_frame, count(*) AS n_frames FROM "
        f"(SELECT *, sum(CASE WHEN d <= 2 THEN 0 ELSE 1 END) {SW} AS run FROM (SELECT *, frame - lag(frame) {SW} AS d FROM series WHERE x > 0.9)) GROUP BY series_id, run",
        "series",
    ),
)
def bridged_runs(spark, sf):
    found = runs(src.series(spark, sf), ["series_id"], "frame", F.col("x") > 0.9, gap=2)
    return found.select("series_id", big("start_frame").alias("start_frame"), big("end_frame").alias("end_frame"), "n_frames")


NEAR = {
    "nb": "SELECT *, "
    f"last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) {SW} AS bf, last_value(x IGNORE NULLS) {SW} AS bv, "
    "first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS af, "
    "first_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av, "
    "count(x) OVER (PARTITION BY series_id) AS nx FROM sparse"
}
# Gaps of up to seven frames: only every other block of the series is kept.
SPARSE = {"sparse": "SELECT series_id, frame, CASE WHEN (frame + series_id) % 9 < 5 THEN x END AS x FROM series"}
LINE = "bv + (av - bv) * (frame - bf) / (af - bf)"


def sparse(spark, sf):
    return src.series(spark, sf).select(
        "series_id", "frame", F.when((F.col("frame") + F.col("series_id")) % 9 < 5, F.col("x")).alias("x")
    )


@query(
    "interp_gaps",
    sql(
        f"SELECT series_id, frame, {v.rnd(f'coalesce(x, CASE WHEN frame - bf <= 2 THEN {LINE} END)')} AS x FROM nb",
        "series", **SPARSE, **NEAR,
    ),
)
def interp_gaps(spark, sf):
    rows = motion.interpolate_gaps(sparse(spark, sf), ["series_id"], "frame", ["x"], 2)
    return rows.select("series_id", "frame", rnd("x").alias("x"))


@query(
    "fill_edges",
    sql(
        f"SELECT series_id, frame, {v.rnd(f'coalesce(x, CASE WHEN nx = 1 THEN 0 WHEN nx > 1 THEN coalesce({LINE}, bv, av) END)')} AS x FROM nb",
        "series", **SPARSE, **NEAR,
    ),
)
def fill_edges(spark, sf):
    rows = motion.fill_edges(sparse(spark, sf), ["series_id"], "frame", ["x"])
    return rows.select("series_id", "frame", rnd("x").alias("x"))


@query(
    "pose_scan_filled",
    sql(f"SELECT series_id, frame, {v.rnd(f'coalesce(x, {LINE}, bv, av, 0)')} AS x FROM nb", "series", **SPARSE, **NEAR),
)
def pose_scan_filled(spark, sf):
    rows = motion.fill_all(sparse(spark, sf), ["series_id"], "frame", ["x"])
    return rows.select("series_id", "frame", rnd("x").alias("x"))


def _nb(k):
    return ", ".join(f"lag({a}{k}) {WIN} AS p{a}, lead({a}{k}) {WIN} AS n{a}" for a in "xy")


@query(
    "prediction_error",
    sql(
        f"SELECT phrase_id, side, frame, {v.rnd('sqrt(power(x10 - 0.5 * (px + nx), 2) + power(y10 - 0.5 * (py + ny), 2))')} AS error "
        f"FROM (SELECT *, {_nb(10)} FROM poses)",
        "poses",
    ),
)
def prediction_error(spark, sf):
    rows = src.poses(spark, sf).select(*SIDE, "frame", "x10", "y10")

    def build(d, w):
        mid = [(F.lag(c).over(w) + F.lead(c).over(w)) * 0.5 for c in ("x10", "y10")]
        return d.withColumn("error", g.distance((F.col("x10"), F.col("y10")), mid))

    return nearby(rows, SIDE, "frame", 1, 1, build).select(*SIDE, "frame", rnd("error").alias("error"))


@query(
    "max_step",
    sql(
        f"SELECT phrase_id, side, frame, {v.rnd('coalesce(greatest(sqrt(power(x10 - px, 2) + power(y10 - py, 2)), sqrt(power(x10 - nx, 2) + power(y10 - ny, 2))), 0)')} AS step "
        f"FROM (SELECT *, {_nb(10)} FROM poses)",
        "poses",
    ),
)
def max_step(spark, sf):
    rows = src.poses(spark, sf).select(*SIDE, "frame", "x10", "y10")

    def build(d, w):
        here = (F.col("x10"), F.col("y10"))
        into = g.distance(here, [F.lag(c).over(w) for c in ("x10", "y10")])
        out = g.distance(here, [F.lead(c).over(w) for c in ("x10", "y10")])
        return d.withColumn("step", F.coalesce(F.greatest(into, out), F.lit(0.0)))

    return nearby(rows, SIDE, "frame", 1, 1, build).select(*SIDE, "frame", rnd("step").alias("step"))


def pause_ctes(rules: PauseRules, source: str = "poses", tag: str = "") -> dict[str, str]:
    """CTEs ending in pz<tag>: phrase_id, side, start_frame, end_frame, is_retreat."""
    speed, retreat, back = (rules.per_frame(x, FPS) for x in (rules.speed, rules.retreat, rules.back_foot))
    slow = f"(abs(step) < {speed!r}::DOUBLE OR step * {DIR} < 0)"
    return {
        f"mo{tag}": f"SELECT * FROM (SELECT phrase_id, side, frame, y16, coalesce(x16 - lag(x16) {WIN}, 0) AS step, "
        f"coalesce((x15 - lag(x15) {WIN}) * {DIR}, 0) AS back FROM {source}) WHERE frame >= 1",
        f"i1{tag}": island(f"mo{tag}", "phrase_id, side", slow),
        f"r1{tag}": f"SELECT phrase_id, side, min(frame) AS start_frame, max(frame) AS end_frame, avg(abs(step)) > {retreat!r}::DOUBLE AS is_retreat "
        f"FROM i1{tag} GROUP BY phrase_id, side, isl HAVING count(*) >= {rules.min_frames}",
        f"i2{tag}": island(f"mo{tag}", "phrase_id, side", f"{slow} AND back < {back!r}::DOUBLE"),
        f"r2{tag}": f"SELECT phrase_id, side, min(frame) AS start_frame, max(frame) AS end_frame FROM i2{tag} "
        f"GROUP BY phrase_id, side, isl HAVING count(*) >= {rules.min_frames} AND NOT coalesce(count(y16) > 1 AND var_pop(y16) >= {rules.y_variance!r}::DOUBLE, false)",
        f"pz{tag}": f"SELECT * FROM r1{tag} WHERE is_retreat UNION ALL SELECT p.phrase_id, p.side, p.start_frame, p.end_frame, false FROM r2{tag} p JOIN r1{tag} q "
        "ON p.phrase_id = q.phrase_id AND p.side = q.side AND p.start_frame >= q.start_frame AND p.end_frame <= q.end_frame AND NOT q.is_retreat",
    }


OUT = "phrase_id, side, start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame"


def spanned(df, *cols):
    return df.select(*SIDE, big("start_frame").alias("start_frame"), big("end_frame").alias("end_frame"), *cols)


@query("pauses_base", sql(f"SELECT {OUT} FROM pz", "poses", **pause_ctes(ph.BASE_RULES)))
def pauses_base(spark, sf):
    return spanned(iv.pauses(src.poses(spark, sf), ph.BASE_RULES, FPS))


@query("pauses_fps30", sql(f"SELECT {OUT}, is_retreat FROM pz", "poses", **pause_ctes(P)))
def pauses_fps30(spark, sf):
    return spanned(iv.pauses(src.poses(spark, sf), P, FPS), "is_retreat")


SLOW = f"(start_frame <= {ph.RULES.slow_start_frame} AND end_frame - start_frame + 1 < {int(FPS * ph.RULES.slow_start_seconds)})"


@query(
    "slow_starts",
    sql(
        f"SELECT phrase_id, side, count(*) FILTER (NOT {SLOW}) AS n_pauses, max(end_frame) FILTER ({SLOW})::BIGINT AS slow_end, "
        f"arg_max(start_frame, end_frame) FILTER ({SLOW})::BIGINT AS slow_start FROM pz GROUP BY phrase_id, side",
        "poses", **pause_ctes(P),
    ),
)
def slow_starts(spark, sf):
    found = iv.slow_starts(iv.pauses(src.poses(spark, sf), P, FPS), ph.RULES, FPS)
    slow = F.col("is_slow_start")
    last = F.max(F.when(slow, F.struct("end_frame", "start_frame")))
    return found.groupBy(*SIDE).agg(
        F.count_if(~slow).alias("n_pauses"),
        big(last["end_frame"]).alias("slow_end"),
        big(last["start_frame"]).alias("slow_start"),
    )


@query(
    "lunge_base",
    sql(
        "SELECT phrase_id, side, coalesce(count(gap) >= 2 AND avg(gap) * 2.5 >= 0.8 AND arg_max(gap, frame) > arg_min(gap, frame), false) AS lunge "
        f"FROM (SELECT phrase_id, side, frame, {v.dist(16, 15)} AS gap FROM poses WHERE frame < 5) GROUP BY phrase_id, side",
        "poses",
    ),
)
def lunge_base(spark, sf):
    gap = iv.foot_gap() * 2.5
    early = src.poses(spark, sf).where("frame < 5").select(*SIDE, "frame", gap.alias("gap")).where("gap IS NOT NULL")
    grown = F.max_by("gap", "frame") > F.min_by("gap", "frame")
    lunge = (F.count("gap") >= 2) & (F.avg("gap") >= 0.8) & grown
    return early.groupBy(*SIDE).agg(F.coalesce(lunge, F.lit(False)).alias("lunge"))


def lunge_ctes(source: str = "poses", hits: str = "hits", tag: str = "") -> dict[str, str]:
    """CTEs ending in lg<tag>: phrase_id, side, core_start, start_frame, end_frame, n_hits, is_penalizing."""
    still, backward = P.per_frame(P.speed, FPS), P.per_frame(L.backward, FPS)
    key = "phrase_id, side, core_start"
    return {
        f"fg{tag}": f"SELECT phrase_id, side, frame, x15, x16, y16, {v.dist(16, 15)} AS gap, degrees({v.angle(13, 11, 12)}) AS hip, "
        f"coalesce((x16 - lag(x16) {WIN}) * {DIR}, 0) AS fstep, (x15 - lag(x15) {WIN}) * {DIR} AS bstep FROM {source}",
        f"ci{tag}": island(f"fg{tag}", "phrase_id, side", f"gap > {L.core}"),
        f"cores{tag}": f"SELECT phrase_id, side, min(frame) AS core_start, max(frame) AS core_end FROM ci{tag} GROUP BY phrase_id, side, isl HAVING count(*) >= {L.min_frames}",
        f"wi{tag}": island(f"fg{tag}", "phrase_id, side", f"gap > {L.expand}"),
        f"wide{tag}": f"SELECT phrase_id, side, min(frame) AS ws, max(frame) AS we FROM wi{tag} GROUP BY phrase_id, side, isl",
        f"arms{tag}": f"SELECT c.*, core_start - ws AS l, we - core_end AS r, core_end - core_start AS b FROM cores{tag} c JOIN wide{tag} w "
        "ON c.phrase_id = w.phrase_id AND c.side = w.side AND ws <= core_start AND we >= core_end",
        f"took{tag}": f"SELECT *, CASE WHEN l + r <= b THEN l ELSE greatest(least(l, (b + 1) // 2), b - r) END AS tl FROM arms{tag}",
        f"sp{tag}": f"SELECT {key}, core_end, core_start - tl AS start_frame, core_end + CASE WHEN l + r <= b THEN r ELSE b - tl END AS end_frame FROM took{tag}",
        f"ins{tag}": f"SELECT s.*, f.frame, f.y16, f.gap, f.hip, f.fstep, f.bstep FROM sp{tag} s JOIN fg{tag} f ON s.phrase_id = f.phrase_id AND s.side = f.side AND f.frame BETWEEN s.start_frame AND s.end_frame",
        f"chk{tag}": f"SELECT {key}, core_end, start_frame, end_frame, count(*) FILTER (hip > {L.hip_angle}) AS n_hip, count(*) FILTER (gap > {L.far}) AS n_far, "
        f"count(*) FILTER (frame > start_frame AND bstep < {-backward!r}::DOUBLE) AS n_back FROM ins{tag} GROUP BY {key}, core_end, start_frame, end_frame",
        f"st{tag}": island(f"ins{tag}", key, f"frame > start_frame AND (abs(fstep) < {still!r}::DOUBLE OR fstep < 0)"),
        f"lt{tag}": f"SELECT DISTINCT {key} FROM (SELECT {key}, count(*) AS m, max(end_frame) - max(frame) AS tail, count(y16) AS ny, var_pop(y16) AS vy FROM st{tag} GROUP BY {key}, isl) "
        f"WHERE m >= {L.late_pause_frames} AND tail <= {L.late_pause_window} AND NOT coalesce(ny > 1 AND vy >= {P.y_variance}, false)",
        f"hh{tag}": f"SELECT s.phrase_id, s.side, core_start, count(*) AS n_hits, max(hit_frame) AS last_hit FROM sp{tag} s JOIN {hits} h ON s.phrase_id = h.phrase_id AND s.side = h.side "
        f"AND hit_frame BETWEEN start_frame AND end_frame + {L.hit_grace} GROUP BY ALL",
        f"lg{tag}": f"SELECT {key}, start_frame, end_frame, coalesce(n_hits, 0) AS n_hits, NOT coalesce(n_hits > 0 AND lt{tag}.core_start IS NULL AND last_hit - start_frame < {L.late_hit_gap}, false) AS is_penalizing "
        f"FROM chk{tag} LEFT JOIN hh{tag} USING (phrase_id, side, core_start) LEFT JOIN lt{tag} USING (phrase_id, side, core_start) "
        f"WHERE (n_hip >= {L.hip_frames} OR n_far >= {L.far_frames}) AND n_back / (end_frame - start_frame + 1) <= {L.max_backward_share}",
    }


@query("lunge_cores", sql("SELECT phrase_id, side, core_start::BIGINT AS start_frame, core_end::BIGINT AS end_frame FROM cores", "poses", "hits", **lunge_ctes()))
def lunge_cores(spark, sf):
    return spanned(iv.lunge_cores(src.poses(spark, sf), L))


@query("lunge_expand", sql(f"SELECT {OUT}, core_start::BIGINT AS core_start, core_end::BIGINT AS core_end FROM sp", "poses", "hits", **lunge_ctes()))
def lunge_expand(spark, sf):
    rows = iv.expand_cores(src.poses(spark, sf), L)
    return spanned(rows, big("core_start").alias("core_start"), big("core_end").alias("core_end"))


@query("lunge_validate", sql(f"SELECT {OUT}, n_hits, is_penalizing FROM lg", "poses", "hits", **lunge_ctes()))
def lunge_validate(spark, sf):
    rows = iv.lunges(src.poses(spark, sf), ph.hits(spark, sf), L, P, FPS)
    return spanned(rows, "n_hits", "is_penalizing")


def arm_ctes(source: str = "poses", hits: str = "hits", tag: str = "") -> dict[str, str]:
    """CTEs ending in ax<tag>."""
    key = "phrase_id, side"
    return {
        f"el{tag}": f"SELECT phrase_id, side, frame, CASE WHEN y10 IS NOT NULL AND y12 IS NOT NULL THEN abs(x10 - x12) END AS reach, degrees({v.angle(6, 8, 10)}) AS inn, "
        "coalesce(y8 < y6 + (y10 - y6) * (x8 - x6) / CASE WHEN abs(x10 - x6) > 1e-9 THEN x10 - x6 END, false) AS above, "
        f"degrees({v.angle(8, 6, 12)}) AS body FROM {source}",
        f"e2{tag}": f"SELECT *, CASE WHEN above THEN 360 - inn ELSE inn END AS elbow FROM el{tag}",
        f"ai{tag}": island(f"e2{tag}", key, f"reach >= {A.reach}"),
        f"a1{tag}": f"SELECT {key}, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_frames, avg(reach) AS avg_reach, avg(elbow) AS avg_elbow, "
        f"max(body) FILTER (elbow IS NOT NULL) AS max_body, min(frame) FILTER (elbow >= {A.straight_deg}) AS effective_start FROM ai{tag} GROUP BY {key}, isl",
        f"a2{tag}": f"SELECT a.*, hit_frame - end_frame AS hit_gap FROM a1{tag} a JOIN {hits} h USING (phrase_id, side) WHERE n_frames >= {A.min_frames} AND effective_start IS NOT NULL",
        f"ax{tag}": f"SELECT *, hit_gap <= {A.max_hit_gap} AS near_hit, n_frames > {A.overlong_frames} AS overlong, hit_gap >= {A.early_end_gap} AS early_end FROM a2{tag} "
        f"WHERE NOT (n_frames > {A.overlong_frames} OR hit_gap >= {A.early_end_gap}) OR coalesce(max_body >= {A.body_angle_deg}, false)",
    }


ARM_OUT = "effective_start::BIGINT AS effective_start, near_hit, overlong, early_end"


@query("arm_extensions", sql(f"SELECT {OUT}, {ARM_OUT} FROM ax", "poses", "hits", **arm_ctes()))
def arm_extensions(spark, sf):
    rows = iv.arm_extensions(src.poses(spark, sf), ph.hits(spark, sf), A)
    return spanned(rows, big("effective_start").alias("effective_start"), "near_hit", "overlong", "early_end")


@query(
    "interval_stats",
    sql(
        f"SELECT {OUT}, {v.rnd('avg_reach')} AS avg_reach, {v.rnd('avg_elbow')} AS avg_elbow, {v.rnd('max_body')} AS max_body, effective_start::BIGINT AS effective_start FROM ax",
        "poses", "hits", **arm_ctes(),
    ),
)
def interval_stats(spark, sf):
    rows = iv.arm_extensions(src.poses(spark, sf), ph.hits(spark, sf), A)
    return spanned(
        rows, *[rnd(c).alias(c) for c in ("avg_reach", "avg_elbow", "max_body")], big("effective_start").alias("effective_start")
    )
