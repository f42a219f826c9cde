"""Outlier detection and repair of limb joints.

Every frame is measured once (steps, prediction errors, bone lengths), the
thresholds come from exact medians per phrase and side, and the flags are
computed on the frame row. Repair replaces short flagged runs by a line between
their neighbours: first whole limbs, then single joints on the repaired data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarte.operators.quantiles import middle
from quarte.operators.series import nearby, runs, spread_join
from quarte.session import stage

SIDE = ["phrase_id", "side"]
# Joints under repair, their bones, limbs and limits.
BONES = {
    7: ((5, 7), (7, 9)), 8: ((6, 8), (8, 10)), 9: ((7, 9),), 10: ((8, 10),),
    13: ((11, 13), (13, 15)), 14: ((12, 14), (14, 16)), 15: ((13, 15),), 16: ((14, 16),),
}
TARGETS = tuple(BONES)
ALL_BONES = ((5, 7), (7, 9), (6, 8), (8, 10), (11, 13), (13, 15), (12, 14), (14, 16))
LIMBS = {"left_arm": (7, 9), "right_arm": (8, 10), "left_leg": (13, 15), "right_leg": (14, 16)}
STEP_FLOOR, PRED_FLOOR, STRONG, BONE_LOW, BONE_HIGH = 0.30, 0.18, 1.35, 0.55, 1.60
LIMB_RUN, JOINT_RUN, BRIDGE = 8, 4, 2


def measures(wide: DataFrame) -> DataFrame:
    """Per frame: in_J (step into), step_J (larger step), pred_J (distance to the
    midpoint of the neighbours) and len_A_B, with the joints used."""
    used = sorted({k for bone in ALL_BONES for k in bone})
    rows = wide.select(*SIDE, "frame", *[f"{a}{k}" for k in used for a in "xy"])

    def build(d, w):
        near = {}
        for k in TARGETS:
            for a in "xy":
                near[f"_p{a}{k}"] = F.lag(f"{a}{k}").over(w)
                near[f"_n{a}{k}"] = F.lead(f"{a}{k}").over(w)
        return d.withColumns(near)

    rows = nearby(rows, SIDE, "frame", 1, 1, build)
    out = {}
    for k in TARGETS:
        out[f"in_{k}"] = F.expr(f"sqrt(power(x{k} - _px{k}, 2) + power(y{k} - _py{k}, 2))")
        out[f"_out_{k}"] = F.expr(f"sqrt(power(x{k} - _nx{k}, 2) + power(y{k} - _ny{k}, 2))")
        out[f"pred_{k}"] = F.expr(
            f"sqrt(power(x{k} - 0.5D * (_px{k} + _nx{k}), 2) + power(y{k} - 0.5D * (_py{k} + _ny{k}), 2))"
        )
    for a, b in ALL_BONES:
        out[f"len_{a}_{b}"] = F.expr(f"sqrt(power(x{a} - x{b}, 2) + power(y{a} - y{b}, 2))")
    rows = rows.withColumns(out)
    rows = rows.withColumns({f"step_{k}": F.expr(f"coalesce(greatest(in_{k}, _out_{k}), 0D)") for k in TARGETS})
    keep = ["frame", *[f"x{k}" for k in TARGETS]]
    keep += [f"{m}_{k}" for m in ("in", "step", "pred") for k in TARGETS] + [f"len_{a}_{b}" for a, b in ALL_BONES]
    return rows.select(*SIDE, *keep)


def _long(rows: DataFrame, names: list[str]) -> DataFrame:
    items = ", ".join(f"named_struct('measure', '{n}', 'v', {n})" for n in names)
    return rows.selectExpr(*SIDE, f"inline(array({items}))").where("v IS NOT NULL")


def bone_medians(wide: DataFrame) -> DataFrame:
    """Median length per phrase, side and bone."""
    names = [f"len_{a}_{b}" for a, b in ALL_BONES]
    lengths = wide.selectExpr(
        *SIDE, *[f"sqrt(power(x{a} - x{b}, 2) + power(y{a} - y{b}, 2)) AS len_{a}_{b}" for a, b in ALL_BONES]
    )
    return middle(_long(lengths, names), [*SIDE, "measure"], F.col("v"), "med")


def outlier_limit(values: DataFrame, keys: list[str], floor: Column, med: DataFrame | None = None) -> DataFrame:
    """max(floor, 3 medians, median + 4 median absolute deviations) per key.

    The medians are read twice, so they are a stored table; one at hand may be given."""
    med = stage(middle(values, keys, F.col("v"), "med")) if med is None else med
    spread = spread_join(values, med, keys, F.col("v")).withColumn("v", F.abs(F.col("v") - F.col("med")))
    mad = middle(spread, keys, F.col("v"), "mad")
    both = med.join(mad.hint("merge"), keys)  # packed files of medians look small enough to broadcast
    return both.withColumn("limit", F.greatest(floor, F.col("med") * 3.0, F.col("med") + 4.0 * F.col("mad")))


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per phrase and side: lim_in_J, lim_pred_J and med_A_B."""
    moves = [f"{m}_{k}" for m in ("in", "pred") for k in TARGETS]
    floor = F.when(F.col("measure").startswith("in_"), STEP_FLOOR).otherwise(PRED_FLOOR)
    keys = [*SIDE, "measure"]
    lengths = [f"len_{a}_{b}" for a, b in ALL_BONES]
    med = stage(middle(_long(measured, moves + lengths), keys, F.col("v"), "med"))
    is_length = F.col("measure").isin(lengths)
    limits = outlier_limit(_long(measured, moves), keys, floor, med.where(~is_length)).select(*keys, F.col("limit").alias("v"))
    meds = med.where(is_length).withColumnRenamed("med", "v")
    picks = [F.max(F.when(F.col("measure") == n, F.col("v"))).alias(f"lim_{n}") for n in moves + lengths]
    return limits.unionByName(meds).groupBy(*SIDE).agg(*picks)


def anomalies(wide: DataFrame) -> DataFrame:
    """Flagged joints: phrase_id, side, frame, joint, reason, max_step, pred_error."""
    measured = stage(measures(wide))
    rows = spread_join(measured, thresholds(measured), SIDE, F.col("frame"), "left")
    items = []
    for k in TARGETS:
        step = f"coalesce(lim_in_{k}, {STEP_FLOOR}D)"
        pred = f"coalesce(lim_pred_{k}, {PRED_FLOOR}D)"
        odd = " + ".join(
            f"int(coalesce(lim_len_{a}_{b} > 1e-6D AND (len_{a}_{b} < {BONE_LOW}D * lim_len_{a}_{b} "
            f"OR len_{a}_{b} > {BONE_HIGH}D * lim_len_{a}_{b}), false))"
            for a, b in BONES[k]
        )
        reason = (
            f"CASE WHEN x{k} IS NULL THEN NULL "
            f"WHEN step_{k} >= {STRONG}D * {step} OR pred_{k} >= {STRONG}D * {pred} THEN 'strong_temporal_outlier' "
            f"WHEN (step_{k} >= {step} OR pred_{k} >= {pred}) AND {odd} >= 1 THEN 'temporal_plus_bone_outlier' "
            f"WHEN {odd} >= 2 THEN 'multi_bone_outlier' END"
        )
        items.append(f"named_struct('joint', {k}, 'reason', {reason}, 'max_step', step_{k}, 'pred_error', pred_{k})")
    flagged = rows.selectExpr(*SIDE, "frame", f"inline(array({', '.join(items)}))")
    return flagged.where("reason IS NOT NULL")


def _line(rows: DataFrame, keys: list[str], wide: DataFrame, limit: int, joints: Column) -> DataFrame:
    """Status of each run and, where it is interpolated, the anchors of its joints.

    ``rows`` has keys, start_frame, end_frame, n; ``joints`` is an array column."""
    length = F.col("end_frame") - F.col("start_frame") + 1
    status = F.when(length > limit, "skipped_long_run").when(
        (F.col("start_frame") <= 0) | (F.col("end_frame") >= F.col("n") - 1), "skipped_edge_run"
    )
    todo = rows.withColumns({"length": length, "status": status, "kp": F.explode(joints)})
    points = ", ".join(f"named_struct('kp', {k}, 'x', x{k}, 'y', y{k})" for k in TARGETS)
    long = wide.selectExpr(*SIDE, "frame", f"inline(array({points}))")
    anchor = lambda p: long.select(
        *SIDE, "kp", F.col("frame").alias(f"{p}_frame"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")
    )
    todo = todo.withColumns({"a_frame": F.col("start_frame") - 1, "b_frame": F.col("end_frame") + 1})
    todo = todo.join(anchor("a"), [*SIDE, "kp", "a_frame"], "left").join(anchor("b"), [*SIDE, "kp", "b_frame"], "left")
    return todo


def _finish(todo: DataFrame, run: list[str]) -> DataFrame:
    """A run is interpolated only when all its joints have both anchors."""
    bad = F.max(F.when(F.col("ax").isNull() | F.col("bx").isNull(), 1).otherwise(0)).alias("_bad")
    verdict = todo.groupBy(*run).agg(bad, F.max("status").alias("_status"), F.max("length").alias("_length"))
    status = F.coalesce("_status", F.when(F.col("_bad") == 1, "skipped_missing_anchor").otherwise("interpolated"))
    return verdict.select(*run, F.col("_length").alias("length"), status.alias("status"))


def _apply(wide: DataFrame, todo: DataFrame, log: DataFrame, run: list[str]) -> DataFrame:
    """Write the lines of interpolated runs into the pose table."""
    done = log.where("status = 'interpolated'").select(*run).hint("merge")  # runs follow the poses, as do cells
    good = todo.drop("status", "length").join(done, run, "left_semi")
    cells = good.withColumn("frame", F.explode(F.sequence("start_frame", "end_frame")))
    alpha = (F.col("frame") - F.col("a_frame")) / (F.col("b_frame") - F.col("a_frame"))
    cells = cells.withColumns({c: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * alpha for c in "xy"})
    picks = [F.max(F.when(F.col("kp") == k, F.col(c))).alias(f"_{c}{k}") for k in TARGETS for c in "xy"]
    fresh = cells.groupBy(*SIDE, "frame").agg(*picks)
    out = wide.join(fresh.hint("merge"), [*SIDE, "frame"], "left")
    return out.withColumns({f"{c}{k}": F.coalesce(f"_{c}{k}", f"{c}{k}") for k in TARGETS for c in "xy"}).select(
        *wide.columns
    )


def repair_limbs(wide: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolate runs of limbs with two flagged joints; returns poses and the log."""
    sizes = wide.groupBy(*SIDE).agg((F.max("frame") + 1).alias("n"))
    limb = F.coalesce(*[F.when(F.col("joint").isin(*js), F.lit(name)) for name, js in LIMBS.items()])
    marks = flagged.select(*SIDE, "frame", "joint", limb.alias("limb"))
    active = (
        marks.groupBy(*SIDE, "limb").agg(F.min("joint").alias("_a"), F.max("joint").alias("_b")).where("_a <> _b")
    )
    frames = marks.select(*SIDE, "limb", "frame").distinct()
    keys = [*SIDE, "limb"]
    found = runs(spread_join(frames, active.select(*keys), keys, F.col("frame")), keys, "frame", F.lit(True), gap=BRIDGE)
    found = spread_join(found, sizes, SIDE, F.col("start_frame"))
    joints = F.coalesce(*[F.when(F.col("limb") == n, F.array(*[F.lit(j) for j in js])) for n, js in LIMBS.items()])
    run = [*keys, "start_frame", "end_frame"]
    todo = stage(_line(found, keys, wide, LIMB_RUN, joints))
    log = _finish(todo, run)
    return _apply(wide, todo, log, run), log


def repair_joints(wide: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolate runs of single joints; returns poses and the log."""
    sizes = wide.groupBy(*SIDE).agg((F.max("frame") + 1).alias("n"))
    keys = [*SIDE, "joint"]
    found = runs(flagged.select(*keys, "frame"), keys, "frame", F.lit(True), gap=BRIDGE)
    found = spread_join(found, sizes, SIDE, F.col("start_frame"))
    run = [*keys, "start_frame", "end_frame"]
    todo = stage(_line(found, keys, wide, JOINT_RUN, F.array("joint")))
    log = _finish(todo, run)
    return _apply(wide, todo, log, run), log


def repair(wide: DataFrame) -> dict[str, DataFrame]:
    """Both passes: repaired poses, the logs and the flags before and after."""
    before = stage(anomalies(wide))
    limbed, limb_log = repair_limbs(wide, before)
    limbed = stage(limbed)
    between = stage(anomalies(limbed))
    fixed, joint_log = repair_joints(limbed, between)
    fixed = stage(fixed)
    return {
        "poses": fixed, "limb_log": limb_log, "joint_log": joint_log, "before": before, "after": anomalies(fixed),
    }
