"""Right-of-way decisions per phrase under both rule sets.

A phrase is described by a facts row: phrase_id, n (frames), left_hit and
right_hit (earliest hit frame per side, NULL when none), hit_time (earliest hit
in seconds), lockout (seconds, NULL when none). All joins with frame rows spread
hot phrases; everything else has a few rows per phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarte.operators import contacts as ct, intervals as iv
from quarte.operators.motion import mean_speed, mean_speed_base
from quarte.operators.series import overlap_join, spread_join
from quarte.params import PauseRules, Rules
from quarte.session import stage

SIDE = ["phrase_id", "side"]
# Joints the frame-rate rules read.
RULE_JOINTS = (5, 6, 8, 10, 11, 12, 13, 15, 16)


def other(side: Column) -> Column:
    return F.when(side == "left", "right").otherwise("left")


def cutoffs(facts: DataFrame) -> DataFrame:
    """(phrase_id, side, cutoff, hit_frame): frames after a side's first hit do not count."""
    last = F.col("n") - 1
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col(c), last))
    sided = facts.select(
        "phrase_id",
        "n",
        F.inline(
            F.array(
                F.struct(F.lit("left").alias("side"), F.when(F.col("left_hit").isNotNull(), clamp("left_hit")).alias("hit_frame")),
                F.struct(F.lit("right").alias("side"), F.when(F.col("right_hit").isNotNull(), clamp("right_hit")).alias("hit_frame")),
            )
        ),
    )
    return sided.withColumn("cutoff", F.coalesce("hit_frame", F.col("n") - 1))


def truncate(poses: DataFrame, cuts: DataFrame) -> DataFrame:
    """Frames up to the cutoff of their side."""
    rows = spread_join(poses, cuts.select(*SIDE, "cutoff"), SIDE, F.col("frame"))
    return rows.where(F.col("frame") <= F.col("cutoff")).drop("cutoff")


def select_contact(contacts: DataFrame, facts: DataFrame, seconds: float) -> DataFrame:
    """Last contact in log order within ``seconds`` before the earliest hit and
    before the lockout."""
    marks = facts.select("phrase_id", "hit_time", "lockout", F.least("left_hit", "right_hit", F.col("n") - 1).alias("hit_frame"))
    t, hit = F.col("time_s"), F.col("hit_time")
    rows = spread_join(contacts, marks, ["phrase_id"], F.col("line_no")).where(
        (t >= hit - seconds)
        & (t < hit)
        & (F.col("lockout").isNull() | (t < F.col("lockout")))
        & (F.col("frame") <= F.col("hit_frame"))
    )
    pick = F.max_by(F.struct("frame", "time_s"), "line_no")
    return rows.groupBy("phrase_id").agg(pick["frame"].alias("contact_frame"), pick["time_s"].alias("contact_time"))


def pause_overlap(pauses: DataFrame, rules: Rules, fps: float) -> DataFrame:
    """Per phrase: paused frames per side, shared frames, share and the verdict."""
    side = lambda s: pauses.where(F.col("side") == s).select(
        "phrase_id", F.col("start_frame").alias(f"{s}_start"), F.col("end_frame").alias(f"{s}_end")
    )
    both = overlap_join(
        side("left"), side("right"), ["phrase_id"], ("left_start", "left_end"), ("right_start", "right_end")
    )
    shared = F.least("left_end", "right_end") - F.greatest("left_start", "right_start") + 1
    shared = both.groupBy("phrase_id").agg(F.sum(shared).alias("shared"))
    length = F.col("end_frame") - F.col("start_frame") + 1
    per = {
        f"{s}_{n}": f(F.when(F.col("side") == s, c))
        for s in ("left", "right")
        for n, f, c in (("paused", F.sum, length), ("last_end", F.max, F.col("end_frame")))
    }
    totals = pauses.groupBy("phrase_id").agg(*[c.alias(n) for n, c in per.items()])
    limit = fps * rules.overlap_seconds
    ratio = F.coalesce("shared", F.lit(0)) / F.greatest("left_paused", "right_paused")
    ok = (
        (F.col("left_paused") < limit)
        & (F.col("right_paused") < limit)
        & (F.col("ratio") >= rules.overlap_share)
        & (F.abs(F.col("left_last_end") - F.col("right_last_end")) <= rules.overlap_end_gap)
    )
    return (
        totals.join(shared, "phrase_id", "left")
        .withColumn("ratio", ratio)
        .withColumn("overlap_ok", F.coalesce(ok, F.lit(False)))
    )


def latest_pauses(pauses: DataFrame) -> DataFrame:
    """Last end and the earliest start among the pauses that end last."""
    last = F.max(F.struct("end_frame", (-F.col("start_frame")).alias("neg")))
    return pauses.groupBy(*SIDE).agg(last["end_frame"].alias("last_end"), (-last["neg"]).alias("last_start"))


def harmful(arms: DataFrame, lunges: DataFrame) -> DataFrame:
    """Harmful arm extensions and penalising lunges as one event list."""
    a = arms.where(F.col("overlong") | F.col("early_end")).withColumn("type", F.lit("harmful_arm_extension"))
    b = lunges.where("is_penalizing").withColumn("type", F.lit("harmful_lunge"))
    cols = [*SIDE, "type", "start_frame", "end_frame"]
    return a.select(*cols).unionByName(b.select(*cols))


def harm_in_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Number of harmful events that touch the window of their side, per phrase."""
    rows = spread_join(events, windows, SIDE, F.col("start_frame"))
    touch = (F.col("end_frame") >= F.col("w_start")) & (F.col("start_frame") <= F.col("w_end"))
    return rows.where(touch).groupBy("phrase_id").agg(F.count(F.lit(1)).alias("n_harm"))


def latest_event(pauses: DataFrame, harm: DataFrame, rules: Rules) -> DataFrame:
    """Latest reset or harmful event over both sides by (buffered end, start).

    Per side and type only the latest counts. The side of the last event loses;
    a tie between the sides goes to right."""
    kinds = pauses.withColumn("type", F.when(F.col("is_retreat"), "retreat").otherwise("pause"))
    cols = [*SIDE, "type", "start_frame", "end_frame"]
    events = kinds.select(*cols).unionByName(harm)
    buffer = (
        F.when(F.col("type") == "harmful_lunge", rules.lunge.response_buffer)
        .when(F.col("type") == "harmful_arm_extension", rules.arm.response_buffer)
        .otherwise(0)
    )
    # On equal frames of one side the pause is named first, then the lunge.
    order = F.when(F.col("type") == "harmful_lunge", 1).when(F.col("type") == "harmful_arm_extension", 0).otherwise(2)
    rank = F.struct((F.col("end_frame") + buffer).alias("until"), "start_frame", order.alias("order"), "type")
    pick = lambda s: F.max(F.when(F.col("side") == s, rank)).alias(s)
    tops = events.groupBy("phrase_id").agg(pick("left"), pick("right"))
    left, right = F.col("left"), F.col("right")
    when = lambda e: F.struct(e["until"], e["start_frame"])
    loser = (
        F.when(right.isNull(), "left")
        .when(left.isNull(), "right")
        .when(when(left) > when(right), "left")
        .when(when(right) > when(left), "right")
        .otherwise("tie")
    )
    return tops.withColumn("loser", loser).select(
        "phrase_id",
        "loser",
        F.when(F.col("loser") == "right", "left").otherwise("right").alias("right_of_way"),
        F.when(F.col("loser") == "right", right["until"]).otherwise(left["until"]).alias("until_frame"),
        F.when(F.col("loser") == "left", left["type"])
        .when(F.col("loser") == "right", right["type"])
        .otherwise("tie")
        .alias("event_type"),
    )


def attack_window(poses: DataFrame, windows: DataFrame, lunges: DataFrame, slow: DataFrame, rules: Rules) -> DataFrame:
    """Compare both attacks inside a window per side.

    ``windows`` is (phrase_id, side, w_start, w_end), ``slow`` lists the sides
    with a slow start. Order of tests: near-hit arm extension, beneficial lunge,
    weighted start, slow start, speed (equal goes right)."""
    spans = windows.withColumn("w_end", F.greatest("w_start", "w_end"))
    inside = spread_join(poses, spans, SIDE, F.col("frame")).where(
        (F.col("frame") >= F.col("w_start")) & (F.col("frame") <= F.col("w_end"))
    )
    wide = spans.where(F.col("w_end") - F.col("w_start") >= 1)
    arms = iv.arm_extensions(inside, wide.select(*SIDE, F.col("w_end").alias("hit_frame")), rules.arm)
    near = arms.where("near_hit").groupBy(*SIDE).agg(F.max_by("effective_start", "start_frame").alias("arm_start"))
    good = spread_join(lunges.where(~F.col("is_penalizing")), spans, SIDE, F.col("start_frame")).where(
        (F.col("start_frame") >= F.col("w_start")) & (F.col("end_frame") <= F.col("w_end"))
    )
    good = good.groupBy(*SIDE).agg(F.max(F.struct("end_frame", "start_frame"))["start_frame"].alias("lunge_start"))
    speed = mean_speed(inside).select(*SIDE, "speed")
    sides = (
        spans.join(near, SIDE, "left")
        .join(good, SIDE, "left")
        .join(slow.select(*SIDE, F.lit(True).alias("slow")), SIDE, "left")
        .join(speed, SIDE, "left")
    )
    picks = [
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
        for s in ("left", "right")
        for c in ("arm_start", "lunge_start", "slow", "speed")
    ]
    rows = sides.groupBy("phrase_id").agg(*picks)
    col = F.col
    la, ra = col("left_arm_start").isNotNull(), col("right_arm_start").isNotNull()
    ll, rl = col("left_lunge_start").isNotNull(), col("right_lunge_start").isNotNull()
    ls, rs = col("left_slow").isNotNull(), col("right_slow").isNotNull()

    def start(s: str) -> Column:
        arm, lunge = col(f"{s}_arm_start"), col(f"{s}_lunge_start")
        mix = (arm * rules.arm_weight + lunge * rules.lunge_weight) / (rules.arm_weight + rules.lunge_weight)
        return F.when(la & ra & ll & rl, mix).when(la & ra, arm.cast("double")).when(ll & rl, lunge.cast("double"))

    lw, rw = start("left"), start("right")
    return rows.withColumns({"lw": lw, "rw": rw}).select(
        "phrase_id",
        F.when(la != ra, F.when(la, "left").otherwise("right"))
        .when(ll != rl, F.when(ll, "left").otherwise("right"))
        .when(col("lw") < col("rw"), "left")
        .when(col("rw") < col("lw"), "right")
        .when(ls & ~rs, "right")
        .when(rs & ~ls, "left")
        .when(F.coalesce("left_speed", F.lit(0.0)) > F.coalesce("right_speed", F.lit(0.0)), "left")
        .otherwise("right")
        .alias("winner"),
        F.when(la != ra, "near-hit arm extension")
        .when(ll != rl, "beneficial lunge")
        .when(col("lw") != col("rw"), "weighted signal start is earlier")
        .when(ls != rs, "slow-start penalty")
        .otherwise("faster")
        .alias("basis"),
    )


def judge(
    poses: DataFrame, facts: DataFrame, contacts: DataFrame, hits: DataFrame, rules: Rules, fps: float, pixels: float
) -> DataFrame:
    """Verdict per phrase under the frame-rate rule set.

    ``pixels`` turns normalised joints back into pixels for the contact
    classifiers. Winner is left, right or none."""
    cuts = cutoffs(facts)
    # The cut poses feed eight operators: one join with the cutoffs, one copy of
    # the joints the rules read.
    used = [f"{a}{k}" for k in RULE_JOINTS for a in "xy"]
    rows = stage(truncate(poses.select(*SIDE, "frame", *used), cuts))
    # Interval tables are small and read by several tests below: stage each once.
    marked = stage(iv.slow_starts(iv.pauses(rows, rules.pause, fps), rules, fps))
    pauses = marked.where(~F.col("is_slow_start"))
    slow = marked.where("is_slow_start").select(*SIDE).distinct()
    last_frame = facts.select("phrase_id", (F.col("n") - 1).alias("last_frame"))
    clamped = spread_join(hits, last_frame, ["phrase_id"], F.col("hit_frame")).select(
        *SIDE, F.greatest(F.lit(0), F.least("hit_frame", "last_frame")).alias("hit_frame")
    ).distinct()
    lunges = stage(iv.lunges(rows, clamped, rules.lunge, rules.pause, fps))
    arms = iv.arm_extensions(rows, cuts.select(*SIDE, F.col("cutoff").alias("hit_frame")), rules.arm)
    harm = stage(harmful(arms, lunges))

    shared_end = cuts.groupBy("phrase_id").agg(F.min("cutoff").alias("shared_max"))
    chosen = select_contact(contacts, facts, rules.contact_seconds).join(shared_end, "phrase_id")
    chosen = chosen.where(F.col("contact_frame") <= F.col("shared_max"))
    events = chosen.join(facts.select("phrase_id", "n"), "phrase_id").select(
        "phrase_id", F.bround(F.col("contact_time") * fps).cast("int").alias("event_frame"), "n"
    )
    in_pixels = poses.withColumns({c: F.expr(f"{c} * {pixels!r}D") for c in poses.columns if c[0] in "xy"})
    calls = stage(ct.judge_contacts(in_pixels, events, rules.contact, fps).select("phrase_id", "is_accident", "benefit_side"))
    effective = calls.where(~F.col("is_accident")).select("phrase_id", F.col("benefit_side").alias("blade_side"))

    overlap = pause_overlap(pauses, rules, fps)
    base = (
        facts.select("phrase_id", "n")
        .join(shared_end, "phrase_id")
        .join(overlap, "phrase_id", "left")
        .join(effective, "phrase_id", "left")
    )
    no_contact = F.col("blade_side").isNull()
    unpaused = F.col("left_paused").isNull() & F.col("right_paused").isNull()
    mode = F.when(no_contact & F.coalesce("overlap_ok", F.lit(False)), "overlap").when(no_contact & unpaused, "no_pause")
    base = stage(base.withColumn("mode", mode))
    paused_end = F.when(F.col("side") == "left", F.col("left_last_end")).otherwise(F.col("right_last_end"))
    overlapping = F.col("mode") == "overlap"
    windows = (
        cuts.join(base.where(F.col("mode").isNotNull()).select("phrase_id", "mode", "shared_max", "left_last_end", "right_last_end"), "phrase_id")
        .select(
            *SIDE,
            F.when(overlapping, F.coalesce(paused_end, F.lit(0))).otherwise(0).alias("w_start"),
            F.when(overlapping, F.coalesce("hit_frame", "shared_max")).otherwise(F.col("cutoff")).alias("w_end"),
        )
    )
    blocked = harm_in_windows(harm, windows)
    open_windows = windows.join(blocked.select("phrase_id"), "phrase_id", "left_anti")
    attack = attack_window(rows, open_windows, lunges, slow, rules)
    latest = latest_event(pauses, harm, rules)
    out = (
        base.join(attack, "phrase_id", "left")
        .join(latest, "phrase_id", "left")
        .join(calls.select("phrase_id", "is_accident"), "phrase_id", "left")
    )
    row = F.coalesce("right_of_way", F.lit("none"))
    return out.select(
        "phrase_id",
        F.coalesce("winner", "blade_side", row).alias("winner"),
        F.when(F.col("winner").isNotNull(), F.concat("mode", F.lit(": "), "basis"))
        .when(F.col("blade_side").isNotNull() & (F.col("blade_side") == row), "blade contact favored")
        .when(F.col("blade_side").isNotNull(), "blade contact overrode")
        .otherwise(F.coalesce("event_type", F.lit("no event")))
        .alias("reason"),
        row.alias("right_of_way"),
        F.col("is_accident").isNotNull().alias("contact_judged"),
        F.coalesce("is_accident", F.lit(False)).alias("accident"),
    )


def contact_variance(poses: DataFrame, contacts: DataFrame, before: int = 8, after: int = 3) -> DataFrame:
    """Sample variance of the weapon wrist around a contact, per phrase: joint 10
    left, joint 9 right. ``contacts`` is (phrase_id, event_frame, n)."""
    left = F.col("side") == "left"
    x = F.when(left, F.col("x10")).otherwise(F.col("x9"))
    y = F.when(left, F.col("y10")).otherwise(F.col("y9"))
    rows = ct.around(poses, contacts, before, after)
    rows = rows.select(*SIDE, x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    sides = rows.groupBy(*SIDE).agg(
        F.count("x").alias("samples"),
        (F.coalesce(F.var_samp("x"), F.lit(0.0)) + F.coalesce(F.var_samp("y"), F.lit(0.0))).alias("variance"),
    )
    pick = lambda s, c: F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0))
    found = sides.groupBy("phrase_id").agg(
        *[pick(s, c).alias(f"{s}_{c}") for s in ("left", "right") for c in ("samples", "variance")]
    )
    span = F.greatest(F.lit(0), F.col("event_frame") - before) < F.least(F.col("event_frame") + after, F.col("n") - 1)
    kept = contacts.where(span).select("phrase_id")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("left_samples", "right_samples", "left_variance", "right_variance")]
    return contacts.select("phrase_id").join(found.join(kept, "phrase_id", "left_semi"), "phrase_id", "left").select(
        "phrase_id", *zero
    )


def variance_winner(right_of_way: Column, threshold: float = 0.1) -> Column:
    """Side favoured by the wrist variance, given the current right of way."""
    l, r = F.col("left_variance"), F.col("right_variance")
    return (
        F.when(right_of_way == "left", F.when(l > threshold, "left").otherwise("right"))
        .when(right_of_way == "right", F.when(r > threshold, "right").otherwise("left"))
        .otherwise(F.when(l > r, "left").otherwise("right"))
    )


def judge_base(poses: DataFrame, contacts: DataFrame, phrases: DataFrame, rules: PauseRules, fps: float) -> DataFrame:
    """Verdict per phrase under the older rule set: first pause, then contact
    variance at the first contact, then speed, then right."""
    first = iv.pauses(poses, rules, fps).groupBy(*SIDE).agg(F.min("start_frame").alias("first_pause"))
    speed = mean_speed_base(poses)
    sides = speed.join(first, SIDE, "left")
    picks = [
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
        for s in ("left", "right")
        for c in ("first_pause", "speed")
    ]
    sides = sides.groupBy("phrase_id").agg(*picks)
    first_contact = contacts.groupBy("phrase_id").agg(F.min_by("frame", "line_no").alias("event_frame"))
    first_contact = first_contact.join(phrases.select("phrase_id", "n"), "phrase_id")
    variance = contact_variance(poses, first_contact)
    rows = phrases.select("phrase_id").join(sides, "phrase_id", "left").join(variance, "phrase_id", "left")
    lp, rp = F.col("left_first_pause"), F.col("right_first_pause")
    way = (
        F.when(lp.isNotNull() & rp.isNull(), "right")
        .when(rp.isNotNull() & lp.isNull(), "left")
        .when(lp < rp, "right")
        .when(lp.isNotNull(), "left")
        .otherwise("none")
    )
    ls, rs = F.coalesce("left_speed", F.lit(0.0)), F.coalesce("right_speed", F.lit(0.0))
    blade = F.when(F.col("left_variance").isNotNull(), variance_winner(F.col("way"))).otherwise("none")
    return (
        rows.withColumn("way", way)
        .withColumn("blade", blade)
        .select(
            "phrase_id",
            F.when(F.col("way") != "none", F.col("way"))
            .when(F.col("blade") != "none", F.col("blade"))
            .when(ls > rs * 1.2, "left")
            .otherwise("right")
            .alias("winner"),
            F.col("way").alias("right_of_way"),
            F.col("blade").alias("blade_analysis"),
        )
    )
