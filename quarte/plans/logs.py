"""Log parsing and time-to-frame queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.functions import codes
from quarte.operators import asof, logs
from quarte.operators.quantiles import middle
from quarte.operators.series import number, nearby, spread_join
from quarte.plans import views as v
from quarte.plans.registry import big, query, rnd, yes
from quarte.plans.views import sql
from quarte.session import shared_path
from quarte.sources import adapters as src, tables

AT = r"try_cast(nullif(regexp_extract(line, '(\d+\.\d+)s', 1), '') AS DOUBLE)"


def rx(pattern: str, group: int, opts: str = "") -> str:
    """Extracted group, NULL without a match."""
    return f"nullif(regexp_extract(line, '{opts}{pattern}', {group}), '')"


def last(value: str, cond: str = "true") -> str:
    return f"arg_max({value}, line_no) FILTER ({cond} AND {value} IS NOT NULL)"


def first(value: str, cond: str = "true") -> str:
    return f"arg_min({value}, line_no) FILTER ({cond} AND {value} IS NOT NULL)"


def lk(text: str) -> str:
    return f"contains(line, '{text}')"


LOGT = {"lt": f"SELECT *, {AT} AS tt FROM plog"}
BASE_LOG = {
    **LOGT,
    "lb": f"SELECT phrase_id, {last('tt', lk('Phrase recording started'))} AS start_time, {last('tt', lk('Simultaneous valid hits'))} AS sim, {last('tt', lk('Lockout period started'))} AS lockout, "
    f"{first('tt', lk('HIT:'))} AS first_hit, count(tt) FILTER ({lk('Off-Target: Blade-to-blade contact')}) AS n_contacts, "
    + ", ".join(f"upper({last(rx(f'Fencer {n}:' + chr(92) + 's*(' + chr(92) + 'w+)', 1, '(?i)'), lk('Scores ->'))}) AS f{n}" for n in (1, 2))
    + f", lower({last(rx('(Confirmed result winner|Manual selection winner):' + chr(92) + 's*(Right|Left)', 2, '(?i)'))}) AS winner FROM lt GROUP BY phrase_id",
}


@query(
    "phrase_log_base",
    sql(
        "SELECT phrase_id, CASE WHEN start_time IS NULL THEN 'no_start' WHEN NOT coalesce(f1 = 'HIT' AND f2 = 'HIT', false) THEN 'not_double' WHEN coalesce(sim, first_hit) IS NULL THEN 'no_hit' ELSE 'ok' END AS status, "
        "start_time, trunc(start_time * 15)::BIGINT AS start_frame, coalesce(sim, first_hit) AS hit_time, trunc(coalesce(sim, first_hit) * 15)::BIGINT AS hit_frame, lockout, n_contacts, coalesce(winner, 'unknown') AS winner FROM lb",
        "plog", **BASE_LOG,
    ),
)
def phrase_log_base(spark, sf):
    return logs.parse_base(src.phrase_log(spark, sf))


SC = r"Scores -> Fencer 1:\s*([A-Za-z]+),\s*Fencer 2:\s*([A-Za-z]+)"


@query(
    "phrase_log_fps30",
    sql(
        "SELECT phrase_id, coalesce(start_time, 0) AS start_time, coalesce(trunc(start_time * 30)::BIGINT, 0) AS start_frame, hit AS hit_time, trunc(hit * 30)::BIGINT AS hit_frame, lockout, n_contacts, winner FROM "
        "(SELECT *, CASE WHEN f1 = 'HIT' AND f2 = 'HIT' THEN coalesce(sim, max_hit, lockout, start_time) END AS hit FROM "
        f"(SELECT phrase_id, {last('tt', lk('Phrase recording started'))} AS start_time, {last('tt', lk('Simultaneous valid hits'))} AS sim, {last('tt', lk('Lockout period started'))} AS lockout, "
        f"max(tt) FILTER ({lk('| HIT:')}) AS max_hit, count(tt) FILTER ({lk('Off-Target: Blade-to-blade contact')}) AS n_contacts, upper({last(rx(SC, 1))}) AS f1, upper({last(rx(SC, 2))}) AS f2, "
        f"{last(rx('Winner: (' + chr(92) + 'w+)', 1))} AS winner FROM lt GROUP BY phrase_id))",
        "plog", **LOGT,
    ),
)
def phrase_log_fps30(spark, sf):
    return logs.parse_fps30(src.phrase_log(spark, sf))


SH = r"(\d+\.\d+)s\s*\|\s*HIT:\s*(Left|Right)\s+scores\s+on\s+(Left|Right)!"


@query(
    "side_hits",
    sql(f"SELECT phrase_id, line_no, time_s, scorer, trunc(time_s * 30)::BIGINT AS frame FROM (SELECT phrase_id, line_no, {rx(SH, 1)}::DOUBLE AS time_s, lower({rx(SH, 2)}) AS scorer, lower({rx(SH, 3)}) AS target FROM plog) WHERE scorer <> target", "plog"),
)
def side_hits(spark, sf):
    return logs.side_hits(src.phrase_log(spark, sf)).drop("target")


CT = r"^\s*([0-9]+(?:\.[0-9]+)?)s\s*\|\s*Off-Target:\s*Blade-to-blade contact\.[^\[]*(?:\[([^\]]+)\])?"


def norm(e: str) -> str:
    return f"trim(regexp_replace(lower(replace({e}, '_', ' ')), '\\s+', ' ', 'g'))"


@query(
    "contact_lines",
    sql(
        f"SELECT * FROM (SELECT phrase_id, {last('ct')} AS contact_time, {last('tag')} AS tag FROM (SELECT phrase_id, line_no, {rx(CT, 1, '(?i)')}::DOUBLE AS ct, {norm(rx(CT, 2, '(?i)'))} AS tag FROM plog) GROUP BY phrase_id) WHERE contact_time IS NOT NULL",
        "plog",
    ),
)
def contact_lines(spark, sf):
    return logs.contact_lines(src.phrase_log(spark, sf))


@query(
    "contact_before_hit",
    sql(
        "SELECT phrase_id, coalesce(pa, aa) AS contact_time, CASE WHEN pa IS NOT NULL THEN pt ELSE at2 END AS tag, first_hit, n_contacts FROM "
        "(SELECT phrase_id, max(tt) FILTER (ok) AS pa, max(tt) AS aa, arg_max(tag, tt * 1e6 - line_no) FILTER (ok) AS pt, arg_max(tag, tt * 1e6 - line_no) AS at2, max(first_hit) AS first_hit, count(*) AS n_contacts FROM "
        f"(SELECT c.*, first_hit, first_hit IS NULL OR tt <= first_hit + 1e-9 AS ok FROM (SELECT phrase_id, line_no, tt, coalesce({norm(rx('[[]([^]]+)[]]' + chr(92) + 's*$', 1))}, '-') AS tag FROM tl WHERE contains(lower(line), 'blade-to-blade contact')) c "
        "JOIN (SELECT phrase_id, arg_min(tt, line_no) FILTER (regexp_matches(line, '(?i)^[^|]*\\|\\s*hit:')) AS first_hit FROM tl GROUP BY phrase_id) USING (phrase_id)) GROUP BY phrase_id)",
        "plog", tl=f"SELECT phrase_id, line_no, line, {rx('^' + chr(92) + 's*([0-9]+(?:' + chr(92) + '.[0-9]+)?)s' + chr(92) + 's*' + chr(92) + '|', 1)}::DOUBLE AS tt FROM plog WHERE regexp_matches(line, '^\\s*[0-9]+(\\.[0-9]+)?s\\s*\\|')",
    ),
)
def contact_before_hit(spark, sf):
    return logs.contact_before_hit(src.phrase_log(spark, sf)).withColumn("tag", F.coalesce("tag", F.lit("-")))


@query(
    "actual_winner",
    sql(
        "SELECT phrase_id, coalesce(" + ", ".join(f"lower({first(rx(label + ':' + chr(92) + 's*(Right|Left|Abstain)', 1, '(?i)'))})" for label in logs.WINNER_LABELS) + ") AS winner FROM plog GROUP BY phrase_id",
        "plog",
    ),
)
def actual_winner(spark, sf):
    return logs.actual_winner(src.phrase_log(spark, sf))


@query("phrase_end_time", sql(f"SELECT * FROM (SELECT phrase_id, {last('tt', lk('Phrase recording ended'))} AS end_time FROM lt GROUP BY phrase_id) WHERE end_time > 0", "plog", **LOGT))
def phrase_end_time(spark, sf):
    return logs.end_time(src.phrase_log(spark, sf))


TI = r"tracking\s+indices\s*->\s*fencer\s*1:\s*(-?\d+)\s*,\s*fencer\s*2:\s*(-?\d+)\s*$"


@query(
    "tracking_indices",
    sql(f"SELECT * FROM (SELECT phrase_id, {last('a')} AS fencer_1, {last('b')} AS fencer_2 FROM (SELECT phrase_id, line_no, {rx(TI, 1, '(?i)')}::BIGINT AS a, {rx(TI, 2, '(?i)')}::BIGINT AS b FROM plog) GROUP BY phrase_id) WHERE fencer_1 IS NOT NULL", "plog"),
)
def tracking_indices(spark, sf):
    return logs.tracking_indices(src.phrase_log(spark, sf))


BL = r"([0-9]+(?:\.[0-9]+)?)s\s*\|\s*.*blade-to-blade"
TW = r"(confirmed result|manual selection) winner:\s*(left|right)"


@query(
    "training_log",
    sql(f"SELECT * FROM (SELECT phrase_id, {last('ct')} AS contact_time, {last('w')} AS winner FROM (SELECT phrase_id, line_no, {rx(BL, 1, '(?i)')}::DOUBLE AS ct, lower({rx(TW, 2, '(?i)')}) AS w FROM plog) GROUP BY phrase_id) WHERE contact_time IS NOT NULL AND winner IS NOT NULL", "plog"),
)
def training_log(spark, sf):
    return logs.training_log(src.phrase_log(spark, sf))


DEVICE = {
    "dev": "SELECT event_id, CASE event_type WHEN 'click' THEN 'LOG: ' || (event_id * 1500) || ' | HIT: Left scores on Right!' WHEN 'purchase' THEN 'LOG: ' || format('{:.3f}', event_id / 8.0) || '|Off-Target: Blade-to-blade contact.' "
    "WHEN 'signup' THEN 'STATE:RECORDING' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'LOG: plain text' ELSE 'SCORE: F1_ON' END ELSE CASE event_id % 3 WHEN 0 THEN '=== banner: x' WHEN 1 THEN 'no prefix here' ELSE 'LOG: soon | odd stamp' END END AS line FROM events"
}


@query(
    "log_messages",
    sql(
        "SELECT event_id, prefix, content, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN raw::BIGINT ELSE round_even(try_cast(raw AS DOUBLE) * 1000000, 0)::BIGINT END AS stamp_us, "
        "CASE WHEN raw IS NOT NULL THEN trim(substr(content, instr(content, '|') + 1)) WHEN prefix = 'LOG' THEN content END AS text FROM "
        "(SELECT *, CASE WHEN prefix = 'LOG' AND contains(content, '|') THEN trim(split_part(content, '|', 1)) END AS raw FROM (SELECT event_id, trim(split_part(line, ':', 1)) AS prefix, trim(substr(line, instr(line, ':') + 1)) AS content FROM dev WHERE contains(line, ':') AND NOT starts_with(line, '===')))",
        **DEVICE,
    ),
)
def log_messages(spark, sf):
    i, kind = F.col("event_id"), F.col("event_type")
    line = (
        F.when(kind == "click", F.concat(F.lit("LOG: "), (i * 1500).cast("string"), F.lit(" | HIT: Left scores on Right!")))
        .when(kind == "purchase", F.concat(F.lit("LOG: "), F.format_string("%.3f", i / 8.0), F.lit("|Off-Target: Blade-to-blade contact.")))
        .when(kind == "signup", "STATE:RECORDING")
        .when(kind == "error", F.when(i % 2 == 0, "LOG: plain text").otherwise("SCORE: F1_ON"))
        .when(i % 3 == 0, "=== banner: x")
        .when(i % 3 == 1, "no prefix here")
        .otherwise("LOG: soon | odd stamp")
    )
    rows = src.table(spark, sf, "events").select("event_id", line.alias("line"))
    return logs.device_lines(rows).select("event_id", "prefix", "content", "stamp_us", "text")


def user_signals(spark, sf):
    return src.signals(spark, sf).where("source = 'hit'").select("user_id", "idx", F.col("signal_ts").alias("ts"), "fight")


ASOF = {
    "af": "SELECT s.*, b.frame AS bframe, b.ts AS bts, a.frame AS aframe, a.ts AS ats FROM (SELECT user_id, idx, signal_ts AS t FROM signals WHERE source = 'hit') s "
    "ASOF LEFT JOIN (SELECT user_id, ts, max(frame) AS frame FROM frames GROUP BY ALL) b ON s.user_id = b.user_id AND s.t > b.ts "
    "ASOF LEFT JOIN (SELECT user_id, ts, min(frame) AS frame FROM frames GROUP BY ALL) a ON s.user_id = a.user_id AND s.t <= a.ts"
}
NEAREST = "CASE WHEN bframe IS NULL THEN aframe WHEN aframe IS NULL THEN bframe WHEN t - bts <= ats - t THEN bframe ELSE aframe END"
NEAREST_TS = NEAREST.replace("bframe ", "bts ").replace("THEN aframe", "THEN ats").replace("THEN bframe", "THEN bts").replace("ELSE aframe", "ELSE ats").replace("WHEN aframe", "WHEN ats")


@query(
    "asof_nearest_ts",
    sql(
        f"SELECT idx, ({NEAREST})::BIGINT AS nearest, coalesce(bframe, aframe)::BIGINT AS previous, coalesce(aframe, bframe)::BIGINT AS next, (t - CASE WHEN bframe IS NULL THEN ats WHEN aframe IS NULL THEN bts WHEN t - bts <= ats - t THEN bts ELSE ats END)::BIGINT AS delta_ms FROM af",
        "signals", "frames", **ASOF,
    ),
)
def asof_nearest_ts(spark, sf):
    rows = asof.neighbours(user_signals(spark, sf), src.frames(spark, sf), ["user_id"], "ts", "frame")
    for mode in ("previous", "next", "nearest"):
        rows = asof.pick(rows, "ts", mode).withColumn(mode, F.col("chosen.frame"))
    return rows.select("idx", "nearest", "previous", "next", (F.col("ts") - F.col("chosen.ts")).alias("delta_ms"))


@query(
    "asof_containing",
    sql(
        "SELECT idx, coalesce(cframe, 0)::BIGINT AS containing, coalesce(aframe, lastf)::BIGINT AS at_or_after, "
        "(CASE WHEN bframe IS NULL THEN 0 WHEN aframe IS NULL THEN lastf WHEN ats - t < t - bts THEN aframe ELSE bframe END)::BIGINT AS nearest FROM "
        "(SELECT af.*, c.frame AS cframe FROM af ASOF LEFT JOIN (SELECT user_id, ts, max(frame) AS frame FROM frames GROUP BY ALL) c ON af.user_id = c.user_id AND af.t >= c.ts) "
        "JOIN (SELECT user_id, max(frame) AS lastf FROM frames GROUP BY user_id) USING (user_id)",
        "signals", "frames", **ASOF,
    ),
)
def asof_containing(spark, sf):
    """Last frame not later, first frame not earlier, and nearest (right only if strictly closer)."""
    stamps = src.frames(spark, sf)
    rows = asof.neighbours(user_signals(spark, sf), stamps, ["user_id"], "ts", "frame")
    rows = asof.pick(rows, "ts").select("user_id", "idx", "ts", F.col("before.frame").alias("b"), F.col("after.frame").alias("a"), F.col("chosen.frame").alias("nearest"))
    held = asof.neighbours(rows, stamps, ["user_id"], "ts", "frame", inclusive=True)
    return held.where("coalesce(a, b) IS NOT NULL").select(
        "idx",
        F.coalesce("before.frame", F.lit(0)).cast("long").alias("containing"),
        F.coalesce("a", "b").alias("at_or_after"),
        "nearest",
    )


@query(
    "frame_ts_scan",
    sql("SELECT user_id, count(*) AS n_frames, min(ts) AS first_ts, max(ts) AS last_ts, max(frame)::BIGINT AS last_frame FROM frames GROUP BY user_id", "frames"),
)
def frame_ts_scan(spark, sf):
    """Frame stamps written as JSON lines and read back."""
    frames, path = src.frames(spark, sf), shared_path(spark, "stamps")
    stamps = frames.select(F.col("user_id").cast("string").alias("match_id"), "frame", "ts", F.lit(None).cast("long").alias("mono_ns"))
    tables.write_json(stamps, path)
    stored = tables.read_stamps(spark, path).withColumn("user_id", F.col("match_id").cast(frames.schema["user_id"].dataType))
    return stored.groupBy("user_id").agg(
        F.count("ts").alias("n_frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), big(F.max("frame")).alias("last_frame")
    )


def frame_gaps_ms(spark, sf):
    """Positive gaps between frame stamps of a user."""
    return nearby(
        src.frames(spark, sf), ["user_id"], "frame", 1, 0, lambda d, w: d.withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    ).where("gap > 0")


FPS_SQL = {
    "fgap": "SELECT user_id, gap FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY frame) AS gap FROM frames) WHERE gap > 0",
    "fps": "SELECT user_id, 1000.0::DOUBLE / list_sort(list(gap))[len(list(gap)) // 2 + 1] AS fps FROM fgap GROUP BY user_id",
}


@query("fps_infer", sql(f"SELECT user_id, {v.rnd('fps', 9)} AS fps FROM fps", "frames", **FPS_SQL))
def fps_infer(spark, sf):
    mid = middle(frame_gaps_ms(spark, sf), ["user_id"], F.col("gap"), "mid", upper=True)
    return mid.select("user_id", rnd(1000.0 / F.col("mid"), 9).alias("fps"))


SIG_SQL = {**FPS_SQL, "sig": "SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(fps) AS fps FROM frames LEFT JOIN fps USING (user_id) GROUP BY user_id"}


def signatures(spark, sf):
    rows = src.frames(spark, sf).groupBy("user_id").agg(F.count("ts").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    mid = middle(frame_gaps_ms(spark, sf), ["user_id"], F.col("gap"), "mid", upper=True)
    return rows.join(mid, "user_id", "left").withColumn("fps", 1000.0 / F.col("mid")).drop("mid")


@query(
    "stream_signature",
    sql(
        f"SELECT a.user_id, a.n AS frame_count, a.first_ts, a.last_ts, {v.rnd('a.fps', 9)} AS fps, coalesce(a.n = b.n AND abs(a.fps - b.fps) <= greatest(1e-3 * greatest(abs(a.fps), abs(b.fps)), 1e-3), false) AS same_as_next FROM sig a LEFT JOIN sig b ON b.user_id = a.user_id + 1",
        "frames", **SIG_SQL,
    ),
)
def stream_signature(spark, sf):
    """Signature of each stream, compared with the stream of the next user."""
    a = signatures(spark, sf)
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("n").alias("n2"), F.col("fps").alias("fps2"))
    near = F.abs(F.col("fps") - F.col("fps2")) <= F.greatest(1e-3 * F.greatest(F.abs("fps"), F.abs("fps2")), F.lit(1e-3))
    return a.join(b, "user_id", "left").select(
        "user_id", F.col("n").alias("frame_count"), "first_ts", "last_ts", rnd("fps", 9).alias("fps"), yes((F.col("n") == F.col("n2")) & near).alias("same_as_next")
    )


@query(
    "phrase_fps",
    sql(f"SELECT user_id, {v.rnd('CASE WHEN fps IS NULL OR fps < 0.00001 THEN 30 ELSE fps END', 9)} AS fps FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN fps USING (user_id)", "frames", **FPS_SQL),
)
def phrase_fps(spark, sf):
    """Inferred fps per phrase, 30 when there is no usable video."""
    users = src.table(spark, sf, "events").select("user_id").distinct()
    rows = users.join(signatures(spark, sf), "user_id", "left")
    fps = F.when(F.col("fps") >= 0.00001, F.col("fps")).otherwise(F.lit(30.0))
    return rows.select("user_id", rnd(fps, 9).alias("fps"))


@query(
    "timed_log_rewrite",
    sql(
        "SELECT phrase_id, line_no, CASE WHEN regexp_matches(line, '^\\s*\\d+\\.\\d{3}s\\s*\\|') THEN format('{:6.3f}s | ', t) || CASE WHEN f IS NULL THEN '' ELSE 'frame ' || format('{:06d}', f) || ' | ' END "
        "|| regexp_extract(line, '^\\s*\\d+\\.\\d{3}s\\s*\\|\\s*(.*)$', 1) ELSE line END AS line FROM "
        "(SELECT l.*, CASE WHEN b.frame IS NULL THEN a.frame WHEN a.frame IS NULL THEN b.frame WHEN ms - b.ts <= a.ts - ms THEN b.frame ELSE a.frame END AS f FROM plog l "
        "ASOF LEFT JOIN (SELECT user_id, ts, max(frame) AS frame FROM frames GROUP BY ALL) b ON l.phrase_id = b.user_id AND l.ms > b.ts "
        "ASOF LEFT JOIN (SELECT user_id, ts, min(frame) AS frame FROM frames GROUP BY ALL) a ON l.phrase_id = a.user_id AND l.ms <= a.ts)",
        "plog", "frames",
    ),
)
def timed_log_rewrite(spark, sf):
    stamps = src.frames(spark, sf).select(F.col("user_id").alias("phrase_id"), F.col("ts").alias("ms"), "frame")
    rows = asof.neighbours(src.phrase_log(spark, sf), stamps, ["phrase_id"], "ms", "frame")
    rows = asof.pick(rows, "ms").withColumn("frame", F.col("chosen.frame"))
    return logs.timed_lines(rows).select("phrase_id", "line_no", "line")


LEGACY = {
    "ff": "SELECT user_id, min(ts) AS t0 FROM frames GROUP BY user_id",
    "tm": "SELECT user_id, max(signal_ts) AS tt, user_id % 2 = 0 AS la, user_id % 3 = 0 AS lb FROM signals GROUP BY user_id",
    "sg": "SELECT s.user_id, idx, signal_ts, fight, greatest(0, (signal_ts - t0) / 1000.0::DOUBLE) AS rel FROM signals s JOIN ff USING (user_id) WHERE source = 'hit'",
    "sd": "SELECT user_id, max(CASE WHEN fight = 8 THEN 1 ELSE 0 END) AS hl, max(CASE WHEN fight = 9 THEN 1 ELSE 0 END) AS hr, arg_max(rel, signal_ts * 1000000 + idx % 1000000) FILTER (fight = 8) AS rl, "
    "arg_max(rel, signal_ts * 1000000 + idx % 1000000) FILTER (fight = 9) AS rr, min(rel) FILTER (fight IN (8, 9)) AS fs, count(*) FILTER (fight = 3) AS nb FROM sg GROUP BY user_id",
    "al": "SELECT f.user_id, t0, la, lb, greatest(0, (tt - t0) / 1000.0::DOUBLE) AS trel, coalesce(hl, 0) AS hl, coalesce(hr, 0) AS hr, rl, rr, fs, coalesce(nb, 0) AS nb FROM ff f JOIN tm USING (user_id) LEFT JOIN sd USING (user_id)",
    "ad": "SELECT *, la AND hl = 0 AS ml, lb AND hr = 0 AS mr FROM al",
    "fin": "SELECT *, CASE WHEN ml OR mr THEN least(fs, trel) ELSE fs END AS lock, greatest(CASE WHEN ml THEN trel ELSE rl END, CASE WHEN mr THEN trel ELSE rr END) AS sim FROM ad",
}
R73 = "format('{:7.3f}s | ', %s)"


@query(
    "legacy_log_sink",
    sql(
        "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY part, ts, idx))::INT AS line_no, line FROM ("
        "SELECT user_id, 0 AS part, 0 AS ts, 0 AS idx, '  0.000s | Phrase recording started' AS line FROM fin UNION ALL "
        "SELECT user_id, 1, 0, 0, '  0.000s | Timestamp mapping enabled' FROM fin UNION ALL "
        f"SELECT user_id, 2, signal_ts, idx, {R73 % 'rel'} || CASE fight WHEN 3 THEN 'Off-Target: Blade-to-blade contact.' WHEN 8 THEN 'HIT: Left scores on Right!' ELSE 'HIT: Right scores on Left!' END FROM sg WHERE fight IN (3, 8, 9) UNION ALL "
        f"SELECT user_id, 3, 0, 0, {R73 % 'trel'} || 'HIT: Left scores on Right!' FROM fin WHERE ml UNION ALL SELECT user_id, 3, 0, 1, {R73 % 'trel'} || 'HIT: Right scores on Left!' FROM fin WHERE mr UNION ALL "
        f"SELECT user_id, 4, 0, 0, {R73 % 'coalesce(lock, trel)'} || 'Lockout period started (0.200s window)' FROM fin WHERE hl + hr > 0 OR ml OR mr UNION ALL "
        f"SELECT user_id, 5, 0, 0, {R73 % 'sim'} || 'Simultaneous valid hits detected.' FROM fin WHERE la AND lb UNION ALL "
        "SELECT user_id, 6, 0, 0, 'Scores -> Fencer 1: ' || CASE WHEN lb THEN 'HIT' ELSE 'MISS' END || ', Fencer 2: ' || CASE WHEN la THEN 'HIT' ELSE 'MISS' END FROM fin UNION ALL "
        f"SELECT user_id, 7, 0, 0, {R73 % 'trel'} || 'Phrase ended' FROM fin UNION ALL SELECT user_id, 8, 0, 0, 'Blade contacts: ' || nb FROM fin)",
        "signals", "frames", **LEGACY,
    ),
)
def legacy_log_sink(spark, sf):
    """Signals, frames and final lights written as the lines of a phrase log."""
    stamps = src.frames(spark, sf).groupBy("user_id").agg(F.min("ts").alias("t0"))
    u = F.col("user_id")
    ends = src.signals(spark, sf).groupBy("user_id").agg(F.max("signal_ts").alias("tt"))
    heads = stamps.join(ends, "user_id").select(
        "user_id", "t0", (u % 2 == 0).alias("la"), (u % 3 == 0).alias("lb"),
        F.greatest(F.lit(0.0), (F.col("tt") - F.col("t0")) / 1000.0).alias("trel"),
    )
    hits = spread_join(user_signals(spark, sf), stamps, ["user_id"], F.col("idx")).withColumn(
        "rel", F.greatest(F.lit(0.0), (F.col("ts") - F.col("t0")) / 1000.0)
    )
    last = lambda n: F.max(F.when(F.col("fight") == n, F.struct("ts", "idx", "rel")))["rel"]
    sides = hits.groupBy("user_id").agg(
        last(8).alias("rl"), last(9).alias("rr"), F.min(F.when(F.col("fight").isin(8, 9), F.col("rel"))).alias("fs"),
        F.count_if(F.col("fight") == 3).alias("nb"),
    )
    rows = heads.join(sides, "user_id", "left")
    ml, mr = F.col("la") & F.col("rl").isNull(), F.col("lb") & F.col("rr").isNull()
    rows = rows.withColumns({"ml": ml, "mr": mr})
    added = F.col("ml") | F.col("mr")
    lock = F.when(added, F.least("fs", "trel")).otherwise(F.col("fs"))
    sim = F.greatest(F.when(F.col("ml"), F.col("trel")).otherwise(F.col("rl")), F.when(F.col("mr"), F.col("trel")).otherwise(F.col("rr")))
    at = lambda c, text: F.concat(F.format_string("%7.3fs | ", c), F.lit(text))
    word = lambda c: F.when(F.col(c), "HIT").otherwise("MISS")
    trel = F.col("trel")
    fixed = [
        (0, 0, F.lit(True), F.lit("  0.000s | Phrase recording started")),
        (1, 0, F.lit(True), F.lit("  0.000s | Timestamp mapping enabled")),
        (3, 0, F.col("ml"), at(trel, "HIT: Left scores on Right!")),
        (3, 1, F.col("mr"), at(trel, "HIT: Right scores on Left!")),
        (4, 0, added | F.col("fs").isNotNull(), at(F.coalesce(lock, trel), "Lockout period started (0.200s window)")),
        (5, 0, F.col("la") & F.col("lb"), at(sim, "Simultaneous valid hits detected.")),
        (6, 0, F.lit(True), F.concat(F.lit("Scores -> Fencer 1: "), word("lb"), F.lit(", Fencer 2: "), word("la"))),
        (7, 0, F.lit(True), at(trel, "Phrase ended")),
        (8, 0, F.lit(True), F.concat(F.lit("Blade contacts: "), F.coalesce("nb", F.lit(0)).cast("string"))),
    ]
    items = F.array(
        *[
            F.struct(F.lit(p).alias("part"), F.lit(0).cast("long").alias("ts"), F.lit(k).cast("long").alias("idx"), F.when(c, t).alias("line"))
            for p, k, c, t in fixed
        ]
    )
    frame = rows.select("user_id", F.inline(items)).where("line IS NOT NULL")
    scored = hits.where(F.col("fight").isin(3, 8, 9)).select(
        "user_id", F.lit(2).alias("part"), "ts", "idx",
        F.concat(
            F.format_string("%7.3fs | ", F.col("rel")),
            F.when(F.col("fight") == 3, "Off-Target: Blade-to-blade contact.").when(F.col("fight") == 8, "HIT: Left scores on Right!").otherwise("HIT: Right scores on Left!"),
        ).alias("line"),
    )
    lines = frame.unionByName(scored).withColumn("_chunk_key", F.struct("part", F.expr(f"ts div {src.HOUR_MS}")))
    out = number(lines, ["user_id"], "_chunk_key", ["part", "ts", "idx"], "line_no", start=1).withColumn("line_no", F.col("line_no").cast("int"))
    written, path = out.select("user_id", "line_no", "line"), shared_path(spark, "log")
    tables.write_json(written, path)
    return spark.read.schema(written.schema).json(path)
