"""Match-side queries: frames, messages, records, results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarte.functions import codes
from quarte.operators import matches as mt
from quarte.operators.series import nearby, number
from quarte.plans import views as v
from quarte.plans.registry import big, query, rnd, yes
from quarte.plans.views import sql
from quarte.session import shared_path
from quarte.sources import adapters as src, tables

MS = "(epoch_us(ts) // 1000)"


def events(spark, sf):
    return src.table(spark, sf, "events").withColumn("ms", src.millis("ts"))


def hourly(df, col="ts"):
    return df.withColumn("_hour", F.expr(f"`{col}` div {src.HOUR_MS}"))


@query(
    "match_record",
    sql(
        "SELECT match_id, 0::BIGINT AS position, '{\"beginTimeStamp\":' || b || ',\"voiceEndTime\":' || (b - 357) || ',\"result\":' || (match_id % 11) || ',\"video_sync_offset_ms\":60}' AS record "
        "FROM (SELECT match_id, min(signal_ts) AS b FROM signals GROUP BY match_id) UNION ALL "
        "SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY signal_ts, idx), '{\"timeStamp\":' || signal_ts || ',\"fight\":' || fight || '}' FROM signals WHERE source = 'hit'",
        "signals",
    ),
)
def match_record(spark, sf):
    """Records written at the start of each match and again at its end, which replaces them, and read back."""
    signals = hourly(src.signals(spark, sf), "signal_ts")
    path = shared_path(spark, "records")
    begun = signals.groupBy("match_id").agg(F.min("signal_ts").alias("begin"))
    tables.write_records(begun.select("match_id", F.lit(0).cast("long").alias("position"), F.to_json(F.struct("begin")).alias("record")), path)
    tables.write_records(mt.match_records(signals, "_hour", ["signal_ts", "idx"], 60), path)
    return tables.read_records(spark, path, "match_id long, position long, record string").select("match_id", "position", "record")


MSG = {
    "msg": "SELECT event_id, CASE event_id % 12 "
    "WHEN 0 THEN '{\"v\":1,\"type\":\"signal\",\"id\":' || event_id || ',\"ts_mono_ns\":5,\"match_id\":\"m1\",\"payload\":' || props || '}' "
    "WHEN 1 THEN '{\"protocol_v\":1,\"type\":\"' || event_type || '\",\"id\":' || event_id || ',\"mono_ns\":7}' "
    "WHEN 2 THEN '{\"v\":2,\"type\":\"signal\",\"id\":1}' WHEN 3 THEN '{\"v\":1,\"type\":5,\"id\":1}' WHEN 4 THEN '{\"v\":1,\"type\":\"a\",\"id\":\"x\"}' "
    "WHEN 5 THEN '{\"v\":1,\"type\":\"a\",\"id\":1,\"payload\":[1]}' WHEN 6 THEN '{broken' WHEN 7 THEN '  ' WHEN 8 THEN '[1,2]' "
    "WHEN 9 THEN '{\"v\":1,\"type\":\"a\",\"id\":1,\"pad\":\"' || repeat('x', 66000) || '\"}' WHEN 10 THEN '{\"v\":1,\"id\":1}' ELSE '{\"v\":1,\"type\":\"match_result\",\"id\":' || event_id || '}' END AS line FROM events"
}


def message_lines(spark, sf):
    i = F.col("event_id")
    t = i.cast("string")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    m = i % 12
    line = (
        F.when(m == 0, cat('{"v":1,"type":"signal","id":', t, ',"ts_mono_ns":5,"match_id":"m1","payload":', F.col("props"), "}"))
        .when(m == 1, cat('{"protocol_v":1,"type":"', F.col("event_type"), '","id":', t, ',"mono_ns":7}'))
        .when(m == 2, '{"v":2,"type":"signal","id":1}')
        .when(m == 3, '{"v":1,"type":5,"id":1}')
        .when(m == 4, '{"v":1,"type":"a","id":"x"}')
        .when(m == 5, '{"v":1,"type":"a","id":1,"payload":[1]}')
        .when(m == 6, "{broken")
        .when(m == 7, "  ")
        .when(m == 8, "[1,2]")
        .when(m == 9, cat('{"v":1,"type":"a","id":1,"pad":"', F.repeat(F.lit("x"), F.lit(66000)), '"}'))
        .when(m == 10, '{"v":1,"id":1}')
        .otherwise(cat('{"v":1,"type":"match_result","id":', t, "}"))
    )
    return src.table(spark, sf, "events").select("event_id", line.alias("line"))


MSG_OK = {
    **MSG,
    "mj": "SELECT event_id, line, CASE WHEN strlen(line) <= 65536 AND json_valid(line) THEN line END AS j FROM msg WHERE trim(line) <> ''",
    "ms": "SELECT event_id, j, CASE WHEN strlen(line) > 65536 THEN 'oversized' WHEN j IS NULL THEN 'bad_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' "
    "WHEN coalesce((j->>'$.v')::INT, (j->>'$.protocol_v')::INT, 0) <> 1 THEN 'bad_version' WHEN coalesce(json_type(j, '$.type'), '') <> 'VARCHAR' THEN 'bad_type' "
    "WHEN coalesce(json_type(j, '$.id'), '') NOT IN ('UBIGINT', 'BIGINT') THEN 'bad_id' WHEN coalesce(json_type(j, '$.payload'), 'OBJECT') <> 'OBJECT' THEN 'bad_payload' ELSE 'ok' END AS status FROM mj",
}


@query(
    "message_ingest",
    sql(
        "SELECT event_id, status, CASE WHEN status = 'ok' THEN j->>'$.type' END AS type, CASE WHEN status = 'ok' THEN (j->>'$.id')::BIGINT END AS id, "
        "CASE WHEN status = 'ok' THEN coalesce((j->>'$.ts_mono_ns')::BIGINT, (j->>'$.mono_ns')::BIGINT) END AS mono_ns, CASE WHEN status = 'ok' THEN j->>'$.match_id' END AS match_id FROM ms",
        **MSG_OK,
    ),
)
def message_ingest(spark, sf):
    return mt.messages(message_lines(spark, sf)).select("event_id", "status", "type", "id", "mono_ns", "match_id")


@query(
    "type_filter",
    sql("SELECT event_id, j->>'$.type' AS type FROM ms WHERE status = 'ok' AND j->>'$.type' IN ('hello_ack', 'camera_ready', 'camera_error', 'match_result')", **MSG_OK),
)
def type_filter(spark, sf):
    rows = mt.messages(message_lines(spark, sf))
    return rows.where(F.col("type").isin(*mt.EVENT_TYPES)).select("event_id", "type")


@query("bad_line_tolerance", sql("SELECT event_id, CASE WHEN status = 'bad_json' THEN 'error' ELSE 'ok' END AS outcome, strlen(coalesce(j, '')) AS length FROM ms WHERE status <> 'oversized'", **MSG_OK))
def bad_line_tolerance(spark, sf):
    """Job lines that are not JSON give an error row; the others go on."""
    rows = mt.messages(message_lines(spark, sf)).where("status <> 'oversized'")
    bad = F.col("status") == "bad_json"
    return rows.select(
        "event_id",
        F.when(bad, "error").otherwise("ok").alias("outcome"),
        F.when(bad, 0).otherwise(F.octet_length("line")).cast("long").alias("length"),
    )


@query("serial_frames")
def serial_frames(spark, sf):
    """Frames built from events; every seventh has a broken checksum."""
    i = F.col("event_id")
    hex2 = lambda c: F.lpad(F.hex(c), 2, "0")
    head = F.concat(
        F.lit("02"), F.hex(F.lpad((i % 1000000).cast("string"), 6, "0")), F.lit("01"), hex2(i % 251), F.lit("000000"),
        hex2(F.lit(0x50) + i % 3), hex2(i % 4), hex2(i % 3), F.lit("0002"),
    )
    rows = src.table(spark, sf, "events").select("event_id", head.alias("head"))
    rows = rows.withColumn("covered", F.concat(F.lit(mt.DELIMITER), "head"))
    crc = F.lpad(F.hex(mt.crc16("covered").bitwiseXOR(F.when(i % 7 == 0, 1).otherwise(0))), 4, "0")
    frames = rows.select("event_id", F.unhex(F.concat("head", crc)).alias("frame"))
    return mt.serial_frames(frames).select("event_id", "ok", big("seq").alias("seq"), "cmd", "data")


FRAME_TEXTS = ("AT3YZ", "AT8YZ", "AT9YZ", "AT:YZ", "AT0YZ", "XT3YZ", "AT3YX", "AT3Y")
_listed = "[" + ", ".join(f"'{t}'" for t in FRAME_TEXTS) + "]"


def _pick(texts, n):
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (n % len(texts) + 1).cast("int"))


@query("hit_digits", sql(f"SELECT event_id, t AS frame, nullif(regexp_extract(t, '^AT([1-9])YZ$', 1), '')::BIGINT AS digit FROM (SELECT event_id, ({_listed})[(event_id % 8 + 1)::INT] AS t FROM events)"))
def hit_digits(spark, sf):
    t = _pick(FRAME_TEXTS, F.col("event_id"))
    return src.table(spark, sf, "events").select("event_id", t.alias("frame"), big(mt.hit_digit(t)).alias("digit"))


LIGHT_HEX = ("0003", "0300", "0000", "0102", "0303", "", "00")
_hexes = "[" + ", ".join(f"'{t}'" for t in LIGHT_HEX) + "]"


@query("final_lights", sql(f"SELECT event_id, substr(h, 1, 2) = '00' AS a_lit, substr(h, 3, 2) = '00' AS b_lit FROM (SELECT event_id, ({_hexes})[(event_id % 7 + 1)::INT] AS h FROM events)"))
def final_lights(spark, sf):
    rows = src.table(spark, sf, "events").select("event_id", F.hex(F.unhex(_pick(LIGHT_HEX, F.col("event_id")))).alias("h"))
    a, b = mt.lights(F.col("h"))
    return rows.select("event_id", a.alias("a_lit"), b.alias("b_lit"))


POS = {
    "pos": "SELECT user_id AS match_id, idx, signal_ts, row_number() OVER (PARTITION BY user_id ORDER BY signal_ts, idx) - 1 AS position FROM signals WHERE source = 'hit'",
    "cor": "SELECT user_id AS match_id, event_id AS seq, (value::BIGINT % 40) - 2 AS position, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) // 1000 + 33 END AS new_ts FROM events WHERE event_type = 'view'",
}


def positioned(spark, sf):
    hits = hourly(src.signals(spark, sf).where("source = 'hit'"), "signal_ts")
    rows = number(hits, ["user_id"], "_hour", ["signal_ts", "idx"], "position")
    return rows.select(F.col("user_id").alias("match_id"), "idx", "signal_ts", big("position").alias("position"))


@query(
    "correction_apply",
    sql(
        "SELECT p.match_id, idx, position::BIGINT AS position, coalesce(n, signal_ts) AS signal_ts, n IS NOT NULL AS changed FROM pos p LEFT JOIN "
        "(SELECT match_id, position, arg_max(new_ts, seq) AS n FROM cor WHERE new_ts IS NOT NULL GROUP BY match_id, position) USING (match_id, position)",
        "signals", **{**POS, "cor": POS["cor"].replace("value::BIGINT", "floor(value)::BIGINT")},
    ),
)
def correction_apply(spark, sf):
    e = events(spark, sf).where("event_type = 'view'")
    corrections = e.select(
        F.col("user_id").alias("match_id"),
        F.col("event_id").alias("seq"),
        (F.floor("value") % 40 - 2).alias("position"),
        F.when(F.col("event_id") % 5 != 0, F.col("ms") + 33).alias("new_ts"),
    )
    return mt.apply_corrections(positioned(spark, sf), corrections).select("match_id", "idx", "position", "signal_ts", "changed")


LIMIT_MS = 4 * src.HOUR_MS
TIMEOUT = {
    "rt": "SELECT e.event_id, e.user_id, e.ms, r.event_id AS result_id, r.ms - e.ms AS wait FROM (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'view') e "
    "ASOF LEFT JOIN (SELECT user_id, epoch_us(ts) // 1000 AS ms, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) r ON e.user_id = r.user_id AND e.ms <= r.ms"
}


def timeouts(spark, sf):
    e = events(spark, sf)
    ends = e.where("event_type = 'view'").select("user_id", F.col("ms").alias("ts"), "event_id")
    results = e.where("event_type = 'purchase'").select("user_id", F.col("ms").alias("ts"), F.col("event_id").alias("result_id"))
    return mt.result_timeouts(ends, results, ["user_id"], LIMIT_MS)


@query(
    "result_timeout",
    sql(f"SELECT event_id, wait AS wait_ms, CASE WHEN wait <= {LIMIT_MS} THEN 'in_time' WHEN wait IS NOT NULL THEN 'late' ELSE 'timeout' END AS status, CASE WHEN wait <= {LIMIT_MS} THEN 8 ELSE 0 END::BIGINT AS first_code FROM rt", **TIMEOUT),
)
def result_timeout(spark, sf):
    rows = timeouts(spark, sf)
    code = F.when(F.col("status") == "in_time", 8).otherwise(0)
    return rows.select("event_id", "wait_ms", "status", big(code).alias("first_code"))


@query("late_backfill", sql(f"SELECT event_id, result_id, CASE WHEN wait IS NULL THEN 0 ELSE 8 END::BIGINT AS final_code, coalesce(wait > {LIMIT_MS}, false) AS backfilled FROM rt", **TIMEOUT))
def late_backfill(spark, sf):
    """A late result replaces the record of a timed-out round, whatever its age."""
    rows = timeouts(spark, sf)
    return rows.select(
        "event_id",
        F.col("after.result_id").alias("result_id"),
        big(F.when(F.col("status") == "timeout", 0).otherwise(8)).alias("final_code"),
        (F.col("status") == "late").alias("backfilled"),
    )


HIT_SIDE = "CASE fight WHEN 8 THEN 'left' WHEN 9 THEN 'right' END"


@query(
    "lockout_pair",
    sql(
        "SELECT match_id, s AS first_side, t AS first_ts, second_ts, CASE WHEN second_ts IS NULL THEN 'single' ELSE 'double' END AS outcome FROM (SELECT h.match_id, any_value(f.side) AS s, any_value(f.ts) AS t, "
        "min(h.ts) FILTER (h.side <> f.side AND h.ts >= f.ts AND h.ts - f.ts <= 21600000) AS second_ts FROM hs h JOIN (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ts, idx) = 1) f ON h.match_id = f.match_id GROUP BY h.match_id)",
        "signals", hs=f"SELECT match_id, idx, signal_ts AS ts, {HIT_SIDE} AS side FROM signals WHERE fight IN (8, 9)",
    ),
)
def lockout_pair(spark, sf):
    s = src.signals(spark, sf).where(F.col("fight").isin(8, 9))
    hits = s.select("match_id", "idx", F.col("signal_ts").alias("ts"), codes.side_of_fight(F.col("fight")).alias("side"))
    return mt.lockout_pairs(hits, 6 * src.HOUR_MS)


@query(
    "message_routing",
    sql("SELECT idx, match_id FROM signals WHERE match_id IN (SELECT match_id FROM signals GROUP BY match_id HAVING count(*) FILTER (fight = 5) = 0 AND count(*) FILTER (source = 'light') > 0)", "signals"),
)
def message_routing(spark, sf):
    """Messages of active matches; a match with an error is cancelled."""
    s = src.signals(spark, sf)
    state = s.groupBy("match_id").agg(F.count_if(F.col("fight") == 5).alias("cancels"), F.count_if(F.col("source") == "light").alias("starts"))
    active = state.where("cancels = 0 AND starts > 0")
    return s.select("idx", "match_id").join(active, "match_id", "left_semi")


WIN = ("left", "right", "B", "none")
FR = {
    "fr": "SELECT event_id, value > 40 AS a, event_id % 3 = 0 AS b, event_id % 4 AS weapon, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'B' END AS ab FROM events",
}


@query(
    "final_result",
    sql(
        "SELECT event_id, CASE WHEN a AND NOT b THEN 'A' WHEN b AND NOT a THEN 'B' WHEN a AND b AND weapon <> 2 AND ab IS NOT NULL THEN ab ELSE 'tie' END AS winner, "
        "CASE WHEN NOT a AND NOT b THEN 0 WHEN a AND NOT b THEN 8 WHEN b AND NOT a THEN 9 WHEN weapon = 2 OR ab IS NULL THEN 10 WHEN ab = 'A' THEN 8 ELSE 9 END::BIGINT AS result_code, "
        "CASE WHEN NOT a AND NOT b THEN 'final_lights_no_touch' WHEN a <> b THEN 'final_lights_single_touch' WHEN weapon = 2 THEN 'final_lights_double_touch_epee' WHEN ab IS NOT NULL THEN 'local_streaming_analyzer' ELSE 'final_lights_double_touch' END AS decision_source FROM fr",
        **FR,
    ),
)
def final_result(spark, sf):
    i = F.col("event_id")
    out = codes.final_result(F.col("value") > 40, i % 3 == 0, i % 4, codes.winner_ab(_pick(WIN, i)))
    return src.table(spark, sf, "events").select(
        "event_id", out["winner"].alias("winner"), big(out["result_code"]).alias("result_code"), out["decision_source"].alias("decision_source")
    )


@query(
    "phrase_review",
    sql(
        "SELECT event_id, CASE WHEN r AND l THEN 'double' WHEN r <> l THEN 'single' ELSE 'none' END AS hits, CASE WHEN NOT r AND NOT l THEN 'ready' WHEN remote THEN 'submit' ELSE 'await_manual' END AS next_step, "
        "(r OR l) AND remote AS remote_review, (r OR l) AS awaiting_winner FROM (SELECT event_id, event_id % 2 = 0 AS r, event_id % 3 = 0 AS l, event_id % 5 < 3 AS remote FROM events)"
    ),
)
def phrase_review(spark, sf):
    i = F.col("event_id")
    r, l, remote = i % 2 == 0, i % 3 == 0, i % 5 < 3
    return src.table(spark, sf, "events").select(
        "event_id",
        F.when(r & l, "double").when(r != l, "single").otherwise("none").alias("hits"),
        F.when(~r & ~l, "ready").when(remote, "submit").otherwise("await_manual").alias("next_step"),
        ((r | l) & remote).alias("remote_review"),
        (r | l).alias("awaiting_winner"),
    )


@query("needs_row", sql("SELECT event_id FROM fr WHERE a AND b AND weapon <> 2", **FR))
def needs_row(spark, sf):
    """Only a double light of a right-of-way weapon needs the poses."""
    i = F.col("event_id")
    return src.table(spark, sf, "events").where((F.col("value") > 40) & (i % 3 == 0) & (i % 4 != 2)).select("event_id")


@query(
    "apply_result",
    sql(
        "SELECT event_id, coalesce(g, f) AS winner, CASE WHEN g IS NOT NULL THEN 'Pi judge' WHEN f IS NOT NULL THEN 'scoreboard' ELSE 'none' END AS source, CASE WHEN g IS NULL AND f IS NOT NULL THEN 'Only one light. ' || CASE f WHEN 'left' THEN 'Left' ELSE 'Right' END || ' fencer wins.' END AS broadcast "
        "FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS g, CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN 'right' WHEN event_id % 5 = 0 AND event_id % 3 <> 0 THEN 'left' END AS f FROM events)"
    ),
)
def apply_result(spark, sf):
    i = F.col("event_id")
    given = codes.normalise_winner(_pick(("Left", " RIGHT", "tie", ""), i))
    lone = codes.lone_hit(i % 3 == 0, i % 5 == 0)
    return src.table(spark, sf, "events").select(
        "event_id",
        F.coalesce(given, lone).alias("winner"),
        F.when(given.isNotNull(), "Pi judge").when(lone.isNotNull(), "scoreboard").otherwise("none").alias("source"),
        F.when(given.isNull() & lone.isNotNull(), codes.single_hit_message(lone)).alias("broadcast"),
    )


SEQ = {"sq": "SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'click' THEN floor(value / 60)::BIGINT END AS seq FROM events"}


@query(
    "seq_dedup",
    sql(
        "SELECT event_id, seq FROM (SELECT *, lag(seq) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM sq WHERE seq IS NOT NULL) WHERE n = 1 OR p <> seq UNION ALL SELECT event_id, seq FROM sq WHERE seq IS NULL",
        **SEQ,
    ),
)
def seq_dedup(spark, sf):
    rows = hourly(events(spark, sf), "ms").select(
        "user_id", "event_id", "ms", "_hour", F.when(F.col("event_type") != "click", F.floor(F.col("value") / 60)).alias("seq")
    )
    return mt.drop_repeats(rows, "user_id", "_hour", ["ms", "event_id"], "seq").select("event_id", "seq")


@query(
    "ingest_counters",
    sql(
        "SELECT user_id, count(*) AS frames, count(*) FILTER (event_id % 7 = 0) AS bad_frames, count(*) FILTER (p = seq) AS duplicates, sum(strlen(props))::BIGINT AS bytes FROM "
        "(SELECT e.*, seq, lag(seq) OVER (PARTITION BY e.user_id ORDER BY ms, e.event_id) AS p FROM events e JOIN sq USING (event_id)) GROUP BY user_id",
        **{"sq": SEQ["sq"].replace("CASE WHEN event_type <> 'click' THEN floor(value / 60)::BIGINT END", "floor(value / 60)::BIGINT").replace("user_id, event_id", "event_id")},
    ),
)
def ingest_counters(spark, sf):
    rows = hourly(events(spark, sf), "ms").withColumn("seq", F.floor(F.col("value") / 60))
    rows = number(rows, ["user_id"], "_hour", ["ms", "event_id"], "n")
    rows = nearby(rows, ["user_id"], "n", 1, 0, lambda d, w: d.withColumn("dup", yes(F.col("seq") == F.lag("seq").over(w))))
    return rows.groupBy("user_id").agg(
        F.count("n").alias("frames"),
        F.count_if(F.col("event_id") % 7 == 0).alias("bad_frames"),
        F.count_if("dup").alias("duplicates"),
        F.sum(F.octet_length("props")).cast("long").alias("bytes"),
    )


@query(
    "frame_gaps",
    sql(
        "SELECT user_id, count(*) AS received, max(no)::BIGINT AS last_no, count(*) FILTER (no <> frame) AS out_of_step, (count(*) FILTER (no <> frame) > 0 OR count(*) <> max(no) + 1) AS degraded FROM (SELECT user_id, frame, frame + frame // 10 AS no FROM frames) GROUP BY user_id",
        "frames",
    ),
)
def frame_gaps(spark, sf):
    """Capture numbers skip one after every tenth frame."""
    rows = src.frames(spark, sf).withColumn("no", F.expr("frame + frame div 10"))
    off = F.count_if(F.col("no") != F.col("frame"))
    return rows.groupBy("user_id").agg(
        F.count("no").alias("received"),
        big(F.max("no")).alias("last_no"),
        off.alias("out_of_step"),
        ((off > 0) | (F.count("no") != F.max("no") + 1)).alias("degraded"),
    )


@query(
    "confirm_samples",
    sql("SELECT series_id, frame FROM (SELECT series_id, frame, x, lag(x) OVER (PARTITION BY series_id ORDER BY frame) AS p FROM series) WHERE x > 0.5 AND p > 0.5", "series"),
)
def confirm_samples(spark, sf):
    """Second and later samples of a run of candidates."""
    both = lambda d, w: d.withColumn("sure", yes((F.col("x") > 0.5) & (F.lag("x").over(w) > 0.5)))
    return nearby(src.series(spark, sf), ["series_id"], "frame", 1, 0, both).where("sure").select("series_id", "frame")


BASELINE = {"lb": 200, "ll": 205, "rb": 198, "rl": 202}
CHANNELS = {"lb": "200 + (x * 160)::INT", "ll": "205 + (y * 17)::INT", "rb": "198 + ((frame * 37) % 90)", "rl": "202 + ((frame * 53) % 120)"}


def _close(a, b, gap, dev):
    return f"(abs({a} - {b}) <= {gap} AND abs({a} - {BASELINE[a]}) >= {dev} AND abs({b} - {BASELINE[b]}) >= {dev})"


FLAG_SQL = {
    "left_slow": _close("lb", "rl", 45, 28), "right_slow": _close("rb", "ll", 45, 28), "left_fast": _close("lb", "rl", 20, 12), "right_fast": _close("rb", "ll", 20, 12),
    "blade_slow": _close("lb", "rb", 55, 25), "blade_fast": _close("lb", "rb", 28, 12), "left_self_slow": _close("lb", "ll", 45, 28), "right_self_slow": _close("rb", "rl", 45, 28),
}
SLOW = [k for k in FLAG_SQL if k.endswith("_slow")]


@query(
    "contact_candidates",
    sql(
        "SELECT series_id, frame, CASE WHEN (left_fast OR left_sure) AND (right_fast OR right_sure) AND NOT (blade_fast OR blade_sure) THEN 'simultaneous' WHEN left_fast OR left_sure THEN 'left_hit' WHEN right_fast OR right_sure THEN 'right_hit' "
        "WHEN left_self_sure THEN 'left_self' WHEN right_self_sure THEN 'right_self' WHEN blade_fast OR blade_sure THEN 'blade_to_blade' ELSE 'none' END AS event FROM "
        "(SELECT *, " + ", ".join(f"{k} AND coalesce(lag({k}) OVER (PARTITION BY series_id ORDER BY frame), false) AS {k.replace('_slow', '_sure')}" for k in SLOW) + " FROM fl)",
        "series",
        ch="SELECT series_id, frame, 200 + floor(coalesce(x, 0) * 160)::INT AS lb, 205 + floor(y * 17)::INT AS ll, 198 + ((frame * 37) % 90) AS rb, 202 + ((frame * 53) % 120) AS rl FROM series",
        fl="SELECT series_id, frame, " + ", ".join(f"{t} AS {k}" for k, t in FLAG_SQL.items()) + " FROM ch",
    ),
)
def contact_candidates(spark, sf):
    f = F.col("frame")
    samples = src.series(spark, sf).select(
        "series_id", "frame",
        (F.lit(200) + F.floor(F.coalesce("x", F.lit(0.0)) * 160)).alias("lb"),
        (F.lit(205) + F.floor(F.col("y") * 17)).alias("ll"),
        (F.lit(198) + f * 37 % 90).alias("rb"),
        (F.lit(202) + f * 53 % 120).alias("rl"),
    )
    return mt.contact_event(samples, ["series_id"], "frame", BASELINE).select("series_id", "frame", "event")


@query(
    "clock_offset",
    sql("SELECT user_id, arg_min(off, rtt * 1000000 + event_id % 1000000) AS offset_ns, min(rtt) AS rtt_ns FROM (SELECT user_id, event_id, floor(value * 100)::BIGINT AS rtt, (epoch_us(ts) // 1000) * 1000000 + floor(value * 100)::BIGINT // 2 - event_id * 1000000 AS off FROM events) GROUP BY user_id"),
)
def clock_offset(spark, sf):
    """Offset of the probe with the least round trip; the first one on a tie."""
    rtt = F.floor(F.col("value") * 100)
    rows = events(spark, sf).select("user_id", "event_id", rtt.alias("rtt"), "ms")
    rows = rows.withColumn("off", F.expr("ms * 1000000 + rtt div 2 - event_id * 1000000"))
    best = F.min(F.struct("rtt", "event_id", "off"))
    return rows.groupBy("user_id").agg(best["off"].alias("offset_ns"), best["rtt"].alias("rtt_ns"))


@query(
    "rolling_buffer",
    sql(
        "SELECT 'signals' AS buffer, match_id::BIGINT AS match_id, idx, rank FROM (SELECT match_id, idx, row_number() OVER (PARTITION BY match_id ORDER BY signal_ts DESC, idx DESC) AS rank FROM signals) WHERE rank <= 50 "
        "UNION ALL SELECT 'log', NULL, event_id, rank FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 200",
        "signals",
    ),
)
def rolling_buffer(spark, sf):
    """Last 50 signals since the start of each match, and the last 200 log lines of all."""
    rows = mt.last_n(src.signals(spark, sf), ["match_id"], [F.desc("signal_ts"), F.desc("idx")], 50)
    rows = rows.select(F.lit("signals").alias("buffer"), big("match_id").alias("match_id"), "idx", big("rank").alias("rank"))
    latest = events(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    order = Window.partitionBy("buffer").orderBy(F.desc("ts"), F.desc("event_id"))
    log = latest.withColumn("buffer", F.lit("log")).withColumn("rank", F.row_number().over(order))
    return rows.unionByName(log.select("buffer", F.lit(None).cast("long").alias("match_id"), F.col("event_id").alias("idx"), big("rank").alias("rank")))


@query(
    "missing_hits",
    sql(
        "SELECT user_id, side, tt AS ts, added FROM (SELECT user_id, side, signal_ts AS tt, false AS added FROM sh UNION ALL SELECT m.user_id, s.side, m.tt, true FROM (SELECT user_id, max(signal_ts) AS tt FROM signals GROUP BY user_id) m, (VALUES ('left'), ('right')) s(side) "
        "WHERE (s.side = 'left' AND user_id % 2 = 0 OR s.side = 'right' AND user_id % 3 = 0) AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.user_id = m.user_id AND sh.side = s.side))",
        "signals", sh=f"SELECT user_id, signal_ts, {HIT_SIDE} AS side FROM signals WHERE fight IN (8, 9) AND user_id % 5 <> 0",
    ),
)
def missing_hits(spark, sf):
    """Hits of a match, with one at terminal time for each lit side that has none."""
    s = src.signals(spark, sf)
    u = F.col("user_id")
    hits = s.where(F.col("fight").isin(8, 9) & (u % 5 != 0)).select(
        "user_id", codes.side_of_fight(F.col("fight")).alias("side"), F.col("signal_ts").alias("ts")
    )
    ends = s.groupBy("user_id").agg(F.max("signal_ts").alias("ts"))
    lit_sides = F.array_compact(F.array(F.when(u % 2 == 0, "left"), F.when(u % 3 == 0, "right")))
    lit = ends.select("user_id", F.explode(lit_sides).alias("side"), "ts")
    added = lit.join(hits.select("user_id", "side").distinct(), ["user_id", "side"], "left_anti")
    return hits.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)))


@query(
    "active_gate",
    sql("SELECT user_id, (frame - mark)::BIGINT AS frame, ts FROM (SELECT *, (user_id % 4)::INT AS mark FROM frames) WHERE frame >= mark", "frames"),
)
def active_gate(spark, sf):
    """Frames before the active mark are dropped, the rest renumbered."""
    rows = src.frames(spark, sf).withColumn("mark", (F.col("user_id") % 4).cast("int"))
    return rows.where("frame >= mark").select("user_id", big(F.col("frame") - F.col("mark")).alias("frame"), "ts")


@query(
    "heartbeat_gap",
    sql(
        "SELECT user_id, event_id, gap_ms, gap_ms >= 6 * 3600000 AS lost, gap_ms >= 2 * 3600000 AS ping FROM (SELECT user_id, event_id, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) - ms AS gap_ms FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)) WHERE gap_ms IS NOT NULL"
    ),
)
def heartbeat_gap(spark, sf):
    """Silence after each message; the adapter events are hours apart, so the limits are in hours."""
    rows = number(hourly(events(spark, sf), "ms"), ["user_id"], "_hour", ["ms", "event_id"], "n")
    rows = nearby(rows, ["user_id"], "n", 0, 1, lambda d, w: d.withColumn("gap_ms", F.lead("ms").over(w) - F.col("ms")))
    gap = F.col("gap_ms")
    return rows.where(gap.isNotNull()).select(
        "user_id", "event_id", "gap_ms", (gap >= 6 * src.HOUR_MS).alias("lost"), (gap >= 2 * src.HOUR_MS).alias("ping")
    )
