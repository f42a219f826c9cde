"""Stream queries, run over the stored tables until they are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.operators import devices, tracking as tr
from quarte.plans.matches import LIMIT_MS, TIMEOUT, events, hourly
from quarte.plans.projections import ARENA
from quarte.plans.registry import ORACLES, query
from quarte.plans.views import sql
from quarte.sources import adapters as src
from quarte.streaming import processors as ps, sessions as ss


def kinds():
    k = F.col("event_type")
    return (
        F.when(k == "signup", "start").when(k == "view", "ready").when(k == "purchase", "hit").when(k == "click", "end").otherwise("cancel")
    )


def stream_events(spark, sf, files_per_trigger: int = ss.TOGETHER):
    """The events in the order of their time, with an end; the row that marks it has no event_id."""
    rows = ss.replay(src.table(spark, sf, "events"), "ts", files_per_trigger)
    return rows.withColumn("ms", src.millis("ts"))


# The next accepted event is the first at least eight hours after the last one; events of equal time go by event_id.
BOUNCE = (
    "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events), r AS ("
    "SELECT user_id, min({'ms': ms, 'event_id': event_id}) AS x FROM e GROUP BY user_id UNION ALL "
    "SELECT e.user_id, min({'ms': e.ms, 'event_id': e.event_id}) AS x FROM r JOIN e ON e.user_id = r.user_id AND e.ms >= r.x.ms + 28800000 GROUP BY e.user_id) "
    "SELECT user_id, x.ms AS ms, x.event_id AS event_id FROM r"
)


@query("debounce", BOUNCE)
def debounce(spark, sf):
    """The adapter events are hours apart, so the limit is in hours too."""
    rows = hourly(events(spark, sf), "ms").select("user_id", "event_id", "ms", "_hour")
    return devices.debounce(rows, "user_id", "_hour", "ms", "event_id", 8 * src.HOUR_MS)


NUM = "row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id)"
LIFE = {
    "k": "SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'ready' WHEN 'purchase' THEN 'hit' WHEN 'click' THEN 'end' ELSE 'cancel' END AS kind FROM events",
    "n1": f"SELECT *, {NUM} AS n FROM k",
    "n2": "SELECT *, last_value(CASE WHEN kind = 'start' THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n) AS s FROM n1",
    "n3": "SELECT *, min(n) FILTER (kind = 'cancel') OVER (PARTITION BY user_id, s) AS c, min(n) FILTER (kind = 'ready') OVER (PARTITION BY user_id, s) AS r0 FROM n2 WHERE s IS NOT NULL",
    "n4": "SELECT *, CASE WHEN c IS NULL OR r0 < c THEN r0 END AS r FROM n3",
    "n5": "SELECT *, coalesce(n > r AND (c IS NULL OR n < c), false) AS p FROM n4",
    "n6": "SELECT *, min(n) FILTER (kind = 'end' AND p) OVER (PARTITION BY user_id, s) AS e FROM n5",
}


@query(
    "match_lifecycle",
    sql(
        "SELECT user_id, max(event_id) FILTER (n = s) AS start_idx, count(*) FILTER (kind = 'hit' AND p AND (e IS NULL OR n < e)) AS n_signals, max(c) IS NOT NULL AS cancelled, "
        "CASE WHEN max(e) IS NOT NULL THEN 'settling' WHEN max(r) IS NOT NULL THEN 'playing' ELSE 'preparing' END AS reached FROM n6 GROUP BY user_id, s",
        **LIFE,
    ),
)
def match_lifecycle(spark, sf):
    rows = hourly(events(spark, sf), "ms").select("user_id", F.col("event_id").alias("idx"), "ms", "_hour", kinds().alias("kind"))
    return devices.life_cycles(rows, "user_id", "_hour", ["ms", "idx"]).drop("start_n")


LIFE_EVENTS = (
    "SELECT user_id AS device, event_id AS idx, CASE kind WHEN 'ready' THEN 'playing' WHEN 'hit' THEN 'signal' WHEN 'end' THEN 'settling' WHEN 'cancel' THEN 'cancelled' ELSE 'preempted' END AS event, "
    "CASE WHEN kind = 'start' THEN prior ELSE started END AS start_idx FROM "
    "(SELECT *, max(event_id) FILTER (n = s) OVER (PARTITION BY user_id, s) AS started, "
    "lag(s) OVER (PARTITION BY user_id ORDER BY n) AS s0 FROM n6) x LEFT JOIN "
    "(SELECT user_id AS u, s AS ps, max(event_id) FILTER (n = s) AS prior, max(c) IS NOT NULL AS ended FROM n6 GROUP BY user_id, s) p ON p.u = x.user_id AND p.ps = x.s0 "
    "WHERE (kind = 'start' AND s0 IS NOT NULL AND NOT ended) OR (kind = 'ready' AND n = r) OR (kind = 'cancel' AND n = c) "
    "OR (kind = 'hit' AND p AND (e IS NULL OR n < e)) OR (kind = 'end' AND n = e)"
)


@query("match_lifecycle_stream", sql(LIFE_EVENTS, **LIFE))
def match_lifecycle_stream(spark, sf):
    rows = stream_events(spark, sf).select(
        F.col("user_id").alias("device"), F.col("ms").alias("ts"), F.col("event_id").alias("idx"), kinds().alias("kind")
    )
    return ss.run_to_end(ss.life_cycle(rows.where("idx IS NOT NULL")), "life")


@query("dedup_stream", ORACLES["seq_dedup"])
def dedup_stream(spark, sf):
    seq = F.when(F.col("event_type") != "click", F.floor(F.col("value") / 60))
    rows = stream_events(spark, sf).where("event_id IS NOT NULL").select("user_id", "event_id", "ms", seq.alias("seq"))
    out = ss.dedup(rows, "user_id", ["ms", "event_id"], "seq", "user_id bigint, event_id bigint, ms bigint, seq double")
    return ss.run_to_end(out, "dedup").select("event_id", F.col("seq").cast("long").alias("seq"))


# Sessions by lag and running sum; the end is the last message plus the allowed silence.
BEATS = {
    "b1": "SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
    "b2": "SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM b1",
}


@query(
    "heartbeat_stream",
    sql("SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS lost_us, count(*) AS messages FROM b2 GROUP BY user_id, session", **BEATS),
)
def heartbeat_stream(spark, sf):
    rows = stream_events(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("at"))
    out = ss.run_to_end(ss.silences(rows, "user_id", "at", "6 hours"), "heartbeat").where("user_id IS NOT NULL")
    return out.select("user_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("lost_at").alias("lost_us"), "messages")


NEAR_12H = (
    "SELECT s.user_id, s.event_id AS idx, arg_min(f.event_id, (abs(epoch_us(f.ts) - epoch_us(s.ts)), f.ts, f.event_id)) AS frame "
    "FROM events s LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') f ON s.user_id = f.user_id AND f.ts BETWEEN s.ts - INTERVAL 12 HOUR AND s.ts + INTERVAL 12 HOUR "
    "WHERE s.event_type <> 'view' GROUP BY s.user_id, s.event_id"
)


def timed_rows(spark, sf, kind):
    """Events as rows of a timed processor; the end of input has a key of its own."""
    rows = stream_events(spark, sf)
    return rows.select(
        F.coalesce("user_id", F.lit(-1).cast("long")).alias("user_id"), F.col("ts").cast("timestamp").alias("at"),
        F.col("ms").alias("ts"), kind.alias("kind"), F.col("event_id").alias("idx"),
    )


@query("signal_frame_stream", NEAR_12H)
def signal_frame_stream(spark, sf):
    kind = F.when(F.col("event_type") == "view", ps.Nearest.FRAME).otherwise(ps.Nearest.SIGNAL)
    rows = timed_rows(spark, sf, kind)
    return ss.run_to_end(ps.timed(rows, "user_id", "at", "12 hours", ps.Nearest(12 * src.HOUR_MS)), "near")


SETTLED = (
    f"SELECT user_id, event_id, 'in_time' AS said, result_id, wait AS wait_ms FROM rt WHERE wait <= {LIMIT_MS} UNION ALL "
    f"SELECT user_id, event_id, 'timeout', NULL, NULL FROM rt WHERE wait IS NULL OR wait > {LIMIT_MS} UNION ALL "
    f"SELECT user_id, event_id, 'backfill', result_id, wait FROM rt WHERE wait > {LIMIT_MS}"
)


@query("result_timeout_stream", sql(SETTLED, **TIMEOUT))
def result_timeout_stream(spark, sf):
    """Rounds settled in time, given up by their timer, and replaced by a late result."""
    event = F.col("event_type")
    kind = F.when(event == "view", ps.ResultTimer.END).when(event == "purchase", ps.ResultTimer.RESULT)
    rows = timed_rows(spark, sf, kind)
    rows = rows.where("kind IS NOT NULL OR idx IS NULL")
    return ss.run_to_end(ps.timed(rows, "user_id", "at", "6 hours", ps.ResultTimer(LIMIT_MS)), "timeout")


@query("active_gate_stream", ORACLES["active_gate"])
def active_gate_stream(spark, sf):
    """Frames and control rows as one stream; the mark of a user comes with the row of its last frame, so most frames wait."""
    frames = src.frames(spark, sf).select("user_id", F.col("frame").cast("long").alias("frame"), "ts")
    marks = frames.groupBy("user_id").agg(F.max("ts").alias("ts"))
    marks = marks.select("user_id", F.lit(None).cast("long").alias("frame"), "ts", (F.col("user_id") % 4).cast("long").alias("mark"))
    rows = frames.withColumn("mark", F.lit(None).cast("long")).unionByName(marks)
    rows = rows.withColumn("at", F.timestamp_millis("ts"))
    stream = ss.replay(rows, "at").where("user_id IS NOT NULL").select("user_id", "frame", "ts", "mark")
    return ss.run_to_end(ps.gated(stream, "user_id"), "gate")


@query("message_routing_stream", ORACLES["message_routing"])
def message_routing_stream(spark, sf):
    """Signals of matches that are started and not cancelled; a match is over after 400 days without a signal."""
    s = src.signals(spark, sf)
    kind = F.when(F.col("fight") == 5, ps.Routing.CANCEL).when(F.col("source") == "light", ps.Routing.START).otherwise(ps.Routing.MESSAGE)
    rows = s.select("match_id", F.timestamp_millis("signal_ts").alias("at"), F.col("signal_ts").alias("ts"), kind.alias("kind"), "idx")
    stream = ss.replay(rows, "at").withColumn("match_id", F.coalesce("match_id", F.lit(-1).cast("long")))
    return ss.run_to_end(ps.timed(stream, "match_id", "at", "6 hours", ps.Routing(400 * 24 * src.HOUR_MS)), "routing")


def stream_detections(spark, sf):
    """Detections need phrase-wide frame numbers, so the batch adapter writes
    them once and the stream reads that archive."""
    from quarte.session import stage

    stored = stage(tr.prepared(src.detections(spark, sf)))
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(stored.schema).parquet(folder)


@query("live_session")
def live_session(spark, sf):
    return ss.run_to_end(ss.live_tracks(stream_detections(spark, sf), tr.TrackRules(ARENA)), "live")


@query("replay")
def replay(spark, sf):
    """Stored frames through the live path, compared with the batch tracker."""
    live = live_session(spark, sf)
    batch = tr.track(src.detections(spark, sf), tr.TrackRules(ARENA)).withColumnRenamed("det_idx", "batch_idx").drop("observed")
    rows = live.join(batch, ["phrase_id", "frame", "track_id"], "full_outer")
    return rows.select("phrase_id", "frame", "track_id", F.col("det_idx").eqNullSafe(F.col("batch_idx")).alias("same"))
