"""Frames read out of a captured byte stream: queries and their SQL.

The adapter stream of a user is what its events send one after the other: good and broken main frames, hits, stray
delimiters, fill bytes, and pieces of hits that go on in the next event. Every event's bytes arrive cut in two."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.operators import framing, matches as mt
from quarte.operators.series import number
from quarte.plans.matches import events, hourly
from quarte.plans.registry import big, query
from quarte.plans.views import sql

# What an event sends, by event_id modulo nine, as hex text; {main} is a main frame.
SENT = ("main", "main", "main", "hit", "broken", "stray", "fill", "two hits", "cut hit")
CRC = (
    "list_reduce(list_prepend(0, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b * 256), range(8)), lambda x, k: CASE WHEN x & 32768 <> 0 THEN xor((x * 2) & 65535, 4129) ELSE (x * 2) & 65535 END))"
)
STREAM = {
    "s0": "SELECT user_id, event_id AS i, epoch_us(ts) // 1000 AS ms FROM events",
    "s1": "SELECT *, '8E02' || hex(lpad((i % 1000000)::VARCHAR, 6, '0')) || '01' || lpad(hex(i % 2), 2, '0') || '000000' || lpad(hex(80 + i % 3), 2, '0') || lpad(hex(i % 4), 2, '0') || lpad(hex(i % 3), 2, '0') || '0002' AS h FROM s0",
    "s2": f"SELECT *, h || lpad(hex({CRC}), 4, '0') || '8E' AS good FROM s1",
    "s3": "SELECT *, CASE i % 9 WHEN 3 THEN '4154' || (31 + i % 9) || '595A' WHEN 4 THEN left(good, 20) || '77' || substr(good, 23) WHEN 5 THEN '8E' WHEN 6 THEN repeat('41', 300) "
    "WHEN 7 THEN '41543859' || '5A4154' || '39595A' WHEN 8 THEN '414154' || (31 + i % 8) ELSE good END AS bytes FROM s2",
    "s4": "SELECT user_id, string_agg(bytes, '' ORDER BY ms, i) AS bytes FROM s3 GROUP BY user_id",
    # one character per byte, so that a pattern can read the stream from left to right
    "s5": "SELECT user_id, array_to_string(list_transform(range(0, length(bytes) // 2), lambda i: chr(('0x' || substr(bytes, 2 * i + 1, 2))::INT)), '') AS t FROM s4",
    "s6": r"SELECT user_id, regexp_extract_all(t, '(?s)\x{8E}[^\x{8E}]{0,255}\x{8E}|\x{8E}[^\x{8E}]{0,255}\z|AT[1-9]YZ|.') AS found FROM s5",
    "s7": "SELECT user_id, unnest(found) AS f, unnest(range(len(found))) AS n FROM s6",
    "s8": "SELECT user_id, f, n, (sum(length(f)) OVER (PARTITION BY user_id ORDER BY n))::BIGINT - length(f) AS place FROM s7",
    "s9": "SELECT user_id, place, CASE WHEN length(f) > 1 AND f[1] = chr(142) AND f[-1] = chr(142) THEN 'main' WHEN length(f) = 5 AND f[1] = 'A' THEN 'hit' WHEN f = chr(142) AND place + 256 < total THEN 'stray' ELSE 'waiting' END AS kind, f "
    "FROM s8 JOIN (SELECT user_id AS u, length(t) AS total FROM s5) ON u = user_id WHERE length(f) > 1 OR f = chr(142)",
    "f1": "SELECT user_id, place, kind, f, CASE WHEN kind = 'main' THEN array_to_string(list_transform(range(1, length(f) - 1), lambda i: lpad(hex(unicode(f[i + 1])), 2, '0')), '') END AS b FROM s9",
    "f2": "SELECT *, '8E' || left(b, length(b) - 4) AS h, length(b) // 2 AS bytes FROM f1",
    "f3": f"SELECT user_id, place, kind, f, b, bytes, bytes >= 17 AND left(b, 2) = '02' AND bytes = 17 + TRY_CAST('0x' || substr(b, length(b) - 7, 4) AS INT) AND {CRC} = TRY_CAST('0x' || right(b, 4) AS INT) AS good FROM f2",
    "f4": "SELECT *, CASE WHEN kind = 'main' THEN coalesce(good, false) END AS ok, CASE WHEN good THEN ('0x' || substr(b, 17, 2))::BIGINT END AS seq FROM f3",
    "f5": "SELECT *, coalesce(seq = last_value(seq IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS repeat FROM f4",
}


def pieces(spark, sf):
    """(user_id, n, data): two pieces of the stream per event, in order."""
    rows = number(hourly(events(spark, sf), "ms").select("user_id", "event_id", "ms", "_hour"), ["user_id"], "_hour", ["ms", "event_id"], "n")
    i = F.col("event_id")
    hex2 = lambda c: F.lpad(F.hex(c), 2, "0")
    head = F.concat(
        F.lit("8E02"), F.hex(F.lpad((i % 1000000).cast("string"), 6, "0")), F.lit("01"), hex2(i % 2), F.lit("000000"),
        hex2(F.lit(0x50) + i % 3), hex2(i % 4), hex2(i % 3), F.lit("0002"),
    )
    rows = rows.withColumn("head", head).withColumn("good", F.concat("head", F.lpad(F.hex(mt.crc16("head")), 4, "0"), F.lit("8E")))
    sent = {
        "hit": F.concat(F.lit("4154"), (31 + i % 9).cast("string"), F.lit("595A")),
        "broken": F.expr("left(good, 20) || '77' || substr(good, 23)"),
        "stray": F.lit("8E"),
        "fill": F.lit("41" * 300),
        "two hits": F.lit("415438595A415439595A"),
        "cut hit": F.concat(F.lit("414154"), (31 + i % 8).cast("string")),
        "main": F.col("good"),
    }
    text = F.coalesce(*(F.when(i % 9 == k, sent[what]) for k, what in enumerate(SENT)))
    rows = rows.select("user_id", "n", text.alias("text")).withColumn("cut", 2 * (F.length("text") / 4).cast("int"))
    halves = F.array(F.expr("left(text, cut)"), F.expr("substr(text, cut + 1)"))
    rows = rows.select("user_id", "n", F.posexplode(halves).alias("half", "piece"))
    return rows.select("user_id", (F.col("n") * 2 + F.col("half")).cast("long").alias("n"), F.unhex("piece").alias("data"))


def found(spark, sf):
    return framing.decoded(framing.frames(pieces(spark, sf), "user_id", "n", "data"))


@query(
    "serial_stream",
    sql(
        "SELECT user_id, place, kind, ok, repeat, seq, CASE WHEN good THEN substr(b, 25, 2) END AS cmd, CASE WHEN good THEN substr(b, 27, 2 * (bytes - 17)) END AS data, "
        "CASE WHEN kind = 'hit' THEN f[3]::BIGINT END AS digit FROM f5",
        **STREAM,
    ),
)
def serial_stream(spark, sf):
    """Frames of every user's stream, whatever the pieces it comes in."""
    rows = found(spark, sf)
    return rows.select(F.col("device").alias("user_id"), F.col("at").alias("place"), "kind", "ok", "repeat", big("seq").alias("seq"), "cmd", "data", big("digit").alias("digit"))


@query(
    "serial_counters",
    sql(
        "SELECT user_id, count(*) FILTER (kind = 'main' AND ok AND NOT repeat) AS mains, count(*) FILTER (repeat) AS repeats, count(*) FILTER (kind = 'main' AND NOT ok) AS errors, "
        "count(*) FILTER (kind = 'hit') AS hits, count(*) FILTER (kind = 'stray') AS strays FROM f5 GROUP BY user_id",
        **STREAM,
    ),
)
def serial_counters(spark, sf):
    return framing.counters(found(spark, sf)).withColumnRenamed("device", "user_id")
