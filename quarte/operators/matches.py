"""Match side: device frames, messages, records, corrections and timeouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarte.operators import asof
from quarte.operators.series import nearby, number, spread_join

# Frame layout and message limits.
DELIMITER, FRAME_START, HEADER, TRAILER = "8E", "02", 13, 4
MAX_MESSAGE_BYTES = 65536
EVENT_TYPES = ("hello_ack", "camera_ready", "camera_error", "match_result")


def crc_table() -> list[int]:
    """What a byte that leaves the register adds to it."""
    out = []
    for c in range(256):
        c <<= 8
        for _ in range(8):
            c = (c << 1 ^ (4129 if c & 32768 else 0)) & 65535
        out.append(c)
    return out


def crc16(data: str) -> Column:
    """CRC-16 with polynomial 0x1021 and start 0 of a hex text column, one look at
    a table of 256 numbers per byte, as a native fold."""
    table = f"array({', '.join(map(str, crc_table()))})"
    byte = f"conv(substr({data}, 2 * i - 1, 2), 16, 10)::int"
    step = f"shiftleft(crc & 255, 8) ^ {table}[shiftright(crc, 8) ^ {byte}]"
    return F.expr(f"aggregate(sequence(1, int(length({data}) / 2)), 0, (crc, i) -> {step})")


def serial_frames(frames: DataFrame, payload: str = "frame") -> DataFrame:
    """Decode binary main frames (the bytes between two delimiters).

    ``ok`` is false for short frames, wrong lengths and CRC mismatches."""
    rows = frames.withColumn("_hex", F.hex(payload)).withColumn("_n", (F.length("_hex") / 2).cast("int"))
    byte = lambda i, n=1: F.expr(f"substr(_hex, {2 * i + 1}, {2 * n})")
    number_of = lambda c: F.conv(c, 16, 10).cast("int")
    data_len = number_of(F.expr("substr(_hex, length(_hex) - 7, 4)"))
    covered = F.concat(F.lit(DELIMITER), F.expr("substr(_hex, 1, length(_hex) - 4)"))
    rows = rows.withColumns({"_len": data_len, "_covered": covered})
    good = (
        (F.col("_n") >= HEADER + TRAILER)
        & (byte(0) == FRAME_START)
        & (F.col("_n") == F.col("_len") + HEADER + TRAILER)
        & (crc16("_covered") == number_of(F.expr("right(_hex, 4)")))
    )
    return rows.withColumns(
        {
            "ok": F.coalesce(good, F.lit(False)),
            "seq": number_of(byte(8)),
            "cmd": byte(12),
            "data": F.expr(f"substr(_hex, {2 * HEADER + 1}, 2 * _len)"),
        }
    ).drop("_hex", "_n", "_len", "_covered")


def hit_digit(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^AT([1-9])YZ$", 1), F.lit("")).cast("int")


def lights(data_hex: Column) -> tuple[Column, Column]:
    """Whether side A and side B are lit: byte 00 is lit, a missing byte is not."""
    return tuple(F.coalesce(F.substring(data_hex, p, 2) == "00", F.lit(False)) for p in (1, 3))


def messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """Check message lines; ``status`` is ok or the reason of the rejection."""
    v = F.try_parse_json(line)
    rows = lines.where(F.trim(line) != "").withColumn("_v", F.when(F.octet_length(line) <= MAX_MESSAGE_BYTES, v))
    kind = lambda p: F.schema_of_variant(F.expr(f"try_variant_get(_v, '{p}', 'variant')"))
    get = lambda p, t: F.expr(f"try_variant_get(_v, '{p}', '{t}')")
    version = F.coalesce(get("$.v", "int"), get("$.protocol_v", "int"))
    whole = kind("$").startswith("OBJECT")
    status = (
        F.when(F.octet_length(line) > MAX_MESSAGE_BYTES, "oversized")
        .when(F.col("_v").isNull(), "bad_json")
        .when(~whole, "not_object")
        .when(F.coalesce(version, F.lit(0)) != 1, "bad_version")
        .when(F.coalesce(kind("$.type"), F.lit("")) != "STRING", "bad_type")
        .when(F.coalesce(kind("$.id"), F.lit("")) != "BIGINT", "bad_id")
        .when(~F.coalesce(kind("$.payload"), F.lit("OBJECT")).startswith("OBJECT"), "bad_payload")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    mono = F.coalesce(get("$.ts_mono_ns", "bigint"), get("$.mono_ns", "bigint"))
    return rows.withColumn("status", status).withColumns(
        {
            "type": F.when(ok, get("$.type", "string")),
            "id": F.when(ok, get("$.id", "bigint")),
            "mono_ns": F.when(ok, mono),
            "match_id": F.when(ok, get("$.match_id", "string")),
        }
    ).drop("_v")


def match_records(signals: DataFrame, chunk: str, order: Sequence[str], offset_ms: int) -> DataFrame:
    """JSON records of matches: a header (position 0) and one record per hit signal in arrival order from 1 on.

    The form is the same for every match size, and no match is brought together in one record."""
    hit = F.col("source") == "hit"
    begin = signals.groupBy("match_id").agg(F.min("signal_ts").alias("begin"))
    head = F.struct(
        F.col("begin").alias("beginTimeStamp"),
        (F.col("begin") - 357).alias("voiceEndTime"),
        (F.col("match_id") % 11).alias("result"),
        F.lit(offset_ms).alias("video_sync_offset_ms"),
    )
    heads = begin.select("match_id", F.lit(0).cast("long").alias("position"), F.to_json(head).alias("record"))
    rows = number(signals.where(hit), ["match_id"], chunk, order, "_n")
    item = F.struct(F.col("signal_ts").alias("timeStamp"), "fight")
    rows = rows.select("match_id", (F.col("_n") + 1).cast("long").alias("position"), F.to_json(item).alias("record"))
    return heads.unionByName(rows)


def apply_corrections(signals: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace stamps by position; of several corrections the last counts, those
    out of range or without a number are ignored."""
    last = corrections.where("new_ts IS NOT NULL").groupBy("match_id", "position").agg(F.max_by("new_ts", "seq").alias("new_ts"))
    joined = signals.join(last, ["match_id", "position"], "left")
    return joined.withColumn("changed", F.col("new_ts").isNotNull()).withColumn(
        "signal_ts", F.coalesce("new_ts", "signal_ts")
    ).drop("new_ts")


def result_timeouts(ends: DataFrame, results: DataFrame, keys: Sequence[str], limit_ms: int) -> DataFrame:
    """First result at or after each round end: in time, late (backfilled once) or missing."""
    rows = asof.neighbours(ends, results, keys, "ts", "result_id")
    wait = F.col("after.ts") - F.col("ts")
    status = F.when(wait <= limit_ms, "in_time").when(wait.isNotNull(), "late").otherwise("timeout")
    return rows.withColumns({"status": status, "wait_ms": wait})


def lockout_pairs(hits: DataFrame, window_ms: int) -> DataFrame:
    """First hit per phrase and the opposite hit inside the window, if any."""
    mark = F.struct("ts", "idx", "side")
    first = hits.groupBy("match_id").agg(F.min(mark).alias("first"))
    rows = spread_join(hits, first, ["match_id"], F.col("idx"))
    opposite = (
        (F.col("side") != F.col("first.side"))
        & (F.col("ts") >= F.col("first.ts"))
        & (F.col("ts") - F.col("first.ts") <= window_ms)
    )
    pairs = rows.groupBy("match_id").agg(F.max("first").alias("first"), F.min(F.when(opposite, F.col("ts"))).alias("second_ts"))
    return pairs.select(
        "match_id",
        F.col("first.side").alias("first_side"),
        F.col("first.ts").alias("first_ts"),
        "second_ts",
        F.when(F.col("second_ts").isNotNull(), "double").otherwise("single").alias("outcome"),
    )


def drop_repeats(frames: DataFrame, device: str, chunk: str, order: Sequence[str], seq: str) -> DataFrame:
    """Keep main frames whose sequence differs from the one just before; hit
    frames (NULL sequence) are all kept."""
    main = number(frames.where(F.col(seq).isNotNull()), [device], chunk, order, "_n")
    repeat = lambda d, w: d.withColumn("_repeat", F.col(seq).eqNullSafe(F.lag(seq).over(w)))
    kept = nearby(main, [device], "_n", 1, 0, repeat).where(~F.col("_repeat")).drop("_repeat", "_n")
    return kept.unionByName(frames.where(F.col(seq).isNull()))


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Last n rows per key; Spark limits each map task to n before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# Contact thresholds of the sensing box, normal and fast.
HIT_CLOSE, HIT_DEV, HIT_CLOSE_FAST, HIT_DEV_FAST = 45, 28, 20, 12
B2B_CLOSE, B2B_DEV, B2B_CLOSE_FAST, B2B_DEV_FAST = 55, 25, 28, 12
SELF_CLOSE, SELF_DEV = 45, 28


def contact_flags(base: dict[str, int]) -> dict[str, Column]:
    """Candidate contacts of one sample of the four channels lb, ll, rb, rl."""

    def close(a: str, b: str, gap: int, dev: int) -> Column:
        off = lambda c: F.abs(F.col(c) - base[c]) >= dev
        return (F.abs(F.col(a) - F.col(b)) <= gap) & off(a) & off(b)

    return {
        "left_slow": close("lb", "rl", HIT_CLOSE, HIT_DEV),
        "right_slow": close("rb", "ll", HIT_CLOSE, HIT_DEV),
        "left_fast": close("lb", "rl", HIT_CLOSE_FAST, HIT_DEV_FAST),
        "right_fast": close("rb", "ll", HIT_CLOSE_FAST, HIT_DEV_FAST),
        "blade_slow": close("lb", "rb", B2B_CLOSE, B2B_DEV),
        "blade_fast": close("lb", "rb", B2B_CLOSE_FAST, B2B_DEV_FAST),
        "left_self_slow": close("lb", "ll", SELF_CLOSE, SELF_DEV),
        "right_self_slow": close("rb", "rl", SELF_CLOSE, SELF_DEV),
    }


def contact_event(df: DataFrame, keys: Sequence[str], frame: str, base: dict[str, int]) -> DataFrame:
    """Classify samples. A slow candidate counts from its second sample in a row;
    priority is simultaneous, left, right, self contacts, blade contact."""
    flags = contact_flags(base)
    rows = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})

    def build(d, w):
        slow = [k for k in flags if k.endswith("_slow")]
        return d.withColumns(
            {k.replace("_slow", "_sure"): F.col(k) & F.coalesce(F.lag(k).over(w), F.lit(False)) for k in slow}
        )

    rows = nearby(rows, keys, frame, 1, 0, build)
    left, right = F.col("left_fast") | F.col("left_sure"), F.col("right_fast") | F.col("right_sure")
    blade = F.col("blade_fast") | F.col("blade_sure")
    event = (
        F.when(left & right & ~blade, "simultaneous")
        .when(left, "left_hit")
        .when(right, "right_hit")
        .when(F.col("left_self_sure"), "left_self")
        .when(F.col("right_self_sure"), "right_self")
        .when(blade, "blade_to_blade")
        .otherwise("none")
    )
    return rows.withColumn("event", event)
