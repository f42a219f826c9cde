"""Phrase logs as tables of lines: parsing, winners, contacts, rewriting.

All per-phrase facts are aggregates over lines (last or first matching line by
line number), so a hot phrase is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarte.functions import codes
from quarte.operators.series import spread_join

# Text patterns of the log dialects.
STAMP = r"(\d+\.\d+)s"
CONTACT = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)s\s*\|\s*Off-Target:\s*Blade-to-blade contact\.[^\[]*(?:\[([^\]]+)\])?"
BLADE = r"(?i)([0-9]+(?:\.[0-9]+)?)s\s*\|\s*.*blade-to-blade"
TIMED = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)s\s*\|\s*(.*)$"
SIDE_HIT = r"(?i)(\d+\.\d+)s\s*\|\s*HIT:\s*(Left|Right)\s+scores\s+on\s+(Left|Right)!"
SCORES = r"Scores -> Fencer 1:\s*([A-Za-z]+),\s*Fencer 2:\s*([A-Za-z]+)"
TRACKING = r"(?i)tracking\s+indices\s*->\s*fencer\s*1:\s*(-?\d+)\s*,\s*fencer\s*2:\s*(-?\d+)\s*$"
DECLARED = r"(?i)(Confirmed result winner|Manual selection winner):\s*(Right|Left)"
TRAINING_WINNER = r"(?i)(confirmed result|manual selection) winner:\s*(left|right)"
WINNER_LABELS = (
    "Confirmed result winner",
    "Remote referee winner overrides manual selection",
    "Remote referee winner",
    "Manual selection winner",
)


def found(pattern: str, group: int, line: str = "line") -> Column:
    """Matched text of a group, NULL without a match."""
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def stamp(line: str = "line") -> Column:
    return found(STAMP, 1, line).cast("double")


def last_of(cond: Column, value: Column) -> Column:
    """Value of the last line that meets a condition and has one."""
    return F.max(F.when(cond & value.isNotNull(), F.struct(F.col("line_no"), value.alias("v"))))["v"]


def first_of(cond: Column, value: Column) -> Column:
    return F.min(F.when(cond & value.isNotNull(), F.struct(F.col("line_no"), value.alias("v"))))["v"]


def has(text: str) -> Column:
    return F.col("line").contains(text)


def parse_base(log: DataFrame, fps: float = 15.0) -> DataFrame:
    """One row per phrase in the older dialect; ``status`` names the reason of a rejection."""
    t, always = F.col("at"), F.lit(True)
    rows = log.withColumn("at", stamp()).groupBy("phrase_id").agg(
        last_of(has("Phrase recording started"), t).alias("start_time"),
        last_of(has("Simultaneous valid hits"), t).alias("simultaneous"),
        last_of(has("Lockout period started"), t).alias("lockout"),
        first_of(has("HIT:"), t).alias("first_hit"),
        F.count(F.when(has("Off-Target: Blade-to-blade contact"), t)).alias("n_contacts"),
        last_of(has("Scores ->"), F.upper(found(r"(?i)Fencer 1:\s*(\w+)", 1))).alias("f1"),
        last_of(has("Scores ->"), F.upper(found(r"(?i)Fencer 2:\s*(\w+)", 1))).alias("f2"),
        last_of(always, F.when(F.col("line").rlike(DECLARED), F.lower(found(r"(?i)(Right|Left)", 1)))).alias("winner"),
    )
    hit = F.coalesce("simultaneous", "first_hit")
    double = F.coalesce((F.col("f1") == "HIT") & (F.col("f2") == "HIT"), F.lit(False))
    status = (
        F.when(F.col("start_time").isNull(), "no_start").when(~double, "not_double").when(hit.isNull(), "no_hit").otherwise("ok")
    )
    return rows.select(
        "phrase_id",
        status.alias("status"),
        "start_time",
        (F.col("start_time") * fps).cast("long").alias("start_frame"),
        hit.alias("hit_time"),
        (hit * fps).cast("long").alias("hit_frame"),
        "lockout",
        "n_contacts",
        F.coalesce("winner", F.lit("unknown")).alias("winner"),
    )


def parse_fps30(log: DataFrame, fps: float = 30.0) -> DataFrame:
    """One row per phrase in the newer dialect, which never rejects."""
    t = F.col("at")
    rows = log.withColumn("at", stamp()).groupBy("phrase_id").agg(
        last_of(has("Phrase recording started"), t).alias("start_time"),
        last_of(has("Simultaneous valid hits"), t).alias("simultaneous"),
        last_of(has("Lockout period started"), t).alias("lockout"),
        F.max(F.when(has("| HIT:"), t)).alias("max_hit"),
        F.count(F.when(has("Off-Target: Blade-to-blade contact"), t)).alias("n_contacts"),
        last_of(F.lit(True), F.upper(found(SCORES, 1))).alias("f1"),
        last_of(F.lit(True), F.upper(found(SCORES, 2))).alias("f2"),
        last_of(F.lit(True), found(r"Winner: (\w+)", 1)).alias("winner"),
    )
    double = F.coalesce((F.col("f1") == "HIT") & (F.col("f2") == "HIT"), F.lit(False))
    hit = F.when(double, F.coalesce("simultaneous", "max_hit", "lockout", "start_time"))
    return rows.select(
        "phrase_id",
        F.coalesce("start_time", F.lit(0.0)).alias("start_time"),
        F.coalesce((F.col("start_time") * fps).cast("long"), F.lit(0)).alias("start_frame"),
        hit.alias("hit_time"),
        (hit * fps).cast("long").alias("hit_frame"),
        "lockout",
        "n_contacts",
        "winner",
    )


def side_hits(log: DataFrame, fps: float = 30.0) -> DataFrame:
    rows = log.select(
        "phrase_id",
        "line_no",
        found(SIDE_HIT, 1).cast("double").alias("time_s"),
        F.lower(found(SIDE_HIT, 2)).alias("scorer"),
        F.lower(found(SIDE_HIT, 3)).alias("target"),
    )
    return rows.where(F.col("scorer") != F.col("target")).withColumn("frame", (F.col("time_s") * fps).cast("long"))


def contact_lines(log: DataFrame) -> DataFrame:
    """Last contact time and last labelled tag, which may come from an earlier line."""
    t = found(CONTACT, 1).cast("double")
    tag = F.when(t.isNotNull(), codes.norm_tag(found(CONTACT, 2)))
    rows = log.groupBy("phrase_id").agg(last_of(F.lit(True), t).alias("contact_time"), last_of(F.lit(True), tag).alias("tag"))
    return rows.where(F.col("contact_time").isNotNull())


def contact_before_hit(log: DataFrame) -> DataFrame:
    """Latest contact at or before the first hit line, else the latest of all."""
    rows = log.select(
        "phrase_id", "line_no", found(TIMED, 1).cast("double").alias("at"), F.trim(found(TIMED, 2)).alias("text")
    ).where(F.col("at").isNotNull())
    low = F.lower("text")
    firsts = rows.groupBy("phrase_id").agg(first_of(low.startswith("hit:"), F.col("at")).alias("first_hit"))
    contacts = rows.where(low.contains("blade-to-blade contact")).withColumn(
        "tag", codes.norm_tag(found(r"\[([^\]]+)\]\s*$", 1, "text"))
    )
    joined = spread_join(contacts, firsts, ["phrase_id"], F.col("line_no"))
    mark = F.struct("at", (-F.col("line_no")).alias("neg"), "tag")
    prior = F.col("first_hit").isNull() | (F.col("at") <= F.col("first_hit") + 1e-9)
    best = joined.groupBy("phrase_id").agg(
        F.max(F.when(prior, mark)).alias("prior"), F.max(mark).alias("any"), F.max("first_hit").alias("first_hit"),
        F.count("at").alias("n_contacts"),
    )
    chosen = F.coalesce("prior", "any")
    return best.select(
        "phrase_id", chosen["at"].alias("contact_time"), chosen["tag"].alias("tag"), "first_hit", "n_contacts"
    )


def actual_winner(log: DataFrame) -> DataFrame:
    """Winner label by priority over the known phrasings."""
    picks = [
        first_of(F.lit(True), F.lower(found(rf"(?i){label}:\s*(Right|Left|Abstain)", 1))).alias(f"w{i}")
        for i, label in enumerate(WINNER_LABELS)
    ]
    rows = log.groupBy("phrase_id").agg(*picks)
    return rows.select("phrase_id", F.coalesce(*[f"w{i}" for i in range(len(picks))]).alias("winner"))


def end_time(log: DataFrame) -> DataFrame:
    rows = log.groupBy("phrase_id").agg(last_of(has("Phrase recording ended"), stamp()).alias("end_time"))
    return rows.where(F.col("end_time") > 0)


def tracking_indices(log: DataFrame) -> DataFrame:
    first = found(TRACKING, 1).cast("long")
    pair = F.when(first.isNotNull(), F.struct(first.alias("a"), found(TRACKING, 2).cast("long").alias("b")))
    rows = log.groupBy("phrase_id").agg(last_of(F.lit(True), pair).alias("pair")).where(F.col("pair").isNotNull())
    return rows.select("phrase_id", F.col("pair.a").alias("fencer_1"), F.col("pair.b").alias("fencer_2"))


def training_log(log: DataFrame) -> DataFrame:
    """Last contact time and last winner; a phrase without either is dropped."""
    t = F.when(F.lower("line").contains("blade-to-blade"), found(BLADE, 1).cast("double"))
    rows = log.groupBy("phrase_id").agg(
        last_of(F.lit(True), t).alias("contact_time"), last_of(F.lit(True), F.lower(found(TRAINING_WINNER, 2))).alias("winner")
    )
    return rows.where(F.col("contact_time").isNotNull() & F.col("winner").isNotNull())


def device_lines(lines: DataFrame) -> DataFrame:
    """Split ``PREFIX: content`` device lines; banners and lines without a prefix are dropped."""
    line = F.trim("line")
    banner = line.startswith("===") | line.startswith("Baselines:") | line.startswith("[EVENT]") | (line == "")
    rows = lines.where(~banner & line.contains(":")).withColumns(
        {
            "prefix": F.trim(F.substring_index(line, ":", 1)),
            "content": F.trim(F.expr("substring(trim(line), locate(':', trim(line)) + 1)")),
        }
    )
    is_log = F.col("prefix") == "LOG"
    stamped = is_log & F.col("content").contains("|")
    raw = F.when(stamped, F.trim(F.substring_index("content", "|", 1)))
    micros = F.when(raw.rlike(r"^\d+$"), raw.cast("long")).otherwise(
        F.bround(raw.try_cast("double") * 1_000_000).cast("long")
    )
    text = F.when(stamped, F.trim(F.expr("substring(content, locate('|', content) + 1)"))).when(is_log, F.col("content"))
    return rows.withColumns({"stamp_us": micros, "text": text})


def timed_lines(log: DataFrame) -> DataFrame:
    """Re-emit timed lines of a log that has a ``frame`` per line; others stay."""
    message = F.regexp_extract("line", r"^\s*(\d+\.\d{3})s\s*\|\s*(?:frame\s+\d+\s*\|\s*)?(.*)$", 2)
    timed = F.col("line").rlike(r"^\s*\d+\.\d{3}s\s*\|")
    fresh = F.when(F.col("frame").isNull(), F.format_string("%6.3fs | %s", F.col("t"), message)).otherwise(
        F.format_string("%6.3fs | frame %06d | %s", F.col("t"), F.col("frame"), message)
    )
    return log.withColumn("line", F.when(timed, fresh).otherwise(F.col("line")))
