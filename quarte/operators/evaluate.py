"""Evaluation of verdicts, classifiers and models, and catalogs of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarte.operators.series import spread_join

# Video extensions in order of preference, joint groups.
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".webm")
JOINT_GROUPS = {"elbows": (7, 8), "wrists": (9, 10), "knees": (13, 14), "ankles": (15, 16)}
BENCH = {
    "throughput_qps": r"Throughput:\s+([0-9.]+)\s+qps",
    "latency_ms": r"Latency:.*mean = ([0-9.]+) ms",
    "enqueue_ms": r"Enqueue Time:.*mean = ([0-9.]+) ms",
    "compute_ms": r"GPU Compute Time:.*mean = ([0-9.]+) ms",
    "generation_s": r"Engine generation completed in ([0-9.]+) seconds",
    "build_s": r"Engine built in ([0-9.]+) sec",
    "size_mib": r"Created engine with size: ([0-9.]+) MiB",
}


def share(cond: Column) -> Column:
    """Mean of a condition over the rows where it is known."""
    return F.avg(F.when(cond, 1.0).when(~cond, 0.0))


def matches(label: Column, predicted: Column) -> Column:
    """A label abstain accepts any verdict."""
    any_side = predicted.isin("left", "right", "abstain")
    return F.coalesce(F.when(label == "abstain", any_side).otherwise(label == predicted), F.lit(False))


def accuracy(df: DataFrame) -> DataFrame:
    """Rows, labelled rows, accuracy and balanced accuracy of 0/1 predictions."""
    right = F.col("predicted") == F.col("label")
    sides = [share(F.when(F.col("label") == k, right)) for k in (1, 0)]
    return df.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count("label").alias("rows_labelled"),
        share(right).alias("accuracy"),
        ((sides[0] + sides[1]) * 0.5).alias("balanced"),
    )


def accuracy_by_tier(df: DataFrame) -> DataFrame:
    """Count and accuracy per confidence tier with an ``all`` row."""
    right = F.col("predicted") == F.col("label")
    rows = df.where("label IS NOT NULL").rollup("confidence").agg(F.count("label").alias("n"), share(right).alias("accuracy"))
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit("all")))


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class from one grouped count."""
    counts = df.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    both = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    sums = both.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return sums.select(
        "cls",
        zero(F.col("hit"), F.col("said")).alias("precision"),
        zero(F.col("hit"), F.col("support")).alias("recall"),
        zero(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )


def joint_errors(candidate: DataFrame, oracle: DataFrame, keys: list[str], norm: float) -> DataFrame:
    """Distance of candidate joints to reference joints, both valid, in norm units."""
    ref = oracle.select(*keys, F.col("x").alias("ox"), F.col("y").alias("oy"))
    good = lambda x, y: (F.col(x) > 0) & (F.col(y) > 0)
    rows = candidate.where(good("x", "y")).join(ref.where(good("ox", "oy")), keys)
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return rows.select(*keys, (F.sqrt(dx * dx + dy * dy) / max(norm, 1e-6)).alias("error"))


def pck(errors: DataFrame) -> DataFrame:
    """Share of joints within 0.05 and 0.10, mean error and count per joint."""
    return errors.groupBy("kp").agg(
        share(F.col("error") <= 0.05).alias("pck_05"),
        share(F.col("error") <= 0.10).alias("pck_10"),
        F.avg("error").alias("mean_error"),
        F.count("error").alias("n"),
    )


def group_errors(errors: DataFrame) -> DataFrame:
    name = F.coalesce(*[F.when(F.col("kp").isin(*ks), F.lit(n)) for n, ks in JOINT_GROUPS.items()])
    rows = errors.withColumn("joint_group", name).where("joint_group IS NOT NULL")
    return rows.groupBy("joint_group").agg(F.avg("error").alias("mean_error"), F.count("error").alias("n"))


def model_summary(runs: DataFrame) -> DataFrame:
    """Per model: phrases, mean seconds and effective fps; a missing timing counts as 0."""
    seconds = F.avg(F.coalesce("seconds", F.lit(0.0)))
    return runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("phrases"),
        seconds.alias("mean_seconds"),
        (F.avg("frames") / F.nullif(seconds, F.lit(0.0))).alias("fps"),
    )


def detection_stats(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Frames, frames with people, mean and largest count of people per frame.
    ``person`` is NULL for a frame without anybody."""
    frames = detections.groupBy(*keys, "frame").agg(F.count("person").alias("people"))
    return frames.groupBy(*keys).agg(
        F.count("people").alias("frames"),
        F.count_if(F.col("people") > 0).alias("nonzero"),
        F.avg("people").alias("mean_people"),
        F.max("people").alias("max_people"),
    )


def video_score(name: Column) -> Column:
    """Lower is better: extension order, overlays last, corrected first."""
    low = F.lower(name)
    ext = F.regexp_extract(low, r"(\.[a-z0-9]+)$", 1)
    rank = F.lit(len(VIDEO_EXTENSIONS) + 1)
    for i, e in enumerate(VIDEO_EXTENSIONS):
        rank = F.when(ext == e, i).otherwise(rank)
    return rank + F.when(low.contains("overlay"), 100).otherwise(0) - F.when(low.contains("corrected"), 10).otherwise(0)


def best_videos(files: DataFrame) -> DataFrame:
    """Best video file per phrase; a running minimum, no sorting of whole phrases."""
    videos = files.where(F.lower("name").rlike(r"\.(mp4|avi|mov|mkv|webm)$"))
    best = F.min(F.struct(video_score(F.col("name")).alias("score"), F.lower("name").alias("low"), "name"))
    rows = videos.groupBy("phrase_id").agg(best.alias("best"), F.count("name").alias("n_videos"))
    return rows.select("phrase_id", F.col("best.name").alias("name"), F.col("best.score").alias("score"), "n_videos")


def match_status(files: DataFrame) -> DataFrame:
    """Status of each match from its files; a match with neither video nor record is left out."""
    mp4, record = F.col("name").endswith(".mp4"), F.col("name").endswith(".json")
    rows = files.groupBy("phrase_id").agg(
        F.bool_or(mp4).alias("mp4"), F.bool_or(record).alias("record"), F.sum(F.when(mp4, F.col("length")).otherwise(0)).alias("bytes")
    )
    status = F.when(F.col("mp4") & F.col("record"), "complete").when(F.col("record"), "uploaded").when(F.col("mp4"), "incomplete")
    return rows.withColumn("status", status).where("status IS NOT NULL").select("phrase_id", "status", "bytes")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a sorted listing, counted from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows after a key."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key. Spark keeps n rows per key in every task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def validation_buckets(df: DataFrame) -> DataFrame:
    """Counts per verdict and contact rule with all subtotals."""
    rows = df.groupingSets([["verdict", "contact"], ["verdict"], []], "verdict", "contact").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        F.coalesce("verdict", F.lit("all")).alias("verdict"), F.coalesce("contact", F.lit("all")).alias("contact"), "n"
    )


def batch_status(log: DataFrame) -> DataFrame:
    done = F.col("status") == "ok"
    return log.agg(
        F.count_if(done).alias("processed"),
        F.count_if(F.col("status") == "skipped_existing").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("seconds").alias("elapsed"),
        F.max_by("name", F.when(done, F.col("seq"))).alias("last_completed"),
    )


def with_constant(df: DataFrame, constants: DataFrame, default: float = 1.0) -> DataFrame:
    """Add the normalisation constant of the phrase, the default where there is none."""
    rows = spread_join(df, constants, ["phrase_id"], F.col("frame"), "left")
    return rows.withColumn("c", F.coalesce("c", F.lit(default)))


def bench_numbers(line: str = "line") -> dict[str, Column]:
    return {n: F.nullif(F.regexp_extract(line, p, 1), F.lit("")).cast("double") for n, p in BENCH.items()}
