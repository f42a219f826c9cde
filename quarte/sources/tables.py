"""Table forms of poses, stamps and results: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarte.functions.geometry import JOINTS

# COCO joint names.
JOINT_NAMES = {
    0: "nose", 1: "left_eye", 2: "right_eye", 3: "left_ear", 4: "right_ear", 5: "left_shoulder", 6: "right_shoulder",
    7: "left_elbow", 8: "right_elbow", 9: "left_wrist", 10: "right_wrist", 11: "left_hip", 12: "right_hip",
    13: "left_knee", 14: "right_knee", 15: "left_ankle", 16: "right_ankle",
}
FRAME_STAMPS = "match_id STRING, frame INT, ts BIGINT, mono_ns BIGINT"


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def null_safe_json(body: Column) -> Column:
    return F.to_json(body, {"ignoreNullFields": "false"})


def to_sheets(wide: DataFrame) -> DataFrame:
    """Poses as sheet rows (phrase_id, sheet, frame, kp_0..kp_16), one sheet per side and axis."""
    sheets = ", ".join(
        "named_struct('sheet', concat(initcap(side), '_{u}'), {cols})".format(
            u=a.upper(), cols=", ".join(f"'kp_{k}', {a}{k}" for k in JOINTS)
        )
        for a in "xy"
    )
    return wide.selectExpr("phrase_id", "frame", f"inline(array({sheets}))")


def scan_sheets(sheets: DataFrame) -> DataFrame:
    """Sheet rows as long poses. Headers may be kp_N or N in any case, all 17 are
    required; text that is not a number is missing."""
    known = {c.strip().lower(): c for c in sheets.columns}
    picked = {k: known.get(f"kp_{k}", known.get(str(k))) for k in JOINTS}
    missing = [k for k, c in picked.items() if c is None]
    if missing:
        raise ValueError(f"missing joint columns {missing}")
    cells = ", ".join(f"named_struct('kp', {k}, 'v', try_cast(`{c}` AS DOUBLE))" for k, c in picked.items())
    rows = sheets.selectExpr("phrase_id", "lower(trim(sheet)) AS sheet", "frame", f"inline(array({cells}))")
    side = F.substring_index("sheet", "_", 1)
    axis = lambda a: F.max(F.when(F.col("sheet").endswith(f"_{a}"), finite(F.col("v")))).alias(a)
    return rows.groupBy("phrase_id", side.alias("side"), "frame", "kp").agg(axis("x"), axis("y"))


def write_sheets(wide: DataFrame, path: str) -> None:
    """Sheets as Parquet, one folder per sheet, rows of a phrase together and in order."""
    rows = to_sheets(wide)
    rows.repartitionByRange("sheet", "phrase_id", "frame").sortWithinPartitions("sheet", "phrase_id", "frame").write.mode(
        "overwrite"
    ).partitionBy("sheet").parquet(path)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return scan_sheets(spark.read.parquet(path))


def read_stamps(spark: SparkSession, path: str) -> DataFrame:
    """Frame stamps from JSON lines; blank lines are skipped."""
    rows = spark.read.schema(FRAME_STAMPS).option("mode", "PERMISSIVE").json(path)
    return rows.where("frame IS NOT NULL")


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines with null fields kept (frame stamps, mappings, decisions)."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files as lines: phrase_id (file name without extension), line_no, line.

    Each file is one phrase log of a few kilobytes; the folder is read in parallel."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("phrase_id"), "value"
    )
    lines = files.select("phrase_id", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("i", "line"))
    return lines.select("phrase_id", (F.col("i") + 1).alias("line_no"), "line")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """File listing without contents: phrase_id (folder), name, length, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("phrase_id"), F.element_at(parts, -1).alias("name"), "length",
        F.col("modificationTime").alias("modified"),
    )


def write_predictions(rows: DataFrame, path: str, key: str) -> None:
    """Predictions as CSV with a header, sorted by key over all files."""
    rows.orderBy(key).write.mode("overwrite").option("header", "true").csv(path)


def write_features(rows: DataFrame, path: str) -> None:
    """The feature table as Parquet, in files by size."""
    rows.hint("rebalance").write.mode("overwrite").parquet(path)


def write_decisions(rows: DataFrame, path: str) -> None:
    """One line per item: its number, a tab, and the decision as JSON text with null fields kept."""
    rows.select(F.concat_ws("\t", F.col("item_id").cast("string"), "body")).write.mode("overwrite").text(path)


def read_decisions(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Decisions with their parts; a line that is no JSON has none."""
    rows = spark.read.text(path).select(F.split("value", "\t", 2).alias("v"))
    return rows.select(F.col("v")[0].cast("long").alias("item_id"), F.from_json(F.col("v")[1], columns).alias("d")).select("item_id", "d.*")


def write_buckets(rows: DataFrame, path: str, bucket: str = "bucket") -> None:
    """Rows by bucket; only the buckets at hand are replaced.

    One exchange puts the rows of a bucket together, so that a bucket is one file; Spark cuts partitions beyond its
    advisory size, so that the file count follows bytes and not tasks."""
    dealt = rows.hint("rebalance", F.col(bucket))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def append_status(rows: DataFrame, path: str) -> None:
    """Append status rows of a batch; the summary is an aggregate over the log."""
    rows.write.mode("append").json(path)


VERSION = "version"


def write_records(records: DataFrame, path: str) -> None:
    """Match records; writing a match again replaces it whole.

    Every write is a version of its own, so the old records stay whole until the new ones are committed. One exchange
    clusters the rows by match, and Spark cuts and joins partitions by their bytes: a version has as many files as its size
    asks for, whatever the number of tasks and matches."""
    spark = records.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    last = max((int(n.split("=")[1]) for n in names if n.startswith(f"{VERSION}=")), default=-1)
    clustered = records.hint("rebalance", F.col("match_id"))
    clustered.sortWithinPartitions("match_id", "position").write.json(f"{path}/{VERSION}={last + 1}")


def read_records(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Records of the latest version of every match."""
    rows = spark.read.schema(f"{columns}, {VERSION} long").json(path)
    latest = rows.groupBy("match_id").agg(F.max(VERSION).alias(VERSION))
    return rows.join(latest, ["match_id", VERSION]).drop(VERSION)


def compact_records(spark: SparkSession, path: str, to: str, columns: str) -> None:
    """Write the latest records as the only version of a new store."""
    write_records(read_records(spark, path, columns), to)
