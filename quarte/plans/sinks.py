"""Sinks, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.operators import asof, evaluate as ev
from quarte.plans.logs import ASOF, NEAREST, user_signals
from quarte.plans.registry import query
from quarte.plans.views import sql
from quarte.session import shared_path as folder
from quarte.sources import adapters as src, tables


@query(
    "mapping_sink",
    sql(f"SELECT idx, ({NEAREST})::BIGINT AS mapped_frame, 'nearest' AS mapping_mode FROM af", "signals", "frames", **ASOF),
)
def mapping_sink(spark, sf):
    rows = asof.neighbours(user_signals(spark, sf), src.frames(spark, sf), ["user_id"], "ts", "frame")
    rows = asof.pick(rows, "ts").select("idx", F.col("chosen.frame").alias("mapped_frame"), F.lit("nearest").alias("mapping_mode"))
    path = folder(spark, "mapping")
    tables.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("prediction_sink", sql("SELECT item_id, predicted, confidence FROM predictions", "predictions"))
def prediction_sink(spark, sf):
    rows = src.predictions(spark, sf).select("item_id", "predicted", "confidence")
    path = folder(spark, "predictions")
    tables.write_predictions(rows, path, "item_id")
    return spark.read.schema(rows.schema).option("header", "true").csv(path)


FORMS = ("csv", "features", "predictions", "decisions")


@query(
    "prediction_sink_forms",
    sql("SELECT form, item_id, predicted, CASE WHEN form <> 'features' THEN confidence END AS confidence, CASE WHEN form = 'features' THEN item_id % 7 / 4.0::DOUBLE END AS score "
        f"FROM predictions, (SELECT unnest({list(FORMS)}) AS form)", "predictions"),
)
def prediction_sink_forms(spark, sf):
    """The four forms of one set of predictions, each written and read back: a CSV list, the feature table, JSON lines and
    one JSON decision per item."""
    rows = src.predictions(spark, sf).select("item_id", "predicted", "confidence", (F.col("item_id") % 7 / 4.0).alias("score"))
    paths = {form: folder(spark, f"predictions-{form}") for form in FORMS}
    tables.write_predictions(rows.select("item_id", "predicted", "confidence"), paths["csv"], "item_id")
    tables.write_features(rows.select("item_id", "predicted", "score"), paths["features"])
    tables.write_json(rows.select("item_id", "predicted", "confidence"), paths["predictions"])
    body = tables.null_safe_json(F.struct(F.col("predicted").alias("winner"), "confidence", tables.finite(F.lit(float("nan"))).alias("margin")))
    tables.write_decisions(rows.select("item_id", body.alias("body")), paths["decisions"])
    columns = "item_id long, predicted string, confidence string"
    back = {
        "csv": spark.read.schema(columns).option("header", "true").csv(paths["csv"]),
        "features": spark.read.parquet(paths["features"]),
        "predictions": spark.read.schema(columns).json(paths["predictions"]),
        "decisions": tables.read_decisions(spark, paths["decisions"], "winner string, confidence string, margin double").withColumnRenamed("winner", "predicted"),
    }
    out = None
    for form, table in back.items():
        part = table.withColumn("form", F.lit(form))
        part = part.select("form", "item_id", "predicted", *(F.col(c) if c in table.columns else F.lit(None).cast(t).alias(c) for c, t in (("confidence", "string"), ("score", "double"))))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "batch_log",
    sql("SELECT count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) FILTER (o_orderstatus <> 'F') AS skipped, 0::BIGINT AS errors FROM orders"),
)
def batch_log(spark, sf):
    """Two appends to one status log, then the summary over it."""
    orders = src.table(spark, sf, "orders")
    row = lambda status: [
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit(status).alias("status"), F.lit(1.0).alias("seconds"),
    ]
    path = folder(spark, "status")
    done = orders.where("o_orderstatus = 'F'").select(*row("ok"))
    tables.append_status(done, path)
    tables.append_status(orders.where("o_orderstatus <> 'F'").select(*row("skipped_existing")), path)
    return ev.batch_status(spark.read.schema(done.schema).json(path)).select("processed", "skipped", "errors")
