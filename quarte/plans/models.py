"""Model queries over short phrases cut from the pose table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarte.operators import contacts as ct, learn
from quarte.plans import views as v
from quarte.plans.decisions import PAIR_SQL, DELTA_EXPR
from quarte.plans.registry import query, rnd
from quarte.plans.views import sql
from quarte.session import checkpoint_dir, stage
from quarte.sources import adapters as src

# Frames per short phrase and the contact frame inside it.
CUT, CONTACT = 8, 6
#: Short phrases that a label has room for; keys are BIGINT.
PHRASES = "10000000000L"


def short_phrases(spark, sf):
    """Whole pose table cut into phrases of eight frames."""
    return src.poses(spark, sf).withColumns(
        {"phrase_id": F.expr(f"phrase_id * {PHRASES} + frame div {CUT}"), "frame": F.expr(f"int(frame % {CUT})")}
    )


def samples(spark, sf):
    poses = stage(short_phrases(spark, sf))
    sizes = poses.where("side = 'left'").groupBy("phrase_id").agg(F.count("frame").cast("int").alias("n"))
    contacts = stage(sizes.withColumn("event_frame", F.least(F.lit(CONTACT), F.col("n") - 1)))
    # The adapter has no verdicts: a fixed hash stands for the label.
    winners = contacts.select("phrase_id", F.when(F.xxhash64("phrase_id") % 3 == 0, "left").otherwise("right").alias("winner"))
    pairs = stage(ct.feature_deltas(ct.side_pair(stage(ct.fencer_features(poses, contacts)))))
    return stage(learn.dataset(pairs, winners))


@query(
    "ml_dataset",
    sql(
        f"SELECT phrase_id, {', '.join(f'{v.rnd(e, 3)} AS {n}' for n, e in DELTA_EXPR.items())} FROM lr", "posef",
        **{
            "poses": "SELECT label::BIGINT * 10000000000 + frame0 // 8 AS phrase_id, side, (frame0 % 8)::INT AS frame, COORDS FROM (SELECT phrase_id AS label, frame AS frame0, vec_id, e FROM posef), (VALUES ('left'), ('right')) s(side)".replace(
                "COORDS", ", ".join(v._coord(k, a) for k in range(17) for a in (0, 1))
            ),
            **PAIR_SQL,
            "ce": "SELECT phrase_id, least(6, n - 1)::INT AS event_frame, n FROM (SELECT phrase_id, count(*)::INT AS n FROM poses WHERE side = 'left' GROUP BY phrase_id)",
        },
    ),
)
def ml_dataset(spark, sf):
    return samples(spark, sf).select("phrase_id", *[rnd(n, 3).alias(n) for n in DELTA_EXPR])


@query("ml_logistic")
def ml_logistic(spark, sf):
    model, accuracy = learn.cross_validate(learn.logistic(), samples(spark, sf))
    weights = [float(w) for w in model.stages[-1].coefficients]
    return spark.createDataFrame([(n, w, float(accuracy)) for n, w in zip(learn.INPUTS, weights)], "feature string, weight double, accuracy double")


@query("ml_gbt")
def ml_gbt(spark, sf):
    model, accuracy = learn.cross_validate(learn.boosting(), samples(spark, sf))
    weights = [float(w) for w in model.stages[-1].featureImportances.toArray()]
    return spark.createDataFrame([(n, w, float(accuracy)) for n, w in zip(learn.INPUTS, weights)], "feature string, weight double, accuracy double")


def store_of(spark, sf):
    """The model store of a data folder and session, in the shared folder."""
    name = re.sub(r"\W+", "-", sf).strip("-")
    return f"{checkpoint_dir(spark).rstrip('/')}/quarte-models-{spark.sparkContext.applicationId}-{name}"


def trained(spark, sf, data):
    """Both models compared, the better one stored with the accuracies of both."""
    name, model, scores = learn.select(data)
    learn.save(model, store_of(spark, sf), name, scores, data.count())


@query("ml_select")
def ml_select(spark, sf):
    """What the store says of the model that was chosen."""
    trained(spark, sf, samples(spark, sf))
    _, entry = learn.load(spark, store_of(spark, sf))
    rows = [(k, entry[k], entry["model"] == k, entry["rows"]) for k in ("logistic", "boosting")]
    return spark.createDataFrame(rows, "model string, accuracy double, chosen boolean, rows long")


@query("ml_score")
def ml_score(spark, sf):
    """Sides by the stored model; one is trained where the store has none."""
    data = samples(spark, sf)
    if learn.entries(spark, store_of(spark, sf)) is None:
        trained(spark, sf, data)
    model, _ = learn.load(spark, store_of(spark, sf))
    return learn.score(model, data, F.lit("right"))
