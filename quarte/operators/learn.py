"""Contact models: data set, logistic regression, boosting, selection, scoring."""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from quarte.operators import contacts as ct
from quarte.operators.series import number

INPUTS = [f"delta_{c}" for c in ct.DELTAS] + ["front_gap", "front_gap_change", "front_velocity_gap", "stance_gap"]
FOLDS = 5
#: Bits of the hash that name a chunk of a label's order; chunks are counted, and each is ranked in a task of its own.
CHUNK_BITS = 12
#: Rows that a task of a training job takes. Boosting runs some thousand short jobs, so tasks follow rows, not files or cores.
TASK_ROWS = 1 << 15


def dataset(pairs: DataFrame, winners: DataFrame) -> DataFrame:
    """Paired features with label 1 for left; incomplete phrases are left out.

    ``pairs`` is a stored table of feature deltas, so the completeness test runs on its columns. Folds are stratified:
    within a label, phrases take the folds in turn in the order of their hash, so the folds of a label differ by one
    phrase at most. The order is numbered from the counts of chunks of the hash, so no task ranks a whole label."""
    rows = pairs.where(" AND ".join(f"{c} IS NOT NULL" for c in INPUTS)).join(winners, "phrase_id")
    rows = rows.withColumn("label", F.when(F.col("winner") == "left", 1.0).otherwise(0.0))
    rows = rows.withColumn("_code", F.xxhash64("phrase_id")).withColumn("_chunk", F.shiftright("_code", 64 - CHUNK_BITS))
    rows = number(rows, ["label"], "_chunk", ["_code", "phrase_id"], "_turn")
    return rows.withColumn("fold", F.pmod("_turn", F.lit(FOLDS)).cast("int")).drop("_code", "_chunk", "_turn")


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="skip")


def logistic() -> Pipeline:
    """Scaling is fitted inside each fold."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[assembler(), scaler, LogisticRegression(featuresCol="scaled", maxIter=1000, regParam=0.01)])


def boosting(rounds: int = 100) -> Pipeline:
    return Pipeline(stages=[assembler(), GBTClassifier(featuresCol="features", maxIter=rounds, maxDepth=3, seed=42)])


def dealt(data: DataFrame) -> DataFrame:
    """The rows in as many even partitions as their number asks for."""
    return data.repartition(max(1, -(-data.count() // TASK_ROWS)), "phrase_id")


def cross_validate(pipeline: Pipeline, data: DataFrame):
    """Model on all rows and its mean accuracy over the folds; all of them are fitted side by side."""
    return cross_validated([pipeline], data)[0]


def cross_validated(pipelines: list[Pipeline], data: DataFrame) -> list[tuple[PipelineModel, float]]:
    """``cross_validate`` of several pipelines, all fits of all of them side by side on one stored copy of the rows."""
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    data = dealt(data).persist()

    def fitted(task: tuple[Pipeline, int | None]):
        pipeline, fold = task
        if fold is None:
            return pipeline.fit(data)
        model = pipeline.fit(data.where(F.col("fold") != fold))
        return judge.evaluate(model.transform(data.where(F.col("fold") == fold)))

    tasks = [(p, fold) for p in pipelines for fold in (None, *range(FOLDS))]
    with ThreadPool(len(tasks)) as pool:
        found = pool.map(inheritable_thread_target(data.sparkSession)(fitted), tasks, 1)
    data.unpersist()
    own = [found[at : at + FOLDS + 1] for at in range(0, len(found), FOLDS + 1)]
    return [(model, sum(accuracies) / FOLDS) for model, *accuracies in own]


def select(data: DataFrame, rounds: int = 100) -> tuple[str, PipelineModel, dict[str, float]]:
    """Boosting when its mean accuracy is at least that of the logistic model."""
    (lr, lr_accuracy), (gbt, gbt_accuracy) = cross_validated([logistic(), boosting(rounds)], data)
    scores = {"logistic": lr_accuracy, "boosting": gbt_accuracy}
    return ("boosting", gbt, scores) if gbt_accuracy >= lr_accuracy else ("logistic", lr, scores)


ENTRY = "version long, folder string, model string, features array<string>, logistic double, boosting double, rows long"


def save(model: PipelineModel, store: str, name: str, scores: dict[str, float], rows: int) -> None:
    """Put a model with its metadata into a store.

    The model goes to a folder of its own; then one line of the store's list names it. A reader sees the model before or
    the new one, whole, and never a mixture."""
    spark = SparkSession.active()
    folder = f"{store}/model-{uuid.uuid4().hex}"
    model.write().save(folder)
    known = entries(spark, store)
    version = 1 + (known.agg(F.max("version")).first()[0] if known is not None else -1)
    line = [(version, folder, name, INPUTS, float(scores["logistic"]), float(scores["boosting"]), rows)]
    spark.createDataFrame(line, ENTRY).coalesce(1).write.mode("append").json(f"{store}/list")


def entries(spark: SparkSession, store: str) -> DataFrame | None:
    """The list of a store; None where nothing was stored yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/list")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(ENTRY).json(f"{store}/list")


def load(spark: SparkSession, store: str) -> tuple[PipelineModel, dict]:
    """The latest model of a store and its metadata; its features must be the ones that are made now."""
    known = entries(spark, store)
    if known is None:
        raise ValueError(f"no model is stored in {store}")
    entry = known.orderBy(F.desc("version")).first().asDict()
    if entry["features"] != INPUTS:
        raise ValueError(f"the stored model reads other features: {entry['features']}")
    return PipelineModel.load(entry["folder"]), entry


def score(model: PipelineModel, data: DataFrame, fallback: Column, threshold: float = 0.5) -> DataFrame:
    """Side at a contact: left from the threshold on. Rows with a missing feature
    take the fallback (right of way, or right)."""
    scored = model.transform(data.na.drop(subset=INPUTS)).select(
        "phrase_id", vector_to_array("probability")[1].alias("p_left")
    )
    rows = data.select("phrase_id", fallback.alias("_fallback")).join(scored, "phrase_id", "left")
    side = F.when(F.col("p_left") >= threshold, "left").when(F.col("p_left").isNotNull(), "right")
    return rows.select("phrase_id", "p_left", F.coalesce(side, "_fallback", F.lit("right")).alias("winner"))
