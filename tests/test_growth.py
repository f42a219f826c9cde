"""Steps whose time grew with more than the rows: training tasks, checksums, medians."""

import binascii

from pyspark.sql import functions as F


def test_training_tasks_follow_rows(spark):
    """F6, F8: boosting ran a task per file and core in every one of its jobs."""
    from quarte.operators import learn

    rows = spark.range(1000).withColumnRenamed("id", "phrase_id").repartition(40)
    assert learn.dealt(rows).rdd.getNumPartitions() == 1
    assert learn.dealt(spark.range(learn.TASK_ROWS * 2 + 1).toDF("phrase_id")).rdd.getNumPartitions() == 3
    assert learn.dealt(rows).count() == 1000


def test_folds_and_whole_data_give_the_accuracy_of_each_fold(spark):
    """F6, F8: against fits one after the other."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from quarte.operators import learn

    i = F.col("phrase_id")
    data = spark.range(200).toDF("phrase_id").select(
        i, ((i * 7 % 11) > 4).cast("double").alias("label"), (i % learn.FOLDS).cast("int").alias("fold"),
        *((i * (k + 3) % 11).cast("double").alias(c) for k, c in enumerate(learn.INPUTS)),
    )
    model, accuracy = learn.cross_validate(learn.logistic(), data)
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    each = [judge.evaluate(learn.logistic().fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k))) for k in range(learn.FOLDS)]
    assert abs(accuracy - sum(each) / learn.FOLDS) < 1e-9
    whole = learn.logistic().fit(data).stages[-1].coefficients.toArray()
    assert abs(model.stages[-1].coefficients.toArray() - whole).max() < 1e-6


def test_checksum_takes_one_step_a_byte(spark):
    """every byte took eight steps of a fold inside a fold."""
    from quarte.operators.matches import crc16

    texts = [bytes(range(k, k + n)).hex().upper() for k, n in ((0, 256), (3, 17), (200, 1), (7, 40))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", crc16("t").alias("crc"))
    assert {r.t: r.crc for r in rows.collect()} == {t: binascii.crc_hqx(bytes.fromhex(t), 0) for t in texts}
    assert rows._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_thresholds_take_two_rounds_of_medians(spark, monkeypatch):
    """medians were computed for each reader of them."""
    from quarte.operators import repair

    whole, calls = repair.middle, []
    monkeypatch.setattr(repair, "middle", lambda *a, **b: calls.append(1) or whole(*a, **b))
    moves = [f"{m}_{k}" for m in ("in", "pred") for k in repair.TARGETS]
    lengths = [f"len_{a}_{b}" for a, b in repair.ALL_BONES]
    rows = spark.range(9).select(F.lit(1).alias("phrase_id"), F.lit("left").alias("side"), *(F.col("id").cast("double").alias(c) for c in moves + lengths))
    got = repair.thresholds(rows).first()
    assert len(calls) == 2
    assert got["lim_in_7"] == 12.0 and got["lim_pred_16"] == 12.0 and got["lim_len_5_7"] == 4.0


def test_scoring_makes_its_rows_once_and_fits_both_models_on_one_copy(spark, monkeypatch):
    """F8: features were made for training and again for scoring, and rows stored once for each of the models."""
    from quarte.operators import learn
    from quarte.plans import models

    i = F.col("phrase_id")
    data = spark.range(60).toDF("phrase_id").select(
        i, (i * 7 % 11 > 4).cast("double").alias("label"), (i % learn.FOLDS).cast("int").alias("fold"),
        *((i * (k + 3) % 11).cast("double").alias(c) for k, c in enumerate(learn.INPUTS)),
    )
    made, dealt, boosting, deal = [], [], learn.boosting, learn.dealt
    monkeypatch.setattr(models, "samples", lambda spark, sf: made.append(sf) or data)
    monkeypatch.setattr(learn, "boosting", lambda rounds=2: boosting(2))
    monkeypatch.setattr(learn, "dealt", lambda rows: dealt.append(1) or deal(rows))
    rows = models.ml_score(spark, "rows made once").collect()
    assert sorted(r.phrase_id for r in rows) == list(range(60)) and all(r.p_left is not None for r in rows)
    assert len(made) == len(dealt) == 1
    _, entry = learn.load(spark, models.store_of(spark, "rows made once"))
    for name, pipeline in (("logistic", learn.logistic()), ("boosting", boosting(2))):
        assert abs(entry[name] - learn.cross_validate(pipeline, data)[1]) < 1e-9


def test_tables_of_a_row_per_key_are_not_broadcast(spark):
    """a stored table of medians looked small by its packed files, was repeated once a lane and filled the driver."""
    from quarte.operators import repair, series
    from quarte.session import stage

    first_join = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Join ")[0].split()[-1]
    values = spark.range(400).selectExpr("id % 20 AS k", "double(id) AS v")
    one = stage(spark.range(15).selectExpr("id AS k", "id * 10D AS med"))
    for how, n in (("inner", 300), ("left", 400)):
        rows = series.spread_join(values, one, ["k"], F.col("v"), how)
        assert first_join(rows) == "SortMerge" and "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
        got = rows.collect()
        assert len(got) == n and all(r.med == (r.k * 10 if r.k < 15 else None) for r in got)
    limits = repair.outlier_limit(values, ["k"], F.lit(0.5), stage(repair.middle(values, ["k"], F.col("v"), "med")))
    assert first_join(limits) == "SortMerge"
    assert {r.k: (r.med, r.mad, r.limit) for r in limits.collect()}[3] == (193.0, 100.0, 593.0)
