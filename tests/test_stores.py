"""Sinks whose files follow bytes, the model store, folds, and joins that follow the contacts."""

import glob

import pytest
from pyspark.sql import functions as F

from quarte.operators import contacts as ct, learn
from quarte.sources import tables

RECORD = "match_id long, position long, record string"


def test_records_are_replaced_by_match(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.range(4000).select((F.col("id") % 500).alias("match_id"), F.expr("id div 500").alias("position"), F.concat(F.lit("a"), "id").alias("record"))
    tables.write_records(rows.repartition(16), path)
    tables.write_records(rows.where("match_id = 7 AND position < 2").withColumn("record", F.lit("new")), path)
    files = glob.glob(f"{path}/*/*.json")
    assert len(files) <= 3, files  # some kilobytes, whatever the number of tasks and matches
    got = tables.read_records(spark, path, RECORD)
    assert got.count() == 4000 - 8 + 2 and sorted(r.record for r in got.where("match_id = 7").collect()) == ["new", "new"]
    tables.compact_records(spark, path, f"{path}-2", RECORD)
    assert sorted(map(tuple, tables.read_records(spark, f"{path}-2", RECORD).collect())) == sorted(map(tuple, got.collect()))


def test_a_bucket_is_one_file_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "buckets")
    rows = spark.range(3000).select("id", F.concat(F.lit("b"), (F.col("id") % 4).cast("string")).alias("bucket"))
    tables.write_buckets(rows.repartition(16), path)
    assert len(glob.glob(f"{path}/*/*.parquet")) == 4
    tables.write_buckets(rows.where("bucket = 'b1'").limit(5), path)
    assert len(glob.glob(f"{path}/*/*.parquet")) == 4 and spark.read.parquet(path).count() == 3000 - 750 + 5


def test_folds_of_a_label_differ_by_one_at_most(spark):
    pairs = spark.range(1003).select(F.col("id").alias("phrase_id"), *(F.lit(1.0).alias(c) for c in learn.INPUTS))
    winners = spark.range(1003).select(F.col("id").alias("phrase_id"), F.when(F.col("id") % 3 == 0, "left").otherwise("right").alias("winner"))
    rows = learn.dataset(pairs, winners).groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in rows if r.label == label]
        assert len(sizes) == learn.FOLDS and max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in rows) == 1003


def test_a_store_gives_its_latest_model_whole(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "models")
    with pytest.raises(ValueError):
        learn.load(spark, store)
    data = spark.range(60).select(F.col("id").alias("phrase_id"), (F.col("id") % 2).cast("double").alias("label"), *((F.col("id") % 2 + F.lit(k) * 0.1).alias(c) for k, c in enumerate(learn.INPUTS)))
    model = learn.logistic().fit(data)
    learn.save(model, store, "logistic", {"logistic": 0.75, "boosting": 0.5}, 60)
    learn.save(model, store, "boosting", {"logistic": 0.75, "boosting": 0.9}, 61)
    loaded, entry = learn.load(spark, store)
    assert (entry["version"], entry["model"], entry["logistic"], entry["boosting"], entry["rows"]) == (1, "boosting", 0.75, 0.9, 61)
    got = learn.score(loaded, data, F.lit("right")).collect()
    assert {(r.phrase_id % 2, r.winner) for r in got} == {(0, "right"), (1, "left")}
    monkeypatch.setattr(learn, "INPUTS", learn.INPUTS[:-1])
    with pytest.raises(ValueError):
        learn.load(spark, store)


def test_rows_shuffled_follow_the_contacts(spark, tmp_path):
    """The pose table meets the wanted frames at the scan: nothing of it is shuffled while they are few."""
    spark.range(50_000).select(F.expr("id div 1000").alias("phrase_id"), (F.col("id") % 1000).cast("int").alias("frame"), F.rand(1).alias("x")).write.parquet(f"{tmp_path}/poses")
    poses = spark.read.parquet(f"{tmp_path}/poses")
    contacts = spark.range(50).select(F.col("id").alias("phrase_id"), F.when(F.col("id") % 2 == 0, 500).otherwise(3).alias("event_frame"), F.lit(1000).alias("n"))
    near = ct.around(poses, contacts, 10, 10)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    rows = near.collect()
    assert len(rows) == 25 * 21 + 25 * 14 and all(abs(r.frame - r.event_frame) <= 10 for r in rows)
