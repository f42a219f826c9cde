"""Stream queries over a table stored as a folder of files in shuffled order, one file for each micro-batch."""

import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = (
    "dedup_stream", "match_lifecycle_stream", "heartbeat_stream", "signal_frame_stream", "result_timeout_stream", "active_gate_stream",
    "message_routing_stream",
)


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The smallest tables, events as six files whose order has nothing to do with time."""
    from pyspark.sql import functions as F

    folder = tmp_path_factory.mktemp("sf")
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", folder / name)
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy(F.xxhash64("event_id")).repartition(6, F.xxhash64("event_id") % 6).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_streams_are_whole_in_any_file_order(spark, shuffled, monkeypatch, name):
    import __spark_entry__ as entry
    from quarte.plans.check import compare, duck
    from quarte.streaming import sessions

    whole = sessions.replay
    monkeypatch.setattr(sessions, "replay", lambda rows, time, files=1: whole(rows, time, 1, 3))
    good, why, n = compare(entry.queries()[name](spark, shuffled), duck(SF), entry.oracle_sql()[name])
    assert good and n > 0, why


@pytest.mark.parametrize("name", ("heartbeat_stream", "signal_frame_stream", "result_timeout_stream"))
def test_slices_of_several_files_lose_no_rows(spark, shuffled, monkeypatch, name):
    """Batches of two stretches each, far longer than the watermark's delay; rows out of order would be lost from the third on."""
    import __spark_entry__ as entry
    from quarte.plans.check import compare, duck
    from quarte.streaming import sessions

    whole = sessions.replay
    monkeypatch.setattr(sessions, "replay", lambda rows, time, files=2: whole(rows, time, 2, 7))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        good, why, n = compare(entry.queries()[name](spark, shuffled), duck(SF), entry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert good and n > 0, why


def test_source_reads_a_file_and_a_folder(spark, shuffled):
    from quarte.streaming import sessions

    n = spark.read.parquet(f"{SF}/events.parquet").count()
    for folder in (SF, shuffled):
        assert sessions.run_to_end(sessions.source(spark, folder, "events", 1), "plain").count() == n


def test_no_shared_folder_off_a_local_master_is_an_error(spark):
    from types import SimpleNamespace

    from quarte.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        checkpoint_dir(SimpleNamespace(conf=Conf(), sparkContext=context))


def test_package_is_shipped_from_any_folder(tmp_path):
    """A query whose workers need the package runs from another folder."""
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from quarte.session import local_session\n"
        "import __spark_entry__ as entry\n"
        "spark = local_session(2, 2)\n"
        "print('ROWS', entry.queries()['bootstrap_clusters'](spark, sys.argv[2]).count())\n"
    )
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, repo, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
