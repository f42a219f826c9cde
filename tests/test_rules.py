"""Literal cases of the match side and loop forms of the movement rules."""

import pytest
from pyspark.sql import functions as F

from quarte.functions import codes
from quarte.operators import devices, intervals as iv, matches as mt, tracking as tr
from quarte.operators.tracks import Arena
from quarte.params import LungeRules
from quarte.sources import tables


def test_crc_vector(spark):
    row = spark.range(1).select(F.hex(F.lit("123456789")).alias("d")).select(mt.crc16("d").alias("c")).first()
    assert row.c == 0x31C3


def test_serial_frames_reject_broken_ones(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["serial_frames"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.ok == (r.event_id % 7 != 0) for r in rows)


def test_hit_digits(spark):
    cases = {"AT3YZ": 3, "AT8YZ": 8, "AT9YZ": 9, "AT:YZ": None, "AT0YZ": None, "XT3YZ": None, "AT3YX": None, "AT3Y": None}
    df = spark.createDataFrame(list(cases.items()), "t string, want int")
    assert all(r.d == r.want for r in df.select("want", mt.hit_digit(F.col("t")).alias("d")).collect())


def test_final_lights(spark):
    cases = [("0003", True, False), ("0300", False, True), ("0000", True, True), ("0102", False, False), ("0303", False, False), ("", False, False), ("00", True, False)]
    df = spark.createDataFrame(cases, "h string, a boolean, b boolean")
    a, b = mt.lights(F.col("h"))
    assert all(r.a == r.x and r.b == r.y for r in df.select("a", "b", a.alias("x"), b.alias("y")).collect())


def test_light_result(spark):
    df = spark.createDataFrame([(True, False, 8), (False, True, 9), (True, True, 10), (False, False, 0)], "a boolean, b boolean, want int")
    assert all(r.c == r.want for r in df.select("want", codes.light_result(F.col("a"), F.col("b")).alias("c")).collect())


def test_sequence_repeats(spark):
    df = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 2, 8), (1, 3, None), (1, 4, None), (1, 5, None)], "d int, t int, seq int")
    rows = mt.drop_repeats(df.withColumn("c", F.lit(0)), "d", "c", ["t"], "seq").collect()
    assert sorted((r.seq or 0, r.t) for r in rows) == [(0, 3), (0, 4), (0, 5), (7, 0), (8, 2)]


def test_corrections(spark):
    signals = spark.createDataFrame([(1, 0, 2000), (1, 1, 3000)], "match_id int, position int, signal_ts long")
    fixes = spark.createDataFrame([(1, 0, 1, 3033), (1, 1, 5, 9), (1, 2, 0, None)], "match_id int, seq int, position int, new_ts long")
    rows = mt.apply_corrections(signals, fixes).orderBy("position").collect()
    assert [(r.signal_ts, r.changed) for r in rows] == [(2000, False), (3033, True)]


def test_debounce_bursts(spark, tiny_chunks):
    times = [0, 5, 14, 16, 20, 31, 32, 60, 70, 74, 76, 200]
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "d long, t long, i long")
    rows = devices.debounce(df.withColumn("c", F.expr("t div 30")), "d", "c", "t", "i", 15).collect()
    kept, last = [], None
    for t in times:
        if last is None or t - last >= 15:
            kept.append(t)
            last = t
    assert sorted(r.t for r in rows) == kept


def grow(core, left, right):
    """Alternating growth, one frame left then one right."""
    l = r = 0
    while True:
        moved = False
        if l < left and core / (core + l + r + 1) > 0.5:
            l, moved = l + 1, True
        if r < right and core / (core + l + r + 1) > 0.5:
            r, moved = r + 1, True
        if not moved:
            return l, r


def test_lunge_growth(spark):
    cases = [(c, l, r) for c in (2, 3, 5, 8) for l in (0, 1, 2, 4, 7) for r in (0, 1, 3, 6)]
    rows = []
    for i, (core, left, right) in enumerate(cases):
        gaps = [0.1] + [0.95] * left + [1.5] * core + [0.95] * right + [0.1]
        rows += [(i, "left", f, 0.0, 0.0, d, 0.0) for f, d in enumerate(gaps)]
    df = spark.createDataFrame(rows, "phrase_id int, side string, frame int, x15 double, y15 double, x16 double, y16 double")
    got = {r.phrase_id: r for r in iv.expand_cores(df, LungeRules(min_frames=2)).collect()}
    for i, (core, left, right) in enumerate(cases):
        l, r = grow(core, left, right)
        assert (got[i].core_start - got[i].start_frame, got[i].end_frame - got[i].core_end) == (l, r)


def test_tracks_use_a_detection_once(spark):
    from quarte.sources import adapters as src

    dets = src.detections(spark, "/root/testdata/sf0.001")
    rows = tr.track(dets, tr.TrackRules(Arena(1200, 1200))).where("observed").collect()
    assert rows and len({(r.phrase_id, r.frame, r.det_idx) for r in rows}) == len(rows)


def test_sheets_need_all_joints(spark):
    with pytest.raises(ValueError):
        tables.scan_sheets(spark.createDataFrame([(1, "Left_X", 0, 1.0)], "phrase_id int, sheet string, frame int, kp_0 double"))


def test_json_keeps_nulls(spark):
    body = F.struct(tables.finite(F.lit(float("nan"))).alias("a"), F.lit(1).alias("b"))
    assert spark.range(1).select(tables.null_safe_json(body).alias("j")).first().j == '{"a":null,"b":1}'


def test_file_round_trips(spark, tmp_path):
    log = tmp_path / "logs" / "p1"
    log.mkdir(parents=True)
    (log / "p1.txt").write_text("one\ntwo\n")
    rows = tables.read_logs(spark, str(tmp_path / "logs")).orderBy("line_no").collect()
    assert [(r.phrase_id, r.line_no, r.line) for r in rows] == [("p1", 1, "one"), ("p1", 2, "two")]
    assert [r.name for r in tables.read_artifacts(spark, str(tmp_path / "logs")).collect()] == ["p1.txt"]
    stamps = tmp_path / "stamps"
    tables.write_json(spark.createDataFrame([("m", 0, 5, None)], tables.FRAME_STAMPS), str(stamps))
    (stamps / "part-extra.json").write_text('\n{"match_id":"m","frame":1,"ts":9}\n')
    assert sorted((r.frame, r.ts) for r in tables.read_stamps(spark, str(stamps)).collect()) == [(0, 5), (1, 9)]
    tables.write_buckets(spark.createDataFrame([(1, "a"), (2, "b")], "i int, bucket string"), str(tmp_path / "buckets"))
    tables.write_buckets(spark.createDataFrame([(3, "b")], "i int, bucket string"), str(tmp_path / "buckets"))
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "buckets")).collect()) == [1, 3]
    tables.append_status(spark.createDataFrame([(1, "ok")], "i int, status string"), str(tmp_path / "status"))
    tables.append_status(spark.createDataFrame([(2, "error")], "i int, status string"), str(tmp_path / "status"))
    assert spark.read.json(str(tmp_path / "status")).count() == 2
    tables.write_predictions(spark.createDataFrame([(2, "x"), (1, "y")], "k int, p string"), str(tmp_path / "pred"), "k")
    assert [r.k for r in spark.read.option("header", True).csv(str(tmp_path / "pred")).collect()] == ["1", "2"]
