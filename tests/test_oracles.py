"""Registered queries against their SQL on the smallest tables, with tiny chunks."""

import pytest

SF = "/root/testdata/sf0.001"
NAMES = (
    "gradient", "run_islands", "interp_gaps", "pauses_fps30", "asof_nearest_ts", "seq_dedup", "phrase_log_fps30",
    "match_record", "message_ingest", "contact_candidates", "pose_scan", "match_lifecycle", "dedup_stream",
    "debounce", "serial_stream", "serial_counters", "sheet_scan_filled", "prediction_sink_forms", "oracle_compare", "contact_case",
)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tiny_chunks, monkeypatch, name):
    import __spark_entry__ as entry
    from quarte.operators import series
    from quarte.plans.check import compare, duck

    monkeypatch.setattr(series, "CHUNK", 9)
    good, why, n = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert good and n > 0, why


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
