import datetime as dt
import json

import pytest
from seamgraph.operators import enrich
from seamgraph.streaming.events import event_stream, windowed_counts


def test_observations_become_candidate_edges(spark):
    lines = [
        {"file": "f1", "kind": "Call", "start": 4, "category": "function", "targets": [{"file": "f2", "start": 1, "end": 9}, {"file": "f9", "start": 0, "end": 1}]},
        {"other": 1},
    ]
    given = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("no json",)], "value string")
    with pytest.raises(Exception, match="InvalidEvidence"):
        enrich.observations(given).collect()
    found = enrich.observations(given, refuse=False)
    assert found.count() == enrich.observations(given.limit(1)).count() == 1
    symbols = spark.createDataFrame(
        [("s1", "f2", "Function", 2, 9), ("s2", "f2", "Struct", 2, 9), ("s3", "f2", "Method", 0, 9)], "id string, file string, kind string, start int, `end` int"
    )
    at = enrich.located(found, symbols)
    assert [r["compiler_targets"] for r in at.collect()] == [["s1"]]
    assert enrich.located(found, symbols, most=1).count() == 1
    with pytest.raises(Exception, match="ResourceLimitExceeded"):
        enrich.located(found, symbols, most=0).collect()
    edges = spark.createDataFrame([("e1", "a", None, "Call", "Unresolved", "f1", 4), ("e2", "a", "s1", "Call", "Resolved", "f1", 4)], "id string, source string, target string, kind string, resolution string, file string, start int")
    rows = enrich.project_targets(edges, at).collect()
    assert sorted((r["target"] or "", r["resolution"], r["basis"] or "") for r in rows) == [
        ("", "Unresolved", ""), ("s1", "CandidateTargets", "compiler_projection"), ("s1", "Resolved", "")
    ]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 12)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    rows = [(1, at(1), 1, "view", 1.0, "{}"), (2, at(2), 1, "view", 2.0, "{}"), (3, at(60), 1, "view", 4.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "in"))
    q = windowed_counts(event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = [(r["start"], r["n"], r["total"]) for r in spark.table("windows").collect()]
    finally:
        q.stop()
    assert got == [(t0, 2, 3.0)]
