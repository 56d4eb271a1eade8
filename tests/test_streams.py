"""Loads that move a pointer, batches that are replayed, and sessions that stay open."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.session import scratch_path
from faultline.sources import tables as tb
from faultline.streaming import jobs, sessions


def test_failed_check_keeps_the_old_rows(spark):
    path = scratch_path(spark, "versions")
    table = tb.VersionedTable(spark, path)
    with pytest.raises(ValueError):
        table.rows()
    assert tb.load_table(spark.range(10), path) == 10
    before, reader = table.current(), table.rows()

    def refuse(stored):
        if stored.count() > 15:
            raise ValueError("too many")

    with pytest.raises(ValueError, match="too many"):
        tb.load_table(spark.range(20), path, refuse)
    assert table.current() == before and table.rows().count() == 10
    assert tb.load_table(spark.range(12), path, refuse) == 12
    assert table.rows().count() == 12 and reader.count() == 10  # an old reader keeps its version
    table.vacuum()
    assert table.rows().count() == 12 and tb.load_table(spark.range(0), path) == 0 and table.rows().count() == 0


def rows_of(spark, low, high):
    return spark.range(low, high).selectExpr(
        "id", "'t' AS ticket_text", "'Incident' AS ticket_type", "'HIGH' AS priority", "'q' AS queue", "0.5D AS confidence", "'r' AS recommendation", "timestamp_ntz'2024-01-01' + make_dt_interval(id % 3) AS created_at", "'stream' AS source"
    )


def test_replayed_batch_is_stored_once(spark):
    history = tb.History(spark, scratch_path(spark, "history"))
    sink = jobs.append_scored(history, "s", lambda b: b)
    sink(rows_of(spark, 0, 5), 0)
    sink(rows_of(spark, 5, 8), 1)
    sink(rows_of(spark, 5, 8), 1)
    assert sorted(r["id"] for r in history.rows().collect()) == list(range(8))
    history._add(rows_of(spark, 8, 9).withColumn("batch", F.lit("s/2")))  # the writer was lost before the ledger
    assert not history.append_once(rows_of(spark, 8, 9), "s", 2) and not history.append_once(rows_of(spark, 8, 9), "s", 2)
    assert history.append_once(rows_of(spark, 9, 11), "other", 2)
    history.append(rows_of(spark, 11, 12))
    assert sorted(r["id"] for r in history.rows().collect()) == list(range(12))
    for date in ("2024-01-01", "2024-01-02"):
        history.compact(date)
    assert sorted(r["id"] for r in history.rows().collect()) == list(range(12))
    assert history._stored().filter("date = '2024-01-01'").select(F.col("_metadata.file_path")).distinct().count() == 1
    assert not history.append_once(rows_of(spark, 5, 8), "s", 1)


def test_merged_sessions():
    assert sessions.merged([(0, 5, 2), (6, 6, 1), (20, 21, 1), (21, 30, 4)], 1) == [(0, 6, 3), (20, 30, 5)]
    assert sessions.merged([], 1) == []


def test_sessions_over_many_batches(spark):
    """Files arrive out of order within the delay; the open sessions at the end are reported."""
    begin, rng = datetime(2024, 1, 1), np.random.default_rng(1)
    minutes = np.cumsum(rng.choice([1, 2, 45], 60, p=[0.6, 0.3, 0.1]))
    rows = [(str(rng.choice(["a", "b"])), begin + timedelta(minutes=int(m))) for m in minutes]
    path = scratch_path(spark, "times")
    for at in range(0, 60, 12):
        part = [rows[i] for i in rng.permutation(np.arange(at, at + 12))]
        spark.createDataFrame(part, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    reports = jobs.run_updates(spark, sessions.session_rows(stream, ["k"], 30, "1000 minutes", "ts"), "t", sessions.STATE_STORE)
    got = {(r["k"], r["incident_start"], r["incident_end"], r["windows"]) for r in sessions.incidents_of(reports, ["k"]).collect()}
    want = set()
    for k in "ab":
        times = [(int(t.timestamp()) // 60,) * 2 + (1,) for key, t in rows if key == k]
        want |= {(k, datetime.fromtimestamp(a * 60), datetime.fromtimestamp(b * 60), n) for a, b, n in sessions.merged(times, 30)}
    assert got == want and reports.select("batch").distinct().count() > 3
