"""Interval aggregates and segments against plain loops, also with hot keys, nested intervals and long ranges."""

from __future__ import annotations

from datetime import datetime, timedelta
from statistics import median, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions.timefn import micros
from faultline.operators import interval_aggregates as ia
from faultline.operators import temporal_joins as tj
from faultline.operators.evaluation import prefault_summary
from faultline.operators.skew import Timeline
from faultline.session import MAX_GROUP_ROWS

BEGIN = datetime(2024, 1, 1)
at = lambda minute: BEGIN + timedelta(minutes=float(minute))


@pytest.fixture(params=["plain", "hot"])
def session(spark, request):
    if request.param == "hot":
        spark.conf.set(MAX_GROUP_ROWS, "40")
    yield spark
    spark.conf.unset(MAX_GROUP_ROWS)


def make(seed, n_points, n_intervals, longest):
    rng = np.random.default_rng(seed)
    points = [(i, str(rng.choice(["a", "b"], p=[0.8, 0.2])), str(rng.choice(["x", "y"])), at(rng.integers(0, 600)), None if rng.random() < 0.1 else float(rng.integers(-9, 9)), float(rng.normal(0, 3))) for i in range(n_points)]
    intervals = [(i, str(rng.choice(["a", "b", "c"])), str(rng.choice(["p", "q"])), at(s := rng.integers(-20, 600)), at(s + rng.integers(0, longest))) for i in range(n_intervals)]
    return points, intervals


POINTS, INTERVALS = "point_id long, service string, metric string, ts timestamp_ntz, value double, z double", "fault_id long, service string, phase string, start timestamp_ntz, end timestamp_ntz"


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


@pytest.mark.parametrize("short", [4, 256])
def test_statistics_against_a_loop(session, short):
    points, intervals = make(1, 400, 60, 300)
    p, i = session.createDataFrame(points, POINTS), session.createDataFrame(intervals, INTERVALS)
    got = ia.interval_statistics(p, i, ["service"], ["service", "metric"], "ts", "point_id", ["fault_id", "service", "phase"], "start", "end", spread=True, short=short).collect()
    want = {}
    for fault, service, phase, start, end in intervals:
        for metric in "xy":
            inside = [r for r in points if r[1] == service and r[2] == metric and start <= r[3] <= end]
            if inside:
                want[fault, metric] = phase, inside
    assert {(r["fault_id"], r["metric"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        phase, inside = want[r["fault_id"], r["metric"]]
        values = [x[4] for x in inside if x[4] is not None]
        m = median(values) if values else None
        assert r["phase"] == phase and r["n"] == len(values) and r["last"] == max(inside, key=lambda x: (x[3], x[0]))[4]
        assert r["anomaly_count"] == sum(abs(x[5]) > 3 for x in inside) and close(r["anomaly_rate"], r["anomaly_count"] / len(inside)) and close(r["max_abs_z"], max(abs(x[5]) for x in inside))
        assert close(r["mean"], sum(values) / len(values) if values else None) and close(r["std"], stdev(values) if len(values) > 1 else None)
        assert (r["min"], r["max"]) == ((min(values), max(values)) if values else (None, None))
        assert close(r["median"], m) and close(r["mad"], median(abs(v - m) for v in values) if values else None)


def test_range_counts(session):
    points, intervals = make(2, 300, 80, 120)
    got = ia.rank_range(session.createDataFrame(points, POINTS), session.createDataFrame(intervals, INTERVALS), ["service"], "ts", "point_id", "start", "end").collect()
    assert len(got) == len(intervals)
    for r in got:
        assert r["points"] == sum(p[1] == r["service"] and r["start"] <= p[3] <= r["end"] for p in points)


@pytest.mark.parametrize("seed, n, longest", [(3, 120, 30), (4, 200, 500), (5, 1, 5)])
def test_latest_interval_counts(session, seed, n, longest):
    points, intervals = make(seed, 400, n, longest)
    intervals += [(1000 + k, "a", "p", at(k), at(600 - k)) for k in range(100)] + [(2000, "a", "p", at(50), at(50)), (2001, "a", "p", at(9), at(2)), (2002, "a", "p", None, at(2))]
    p, i = session.createDataFrame(points, POINTS), session.createDataFrame(intervals, INTERVALS)
    assert Timeline(i.dropna().withColumn("s", micros(F.col("start"))), ["service"], ["s", "fault_id"]).sliced == (session.conf.get(MAX_GROUP_ROWS, "") == "40")
    got = {r["point_id"]: r["current_fault_id"] for r in tj.mark_in_interval(p, i, ["service"], "ts", "start", "end", "fault_id").collect()}
    assert len(got) == len(points)
    for ident, service, _, ts, *_ in points:
        around = [(x[3], x[0]) for x in intervals if x[1] == service and x[3] and x[3] <= ts <= x[4]]
        assert got[ident] == (max(around)[1] if around else None)


def test_segments_are_disjoint_and_few(session):
    nested = [(k, "a", "p", at(k), at(5000 - k)) for k in range(1000)]
    segments = ia.winners(session.createDataFrame(nested, INTERVALS), ["service"], "start", "end", "fault_id").orderBy("from").collect()
    assert len(segments) <= 2 * len(nested)
    assert all(a["to"] < b["from"] for a, b in zip(segments, segments[1:]))


def test_multiplicity_and_weights_are_repeated_rows(session):
    points, intervals = make(6, 300, 60, 200)
    p, i = session.createDataFrame(points, POINTS), session.createDataFrame(intervals, INTERVALS)
    counted = ia.multiplicity(p, i, ["service"], "ts", "phase", ["p", "q"], "start", "end").collect()
    for r in counted:
        for kind in "pq":
            assert r[kind] == sum(x[1] == r["service"] and x[2] == kind and x[3] <= r["ts"] <= x[4] for x in intervals)
    rows = [("g", r["value"], abs(r["z"]) > 3, r["point_id"] % 2, r["p"]) for r in counted if r["p"]]
    shape = "band string, value double, an boolean, y int, times long"
    weighted = prefault_summary(session.createDataFrame(rows, shape), ["band"], "y", "value", "an", "times").first().asDict()
    repeated = prefault_summary(session.createDataFrame([r for r in rows for _ in range(r[4])], shape), ["band"], "y", "value", "an").first().asDict()
    assert weighted.keys() == repeated.keys() and all(close(weighted[k], repeated[k]) if k != "band" else True for k in weighted)
