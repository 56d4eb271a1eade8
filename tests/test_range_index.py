"""Ranges of an array against numpy, and interval statistics without a row for a point and an interval."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from faultline.operators import interval_aggregates as ia
from faultline.operators.range_index import RangeIndex


@pytest.mark.parametrize("kind", ["spread", "ties", "equal"])
def test_ranges_against_numpy(kind):
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 100, 257):
        values = {"spread": rng.normal(0, 50, n), "ties": rng.integers(-3, 3, n).astype(float), "equal": np.full(n, 0.1)}[kind]
        index, first = RangeIndex(values), rng.integers(0, n, 100)
        after = np.array([rng.integers(f + 1, n + 1) for f in first])
        count, mean, apart, least, most = index.moments(first, after)
        middle = index.median(first, after)
        mad = index.mad(first, after, middle)
        for j, (a, b) in enumerate(zip(first, after)):
            v = values[a:b]
            assert count[j] == len(v) and least[j] == v.min() and most[j] == v.max() == RangeIndex.greatest(values, first, after)[j]
            assert np.allclose([mean[j], apart[j], middle[j], mad[j]], [v.mean(), v.var() * len(v), np.median(v), np.median(abs(v - np.median(v)))], atol=1e-9)
        assert kind != "equal" or not apart.any()


def test_no_row_for_a_point_and_an_interval(spark):
    begin = datetime(2024, 1, 1)
    points = spark.createDataFrame([(i, "a", "x", begin + timedelta(seconds=i), float(i % 7) if i % 5 else float("nan"), 0.0) for i in range(300)], "point_id long, service string, metric string, ts timestamp_ntz, value double, z double")
    intervals = spark.createDataFrame([(i, "a", begin, begin + timedelta(seconds=200 + i)) for i in range(50)], "fault_id long, service string, start timestamp_ntz, end timestamp_ntz")
    out = ia.interval_statistics(points, intervals, ["service"], ["service", "metric"], "ts", "point_id", ["fault_id", "service"], "start", "end", spread=True)
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()  # ranges were read row by row before
    rows = {r["fault_id"]: r for r in out.collect()}
    assert len(rows) == 50 and all(rows[i]["n"] == 201 + i and rows[i]["min"] == 0 and np.isnan(rows[i]["max"]) for i in rows)
