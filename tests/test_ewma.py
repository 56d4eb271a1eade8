"""The blocked exponential mean equals the recursion on long series, hot or not."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from faultline.operators import timeseries as tsr
from faultline.operators.skew import Timeline

T0 = datetime(2024, 1, 1)


def check(spark, n, known=1.0):
    rng = np.random.default_rng(5)
    values = rng.normal(50, 20, n)
    values[rng.random(n) >= known] = np.nan
    rows = [("a", i, T0 + timedelta(minutes=i), None if np.isnan(v) else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp_ntz, v double")
    out = tsr.ewma(Timeline(df, ["k"], ["ts", "id"]), "v", "e").result()
    got = out.select("id", "e").toPandas().sort_values("id")["e"].to_numpy()
    want = pd.Series(values).ewm(span=20, adjust=False, ignore_na=True).mean().to_numpy()
    assert got == pytest.approx(want, rel=1e-11, nan_ok=True)


@pytest.mark.parametrize("known", [1.0, 0.03])
def test_plain(spark, known):
    check(spark, 1500, known)


@pytest.mark.parametrize("known", [1.0, 0.03])
def test_hot_key(tight, known):
    tight.conf.set("spark.faultline.maxGroupRows", "300")
    check(tight, 3000, known)
