"""Hand-built cases for the rules that are easy to get wrong."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.functions.text import clean_text
from faultline.functions.timefn import calendar, circular_minutes
from faultline.operators import evaluation as evl
from faultline.operators import incidents as inc
from faultline.operators import risk
from faultline.operators import temporal_joins as tj
from faultline.operators import timeseries as tsr
from faultline.operators import tickets as tk
from faultline.operators.quality import duplicate_conflicts
from faultline.operators.quantiles import quantiles_by
from faultline.operators.skew import Timeline, range_numbered
from faultline.plans.catalog_models import parts

T0 = datetime(2024, 1, 1)


def at(minutes=0.0):
    return T0 + timedelta(minutes=minutes)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, at(i), v) for i, v in enumerate(values)], "k string, id long, ts timestamp_ntz, v double")


@pytest.mark.parametrize("gap,expected", [(5.0, 1), (5 + 1 / 60, 2)])
def test_gap_at_limit_stays_in_session(spark, gap, expected):
    df = spark.createDataFrame([("a", at(0)), ("a", at(gap))], "k string, ts timestamp_ntz")
    assert inc.sessionize(df, ["k"], "ts", 5).agg(F.max("session_id")).first()[0] == expected


def test_horizon_excludes_now_and_includes_limit(spark):
    points = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(0))], "id long, k string, ts timestamp_ntz")
    events = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(15))], "e long, k string, start timestamp_ntz")
    got = {r["id"]: r["incident_next_15m"] for r in tj.horizon_labels(points, events, ["k"], "ts", "start", "e", [15]).collect()}
    assert got == {1: 0, 2: 1}


def test_overlapping_faults(spark):
    points = spark.createDataFrame([(1, "a", at(30))], "id long, k string, ts timestamp_ntz")
    faults = spark.createDataFrame([(1, "a", at(0), at(60)), (2, "a", at(10), at(20))], "f long, k string, s timestamp_ntz, e timestamp_ntz")
    active = lambda mode: tj.active_event(points, faults, ["k"], "ts", "s", "e", "f", mode=mode).first()["active"]
    assert (active("containment"), active("latest_start")) == (1, 0)


@pytest.mark.parametrize("mode,expected", [("zero", 0.0), ("null", None), ("eps", 0.0)])
def test_zero_mad(spark, mode, expected):
    out = tsr.series_robust_z(series(spark, [3.0] * 6), ["k"], "v", "z", mode)
    assert {r["z"] for r in out.collect()} == {expected}


def test_min_periods_counts_known_values(spark):
    line = Timeline(series(spark, [1.0, None, 2.0, 3.0, 4.0]), ["k"], ["ts"])
    out = line.frames(tsr.rolling("v", 15, ["mean"], 5), before=14).result()
    assert all(r["v_mean"] is None for r in out.collect())


def test_one_row_window(spark):
    out = quantiles_by(series(spark, [7.0]), ["k"], {"p95": ("v", 0.95)}, [F.stddev_samp("v").alias("s")]).first()
    assert (out["p95"], out["s"]) == (7.0, None)


def test_constant_column_scales_to_zero(spark):
    df = series(spark, [0.0, 0.0])
    from faultline.operators.risk import percentile_score

    assert {r[0] for r in df.select(percentile_score(df, ["v"])["v"]).collect()} == {0.0}


def test_monday_is_zero(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 7),)], "ts timestamp_ntz")
    c = calendar(F.col("ts"))
    assert [tuple(r) for r in df.select(c["day_of_week"], c["is_weekend"]).collect()] == [(0, 0), (6, 1)]


@pytest.mark.parametrize("cases,expected", [([1.0] * 10, (0.5, 0.5)), ([2.0] * 10, (1.0, 1.0)), ([0.0] * 10, (0.0, 1.0))])
def test_auc(spark, cases, expected):
    rows = [(1, v) for v in cases] + [(0, 1.0)] * 10
    if len({v for _, v in rows}) == 1:
        rows += [(1, 5.0), (0, 5.0)]
    out = evl.auc(spark.createDataFrame(rows, "y int, s double"), [], "y", "s").first()
    assert (out["auc"], out["discriminative_auc"]) == pytest.approx(expected)


def test_controls_fall_back_to_all_hours(spark):
    case = spark.createDataFrame([(1, "a", at(0))], "c long, k string, t timestamp_ntz")
    pool = spark.createDataFrame([(i, "a", at(10 * (i + 1))) for i in range(3)] + [(i, "a", at(60 * i)) for i in range(3, 12)], "p long, k string, ts timestamp_ntz")
    out = tj.matched_controls(case, pool, ["k"], ["c"], "t", "ts", "p").collect()
    assert sorted(r["control_id"] for r in out) == [0, 1, 2, 3, 4] and not any(r["same_hour"] for r in out)


def test_circular_minutes(spark):
    assert spark.range(1).select(circular_minutes(F.lit(23 * 60 + 50), F.lit(10))).first()[0] == 20


def test_class_without_prediction_counts_in_macro(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    assert evl.classification_report(df, "y", "p").first()["macro_recall"] == 0.5


def test_url_and_mail_only_text_is_dropped(spark):
    df = spark.createDataFrame([("http://a b@c", None, "x", "t", "q", "p", "en")], "subject string, body string, answer string, type string, queue string, priority string, language string")
    assert df.select(clean_text(F.col("subject"))).first()[0] == "" and tk.preprocess_tickets(df).isEmpty()


def test_duplicate_text_with_two_labels(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], "t string, l string")
    out = duplicate_conflicts(df, F.col("t"), "l").collect()
    assert [(r["text"], r["labels"], r["conflicting"]) for r in out] == [("x", "a, b", True)]


def test_first_period_wins(spark):
    from faultline.sources.tables import stitch_periods

    rows = [("m_2024-01-01_2024-01-31", at(0), 1.0), ("m_2024-02-01_2024-02-29", at(0), 2.0), ("m_2024-02-01_2024-02-29", at(1), 3.0)]
    out = stitch_periods(spark.createDataFrame(rows, "f string, ts timestamp_ntz, v double"), "f", "ts", "v")
    assert sorted(r["v"] for r in out.collect()) == [1.0, 3.0]


def test_horizons_are_monotone(spark):
    grid = spark.createDataFrame([("a", at(i)) for i in range(60)], "k string, ts timestamp_ntz")
    events = spark.createDataFrame([(1, "a", at(40)), (2, "a", at(55))], "e long, k string, s timestamp_ntz")
    out = tj.horizon_labels(grid, events, ["k"], "ts", "s", "e", [5, 10, 15, 30])
    assert out.filter("incident_next_5m > incident_next_10m or incident_next_10m > incident_next_15m or incident_next_15m > incident_next_30m").isEmpty()


def test_required_columns_and_empty_joins_fail(spark):
    from faultline.operators.logs import require_common_keys
    from faultline.operators.quality import require_columns

    df = series(spark, [1.0])
    with pytest.raises(ValueError):
        require_columns(df, ["nope"])
    with pytest.raises(ValueError):
        require_common_keys(df, series(spark, [1.0], "b"), ["k"])


def test_one_timestamp_is_cut_into_slices(tight):
    """3,000 rows of one key with one timestamp: many slices, and the rows of the plain window."""
    from pyspark.sql import Window

    df = tight.range(3000).select(F.lit("a").alias("k"), F.lit(1.0).alias("t"), F.col("id"), (F.col("id") % 7).alias("v"))
    tight.conf.set("spark.faultline.maxGroupRows", "300")
    line = Timeline(df, ["k"], ["t", "id"])
    sizes = [r["count"] for r in line.df.groupBy("_slice").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 900
    got = line.running({"s": ("sum", F.col("v"))}).result().select("id", "s")
    want = df.select("id", F.sum("v").over(Window.partitionBy("k").orderBy("id")).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_as_of_joins_keep_text_ids(spark):
    points = spark.createDataFrame([("a", "2024-01-01 00:00"), ("a", "2024-01-01 00:10")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events = spark.createDataFrame([("a", "2024-01-01 00:05", "INC-0002"), ("a", "2024-01-01 00:05", "INC-0001")], "k string, start string, name string").withColumn("start", F.col("start").cast("timestamp"))
    ahead = {r["ts"].minute: r["next_name"] for r in tj.next_event(points, events, ["k"], "ts", "start", "name").collect()}
    near = {r["ts"].minute: r["nearest_name"] for r in tj.nearest_event(points, events, ["k"], "ts", "start", "name", 5).collect()}
    assert ahead == {0: "INC-0001", 10: None} and near == {0: "INC-0001", 10: "INC-0002"}


def test_numbers_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("a"), F.concat(F.lit("t"), "id").alias("b"))
    rows = range_numbered(df, ["a", "b"], "n").collect()
    assert [(r["a"], r["b"]) for r in sorted(rows, key=lambda r: r["n"])] == sorted((i % 3, f"t{i}") for i in range(5000))
    assert sorted(r["n"] for r in rows) == list(range(5000))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from faultline import session

    def of(master, folder):
        kept = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: kept[-1] if kept else None, setCheckpointDir=kept.append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))

    assert session._shared_folder(of("spark://host:7077", "s3a://shared/x")) == "s3a://shared/x"
    assert session._shared_folder(of("local[8]", None))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session._shared_folder(of(master, None))


def test_coverage_without_incidents_is_undefined(spark):
    evaluation = spark.createDataFrame([], "preceded_by_warning boolean, lead_time_minutes double")
    windows = spark.createDataFrame([(False, False)], "early_warning boolean, false_positive_warning boolean")
    row = risk.evaluate_warnings(evaluation, windows, "v").toPandas().iloc[0]
    shares = [row[c] for c in ("incident_coverage", "coverage_5m_pct", "coverage_10m_pct", "coverage_15m_pct")]
    assert row["incidents"] == 0 and all(s != s for s in shares) and row["warning_precision"] == 0.0


@pytest.mark.parametrize("labels,fits", [([1, 1], True), ([0, 0], True), ([1, 0], True), ([0, 1], False), ([1, 0, 0], False)])
def test_parts_of_one_class_have_nothing_to_tell_apart(spark, labels, fits):
    scored = spark.createDataFrame([("train", y, r) for y, r in zip(labels, (0.9, 0.1, 1.0))], "split string, y int, risk double")
    assert [tuple(r) for r in parts(scored, "y").collect()] == [("train", len(labels), sum(labels), fits)]


def test_equal_risks_of_two_classes_do_not_fit(spark):
    scored = spark.createDataFrame([("train", y, 0.5) for y in (0, 1)], "split string, y int, risk double")
    assert not parts(scored, "y").first()["fits"]
