"""Queries over metric series and log lines: windows, rolling statistics, detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import correlation as cor
from faultline.operators import logs
from faultline.operators import timeseries as tsr
from faultline.operators.incidents import log_incidents
from faultline.operators.skew import Timeline
from faultline.plans.registry import big, query, rnd, rounded
from faultline.functions.rules import log_anomaly_reason, score_level
from faultline.session import materialize
from faultline.sources import datasets as ds
from faultline.sources.datasets import with_views

SERIES = ["service", "metric"]
W = "PARTITION BY service, metric ORDER BY ts, point_id"


def line(spark, d) -> Timeline:
    return Timeline(ds.telemetry(spark, d), SERIES, ["ts", "point_id"])


def frame_sql(n: int, past: bool = False) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" if past else f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("e01_lags", with_views(f"SELECT point_id, lag(value) OVER ({W}) AS value_lag_1, lag(value, 2) OVER ({W}) AS value_lag_2, coalesce(lag(value, 3) OVER ({W}), 0) AS value_lag_3 FROM telemetry", "telemetry"))
def _(spark, d):
    out = line(spark, d).frames(tsr.lags(["value"], 3), before=3).result()
    return out.select("point_id", "value_lag_1", "value_lag_2", F.coalesce("value_lag_3", F.lit(0.0)).alias("value_lag_3"))


@query("e02_lead", with_views(f"SELECT point_id, coalesce(lead(label) OVER ({W}), -1) AS next_label FROM telemetry", "telemetry"))
def _(spark, d):
    return line(spark, d).frames(tsr.lead("label", "next_label"), after=1).result().select("point_id", F.coalesce("next_label", F.lit(-1)).alias("next_label"))


@query("e03_deltas", with_views("SELECT point_id, " + ", ".join(f"round(value - lag(value, {n}) OVER ({W}), 6) + 0.0 AS value_delta_{n}" for n in (1, 2, 5, 15)) + f", round(value - 2 * lag(value) OVER ({W}) + lag(value, 2) OVER ({W}), 6) + 0.0 AS value_delta2 FROM telemetry", "telemetry"))
def _(spark, d):
    out = line(spark, d).frames(tsr.deltas("value", [1, 2, 5, 15]), before=15).result()
    return rounded(out.select("point_id", *[f"value_delta_{n}" for n in (1, 2, 5, 15)], "value_delta2"))


@query(
    "e04_percent_change",
    with_views(
        f"""SELECT point_id, round(CASE WHEN p <> 0 THEN (value - p) / abs(p) * 100 END, 6) + 0.0 AS change_null, CASE WHEN p IS NOT NULL THEN round(greatest(-10.0, least(10.0, (value - p) / (abs(p) + 1e-6))), 6) + 0.0 END AS change_clipped,
 round(CASE WHEN p <> 0 THEN value / p - 1 END, 6) + 0.0 AS change_ratio FROM (SELECT point_id, value, lag(value) OVER ({W}) AS p FROM telemetry)""",
        "telemetry",
    ),
)
def _(spark, d):
    stages = [tsr.pct_change("value", f"change_{m}", m) for m in ("null", "clipped", "ratio")]
    return rounded(line(spark, d).frames(*stages, before=1).result().select("point_id", "change_null", "change_clipped", "change_ratio"))


def rolling_sql(n, past, minimum, named: dict[str, str]) -> str:
    f = frame_sql(n, past)
    return ", ".join(f"CASE WHEN count(value) OVER {f} >= {minimum} THEN round({e} OVER {f}, 6) + 0.0 END AS {a}" for a, e in named.items())


BASIC = {"mean": "avg(value)", "std": "stddev_samp(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)"}


@query("e05_rolling", with_views(f"SELECT point_id, {rolling_sql(15, False, 5, {'now_' + k: v for k, v in BASIC.items()})}, {rolling_sql(12, True, 3, {'past_' + k: v for k, v in BASIC.items()})} FROM telemetry", "telemetry"))
def _(spark, d):
    out = line(spark, d).frames(tsr.rolling("value", 15, list(BASIC), 5, prefix="now"), tsr.rolling("value", 12, list(BASIC), 3, True, "past"), before=15).result()
    return rounded(out.select("point_id", *[f"{p}_{a}" for p in ("now", "past") for a in BASIC]))


@query("e06_e13_rolling_quantiles", with_views(f"SELECT point_id, {rolling_sql(15, False, 5, {'m15_median': 'quantile_cont(value, 0.5)', 'm15_q25': 'quantile_cont(value, 0.25)', 'm15_q75': 'quantile_cont(value, 0.75)'})}, {rolling_sql(5, False, 5, {'m5_median': 'quantile_cont(value, 0.5)'})}, {rolling_sql(30, False, 5, {'m30_median': 'quantile_cont(value, 0.5)'})} FROM telemetry", "telemetry"))
def _(spark, d):
    out = line(spark, d).frames(tsr.rolling("value", 15, ["median", "q25", "q75"], 5, prefix="m15"), tsr.rolling("value", 5, ["median"], 5, prefix="m5"), tsr.rolling("value", 30, ["median"], 5, prefix="m30"), before=30).result()
    return rounded(out.select("point_id", "m15_median", "m15_q25", "m15_q75", "m5_median", "m30_median"))


@query("e07_rolling_mad", with_views(f"SELECT point_id, {rolling_sql(15, False, 5, {'mad': 'mad(value)'})} FROM telemetry", "telemetry"))
def _(spark, d):
    return rounded(line(spark, d).frames(*tsr.rolling_mad("value", 15, 5, "mad"), before=15).result().select("point_id", "mad"))


DETECT_SQL = {
    "r": f"""SELECT *, CASE WHEN count(value) OVER f >= 5 THEN quantile_cont(value, 0.5) OVER f END AS med, CASE WHEN count(value) OVER f >= 5 THEN mad(value) OVER f END AS md,
 list(value) OVER ({W} ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS h FROM telemetry WINDOW f AS {frame_sql(15)}""",
    "e": "SELECT *, list_reduce(h, lambda s, x: s * (1 - 2.0 / 21) + x * (2.0 / 21)) AS ew FROM r",
    "s": f"SELECT *, value - ew AS res, CASE WHEN count(value) OVER f >= 5 THEN stddev_samp(value - ew) OVER f END AS rs FROM e WINDOW f AS {frame_sql(15)}",
    "z": "SELECT s.*, coalesce(nullif(rs, 0), quantile_cont(rs, 0.5) OVER (PARTITION BY service, metric)) AS sd FROM s",
    "det": """SELECT *, abs(coalesce(0.6745 * (value - med) / nullif(md, 0), 0)) AS robust_z_score, coalesce(abs(value - med) / (nullif(md, 0) + 1e-9), 0) AS rolling_mad_score,
 abs(coalesce(res / nullif(sd, 0), 0)) AS ewma_score FROM z""",
    "dp": """SELECT *, CASE WHEN robust_z_score >= 3.5 THEN 1 ELSE 0 END AS robust_z_prediction, CASE WHEN rolling_mad_score >= 3.5 THEN 1 ELSE 0 END AS rolling_mad_prediction,
 CASE WHEN ewma_score >= 3.0 THEN 1 ELSE 0 END AS ewma_prediction FROM det""",
}
DETECTORS = ["robust_z", "rolling_mad", "ewma"]


def detected(spark, d):
    return tsr.detectors(line(spark, d))


@query("e08_e10_e12_detectors", with_views(f"SELECT point_id, {rnd('robust_z_score, rolling_mad_score, ewma_score')}, robust_z_prediction, rolling_mad_prediction, ewma_prediction FROM dp", "telemetry", **DETECT_SQL))
def _(spark, d):
    return rounded(detected(spark, d).select("point_id", *[f"{n}_{k}" for n in DETECTORS for k in ("score", "prediction")]))


@query(
    "e09_past_robust_z",
    with_views(
        f"""SELECT point_id, round((value - med) / (1.4826 * nullif(md, 0)), 6) + 0.0 AS z, CASE WHEN abs((value - med) / (1.4826 * nullif(md, 0))) >= 3 THEN 1 ELSE 0 END AS is_anomaly
 FROM (SELECT point_id, value, CASE WHEN count(value) OVER f >= 3 THEN quantile_cont(value, 0.5) OVER f END AS med, CASE WHEN count(value) OVER f >= 3 THEN mad(value) OVER f END AS md FROM telemetry WINDOW f AS {frame_sql(12, True)})""",
        "telemetry",
    ),
)
def _(spark, d):
    out = line(spark, d).frames(*tsr.past_robust_z("value", "z"), before=12).result()
    flag = F.coalesce(F.abs("z") >= 3, F.lit(False)).cast("int")
    return rounded(out.select("point_id", "z", flag.alias("is_anomaly")))


@query("e14_rolling_z", with_views(f"SELECT point_id, round(coalesce((value - m) / nullif(s, 0), 0), 6) + 0.0 AS rolling_z, round(abs(coalesce((value - m) / nullif(s, 0), 0)), 6) + 0.0 AS abs_rolling_z FROM (SELECT point_id, value, avg(value) OVER f AS m, CASE WHEN count(value) OVER f >= 5 THEN stddev_samp(value) OVER f END AS s FROM telemetry WINDOW f AS {frame_sql(15)})", "telemetry"))
def _(spark, d):
    out = line(spark, d).frames(tsr.rolling("value", 15, ["mean"], 1), tsr.rolling("value", 15, ["std"], 5), before=15).result()
    z = F.coalesce(F.try_divide(F.col("value") - F.col("value_mean"), F.col("value_std")), F.lit(0.0))
    return rounded(out.select("point_id", z.alias("rolling_z"), F.abs(z).alias("abs_rolling_z")))


@query(
    "e15_robust_scale",
    with_views(
        """SELECT point_id, round(greatest(-20.0, least(20.0, coalesce((value - m) / nullif(q3 - q1, 0), 0))), 6) + 0.0 AS scaled, round(greatest(-20.0, least(20.0, coalesce((value - tm) / nullif(t3 - t1, 0), 0))), 6) + 0.0 AS train_scaled FROM telemetry JOIN (
 SELECT service, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.25) FILTER (WHERE ts < TIMESTAMP '2024-01-21') AS t1,
 quantile_cont(value, 0.5) FILTER (WHERE ts < TIMESTAMP '2024-01-21') AS tm, quantile_cont(value, 0.75) FILTER (WHERE ts < TIMESTAMP '2024-01-21') AS t3 FROM telemetry GROUP BY service, metric) USING (service, metric)""",
        "telemetry",
    ),
)
def _(spark, d):
    t = tsr.robust_scale(ds.telemetry(spark, d), SERIES, "value", "scaled")
    train = F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")
    return rounded(tsr.robust_scale(t, SERIES, "value", "train_scaled", train).select("point_id", "scaled", "train_scaled"))


@query("d19_series_robust_z", with_views("SELECT point_id, round(coalesce(0.6745 * (value - m) / nullif(md, 0), 0), 6) + 0.0 AS z FROM telemetry JOIN (SELECT service, metric, quantile_cont(value, 0.5) AS m, mad(value) AS md FROM telemetry GROUP BY service, metric) USING (service, metric)", "telemetry"))
def _(spark, d):
    return rounded(tsr.series_robust_z(ds.telemetry(spark, d), SERIES, "value", "z").select("point_id", "z"))


@query(
    "e16_time_split",
    with_views(
        f"""SELECT point_id, CASE WHEN g <= floor(gn * 0.7 + 1e-9) THEN 'train' WHEN g <= floor(gn * 0.85 + 1e-9) THEN 'validation' ELSE 'test' END AS global_split,
 CASE WHEN rn <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS series_split FROM (SELECT point_id, row_number() OVER (ORDER BY ts, point_id) AS g, count(*) OVER () AS gn, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY service, metric) AS n FROM telemetry)""",
        "telemetry",
    ),
)
def _(spark, d):
    t = ds.telemetry(spark, d)
    t = tsr.time_split(t, [], ["ts", "point_id"], {"train": 0.7, "validation": 0.85, "test": 1.0}, "global_split")
    return tsr.time_split(t, SERIES, ["ts", "point_id"], {"train": 0.8, "test": 1.0}, "series_split").select("point_id", "global_split", "series_split")


@query("e21_fill_gaps", with_views(f"""SELECT point_id, coalesce(last_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS filled
 FROM (SELECT *, CASE WHEN value > 30 THEN value END AS v FROM telemetry)""", "telemetry"))
def _(spark, d):
    sparse = ds.telemetry(spark, d).withColumn("filled", F.when(F.col("value") > 30, F.col("value")))
    return tsr.fill_gaps(Timeline(sparse, SERIES, ["ts", "point_id"]), ["filled"]).result().select("point_id", "filled")


@query("e22_sequences", with_views(f"SELECT point_id, seq[1] AS oldest, seq[6] AS newest, round(list_sum(seq), 6) + 0.0 AS total, label AS target FROM (SELECT point_id, label, list(value) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS seq FROM telemetry) WHERE len(seq) = 6", "telemetry"))
def _(spark, d):
    s = tsr.sequences(line(spark, d), ["value", "label"], 6, "label")
    at = lambda i: F.element_at(F.element_at("sequence", i), 1)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + F.element_at(x, 1))
    return rounded(s.select("point_id", at(1).alias("oldest"), at(6).alias("newest"), total.alias("total"), "target"))


TM_COLS = [f"value_lag_{n}" for n in (1, 2, 3)] + [f"delta_{n}" for n in (1, 2, 3)] + [f"pct_change_{n}" for n in (1, 2, 3)] + ["rolling_mean", "rolling_std"]


@query(
    "e24_temporal_matrix",
    with_views(
        "SELECT point_id, value, "
        + ", ".join(f"value_lag_{n}, round(value - value_lag_{n}, 6) + 0.0 AS delta_{n}, CASE WHEN value_lag_{n} IS NOT NULL THEN round(greatest(-10.0, least(10.0, (value - value_lag_{n}) / (abs(value_lag_{n}) + 1e-6))), 6) + 0.0 END AS pct_change_{n}" for n in (1, 2, 3))
        + f", round(rm, 6) + 0.0 AS rolling_mean, round(rsd, 6) + 0.0 AS rolling_std FROM (SELECT *, lag(value) OVER ({W}) AS value_lag_1, lag(value, 2) OVER ({W}) AS value_lag_2, lag(value, 3) OVER ({W}) AS value_lag_3, avg(value) OVER {frame_sql(3, True)} AS rm, stddev_samp(value) OVER {frame_sql(3, True)} AS rsd FROM telemetry)",
        "telemetry",
    ),
)
def _(spark, d):
    return rounded(tsr.temporal_matrix(ds.telemetry(spark, d), SERIES, "ts", "value").select("point_id", "value", *TM_COLS))


@query(
    "e24_serving_matrix",
    with_views(
        "SELECT point_id, value, "
        + ", ".join(f"value_lag_{n}, round(value - value_lag_{n}, 6) + 0.0 AS delta_{n}, round(value / nullif(value_lag_{n}, 0) - 1, 6) + 0.0 AS pct_change_{n}" for n in (1, 2, 3))
        + f", round(rm, 6) + 0.0 AS rolling_mean, round(rsd, 6) + 0.0 AS rolling_std FROM (SELECT *, lag(value) OVER ({W}) AS value_lag_1, lag(value, 2) OVER ({W}) AS value_lag_2, lag(value, 3) OVER ({W}) AS value_lag_3, avg(value) OVER {frame_sql(3, False)} AS rm, stddev_samp(value) OVER {frame_sql(3, False)} AS rsd FROM telemetry)",
        "telemetry",
    ),
)
def _(spark, d):
    """The form that scores the latest time: the present value counts in the rolling statistics, changes are not clipped."""
    return rounded(tsr.temporal_matrix(ds.telemetry(spark, d), SERIES, "ts", "value", serving=True).select("point_id", "value", *TM_COLS))


VOTES_SQL = """SELECT *, robust_z_prediction + rolling_mad_prediction + ewma_prediction AS metric_anomaly_votes, CASE WHEN robust_z_prediction + rolling_mad_prediction + ewma_prediction >= 1 THEN 1 ELSE 0 END AS metric_anomaly,
 greatest(robust_z_score, rolling_mad_score, ewma_score) AS metric_anomaly_score FROM dp"""
MW_SQL = """SELECT *, CASE WHEN metric_anomaly_points >= 1 THEN 1 ELSE 0 END AS metric_anomaly FROM (SELECT service, time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(value) AS metric_points, sum(metric_anomaly) AS metric_anomaly_points, avg(metric_anomaly) AS metric_anomaly_rate,
 max(metric_anomaly_score) AS metric_max_anomaly_score, avg(metric_anomaly_score) AS metric_mean_anomaly_score, count(DISTINCT metric) AS metric_unique_series, avg(value) AS metric_mean_value, stddev_samp(value) AS metric_std_value FROM votes GROUP BY 1, 2)"""


def voted(spark, d):
    return tsr.votes(detected(spark, d), [n + "_prediction" for n in DETECTORS], [n + "_score" for n in DETECTORS])


@query("e27_metric_votes", with_views(f"SELECT point_id, metric_anomaly_votes, metric_anomaly, {rnd('metric_anomaly_score')} FROM votes", "telemetry", **DETECT_SQL, votes=VOTES_SQL))
def _(spark, d):
    return rounded(voted(spark, d).select("point_id", "metric_anomaly_votes", "metric_anomaly", "metric_anomaly_score"))


@query("d15_metric_windows", with_views(f"SELECT service, window_start, metric_points, {big('metric_anomaly_points')}, {rnd('metric_anomaly_rate, metric_max_anomaly_score, metric_mean_anomaly_score')}, metric_unique_series, {rnd('metric_mean_value, metric_std_value')}, metric_anomaly FROM mw", "telemetry", **DETECT_SQL, votes=VOTES_SQL, mw=MW_SQL))
def _(spark, d):
    return rounded(cor.metric_windows(voted(spark, d), ["service"]))


@query("d17_resample_metric", with_views(f"""SELECT service, metric, slot, n, {rnd('mean, std')}, "min", "max", "first", "last", round(("last" - "first") / abs(nullif("first", 0)) * 100, 6) + 0.0 AS change_pct FROM (SELECT service, metric, time_bucket(INTERVAL '60 minutes', ts) AS slot,
 count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS "min", max(value) AS "max", arg_min(value, ts) AS "first", arg_max(value, ts) AS "last" FROM telemetry GROUP BY 1, 2, 3)""", "telemetry"))
def _(spark, d):
    return rounded(cor.resample_metric(ds.telemetry(spark, d), SERIES, 60))


HOUR_SQL = "SELECT service, metric, time_bucket(INTERVAL '60 minutes', ts) AS slot, avg(value) AS value FROM telemetry GROUP BY 1, 2, 3"


def hourly(spark, d):
    return ds.telemetry(spark, d).groupBy("service", "metric", F.window("ts", "60 minutes")["start"].alias("slot")).agg(F.avg("value").alias("value"))


@query("c04_align_metrics", with_views("SELECT slot, " + ", ".join(f"round(avg(value) FILTER (WHERE metric = '{m}'), 6) + 0.0 AS {m}" for m, _ in ds.METRICS.values()) + " FROM hr GROUP BY slot", "telemetry", hr=HOUR_SQL))
def _(spark, d):
    return rounded(cor.align_metrics(hourly(spark, d), ["slot"], "metric", "value", [m for m, _ in ds.METRICS.values()]))


Z_SQL = "SELECT service, metric, slot, coalesce(0.6745 * (value - m) / nullif(md, 0), 0) AS z FROM hr JOIN (SELECT service, metric, quantile_cont(value, 0.5) AS m, mad(value) AS md FROM hr GROUP BY 1, 2) USING (service, metric)"


@query("d20_anomaly_counts", with_views(f"""SELECT slot, CAST(sum(h) AS BIGINT) AS multisource_anomaly_count, round(avg(h), 6) + 0.0 AS multisource_anomaly_ratio, CAST(sum(CASE WHEN abs(z) > 5 THEN 1 ELSE 0 END) AS BIGINT) AS multisource_high_anomaly_count,
 {", ".join(f"CAST(sum(CASE WHEN {c} THEN h ELSE 0 END) AS BIGINT) AS {n}_anomaly_count, round(coalesce(avg(CASE WHEN {c} THEN h END), 0), 6) + 0.0 AS {n}_anomaly_ratio" for n, c in {'network': "metric LIKE '%network%'", 'disk': "metric LIKE '%diskio%'", 'system': "metric LIKE '%system_%'"}.items())}
 FROM (SELECT *, CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END AS h FROM zs) GROUP BY slot""", "telemetry", hr=HOUR_SQL, zs=Z_SQL))
def _(spark, d):
    z = tsr.series_robust_z(materialize(hourly(spark, d)), SERIES, "value", "z")
    return rounded(cor.anomaly_counts(z, ["slot"]))


@query("d21_global_change", with_views("""SELECT slot, round(quantile_cont(c, 0.5), 6) + 0.0 AS global_abs_change_median, round(avg(c), 6) + 0.0 AS global_abs_change_mean, CAST(coalesce(sum(CASE WHEN c > 0.5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS global_large_change_count
 FROM (SELECT slot, abs((value - p) / (abs(p) + 1e-9)) AS c FROM (SELECT *, lag(value) OVER (PARTITION BY service, metric ORDER BY slot) AS p FROM hr)) GROUP BY slot""", "telemetry", hr=HOUR_SQL))
def _(spark, d):
    return rounded(cor.global_change(materialize(hourly(spark, d)), SERIES, ["slot"], "slot", "value"))


@query("e26_anomaly_pressure", with_views("""SELECT service, slot, round(p15, 6) + 0.0 AS anomaly_pressure_15m, round(p30, 6) + 0.0 AS anomaly_pressure_30m, round(p15 - lag(p15) OVER (PARTITION BY service ORDER BY slot), 6) + 0.0 AS anomaly_pressure_change FROM (
 SELECT service, slot, avg(ratio) OVER (PARTITION BY service ORDER BY slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p15, avg(ratio) OVER (PARTITION BY service ORDER BY slot ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS p30
 FROM (SELECT service, slot, avg(CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END) AS ratio FROM zs GROUP BY 1, 2))""", "telemetry", hr=HOUR_SQL, zs=Z_SQL))
def _(spark, d):
    z = tsr.series_robust_z(materialize(hourly(spark, d)), SERIES, "value", "z")
    p = cor.anomaly_pressure(cor.anomaly_counts(z, ["service", "slot"]), ["service"], "slot")
    return rounded(p.select("service", "slot", "anomaly_pressure_15m", "anomaly_pressure_30m", "anomaly_pressure_change"))


@query("d22_class_comparison", with_views(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n_rows, round(avg({c}) FILTER (WHERE label = 1), 6) + 0.0 AS mean_positive, round(avg({c}) FILTER (WHERE label = 0), 6) + 0.0 AS mean_negative, round(avg({c}) FILTER (WHERE label = 1) - avg({c}) FILTER (WHERE label = 0), 6) + 0.0 AS difference, round(avg(label), 6) + 0.0 AS positive_rate, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) + 0.0 AS missing_rate FROM tp" for c in ("value", "previous")), "telemetry", tp=f"SELECT *, lag(value) OVER ({W}) AS previous FROM telemetry"))
def _(spark, d):
    t = line(spark, d).frames(lambda w: {"previous": F.lag("value").over(w)}, before=1).result()
    return rounded(cor.class_comparison(t, "label", ["value", "previous"]))


# --- logs -------------------------------------------------------------------------------
KEY = ["service"]
BLOCK_SQL = """SELECT *, CAST(sum(CASE WHEN p IS NULL OR ts - p > INTERVAL '240 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY ts, line_id) AS BIGINT) AS block_id
 FROM (SELECT *, lag(ts) OVER (PARTITION BY service ORDER BY ts, line_id) AS p FROM log_lines)"""
LW_SQL = """SELECT *, coalesce(lag(error_rate) OVER o, 0) AS previous_error_rate, coalesce(error_rate - lag(error_rate) OVER o, 0) AS error_rate_delta, CAST(coalesce(lag(total_logs) OVER o, 0) AS DOUBLE) AS previous_total_logs,
 CAST(coalesce(total_logs - lag(total_logs) OVER o, 0) AS DOUBLE) AS volume_delta, avg(error_rate) OVER r AS rolling_error_rate_3, avg(total_logs) OVER r AS rolling_volume_3 FROM (
 SELECT service, block_id, time_bucket(INTERVAL '60 minutes', ts) AS window_start, time_bucket(INTERVAL '60 minutes', ts) + INTERVAL '60 minutes' AS window_end, count(*) AS total_logs, count(*) FILTER (WHERE label = 'error') AS error_count, count(*) FILTER (WHERE label = 'info') AS info_count,
 count(DISTINCT source) AS unique_sources, count(DISTINCT host) AS unique_hosts, count(DISTINCT exception_type) AS unique_exception_types, count(*) FILTER (WHERE label = 'error') / count(*) AS error_rate FROM bl GROUP BY 1, 2, 3, 4)
 WINDOW o AS (PARTITION BY service, block_id ORDER BY window_start), r AS (PARTITION BY service, block_id ORDER BY window_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
SW_SQL = """SELECT *, semantic_anomaly_count / semantic_total_logs AS semantic_anomaly_rate FROM (SELECT service, block_id, time_bucket(INTERVAL '60 minutes', ts) AS window_start, count(*) AS semantic_total_logs, CAST(sum(CASE WHEN margin > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS semantic_anomaly_count,
 avg(margin - 0.5) AS semantic_mean_score, max(margin - 0.5) AS semantic_max_score, avg(abs(margin - 0.5) / mx) AS semantic_mean_confidence, max(abs(margin - 0.5) / mx) AS semantic_max_confidence, count(DISTINCT source) AS semantic_sources, count(DISTINCT host) AS semantic_hosts
 FROM bl CROSS JOIN (SELECT max(abs(margin - 0.5)) AS mx FROM bl) GROUP BY 1, 2, 3)"""
FULL_SQL = "SELECT lw.*, semantic_total_logs, semantic_anomaly_count, semantic_anomaly_rate, semantic_mean_confidence FROM lw LEFT JOIN sw USING (service, block_id, window_start)"
AIOPS_SQL = "SELECT *, 0.5 * error_rate + 0.5 * semantic_anomaly_rate AS aiops_anomaly_score, CASE WHEN 0.5 * error_rate + 0.5 * semantic_anomaly_rate > 0.4 THEN 1 ELSE 0 END AS is_aiops_anomaly FROM fw"
LOGS = {"bl": BLOCK_SQL, "lw": LW_SQL, "sw": SW_SQL, "fw": FULL_SQL, "aw": AIOPS_SQL}


def log_sql(body: str, upto: str, **extra: str) -> str:
    names = list(LOGS)
    return with_views(body, "log_lines", **{n: LOGS[n] for n in names[: names.index(upto) + 1]}, **extra)


def blocks(spark, d):
    return logs.log_blocks(ds.log_lines(spark, d), KEY, 240)


def anomalous_log_windows(spark, d):
    b = materialize(blocks(spark, d))
    scored = logs.semantic_score(b.withColumn("margin", F.col("margin") - 0.5)).withColumn("window_start", F.window("ts", "60 minutes")["start"])
    group = [*KEY, "block_id", "window_start"]
    full = logs.attach_semantic(logs.log_windows(b, KEY, 60), logs.semantic_windows(scored, group), group)
    score = 0.5 * F.col("error_rate") + 0.5 * F.col("semantic_anomaly_rate")
    return full.withColumns({"aiops_anomaly_score": score, "is_aiops_anomaly": (score > 0.4).cast("int")})


@query("d11_block_stats", log_sql(f"""SELECT service, block_id, block_start, block_end, total_logs, error_logs, info_logs, sources, hosts, round(date_diff('microsecond', block_start, block_end) / 60000000.0, 6) AS duration_minutes, round(error_logs / total_logs, 6) AS error_rate FROM (SELECT service, block_id, min(ts) AS block_start, max(ts) AS block_end, count(*) AS total_logs,
 count(*) FILTER (WHERE label = 'error') AS error_logs, count(*) FILTER (WHERE label = 'info') AS info_logs, count(DISTINCT source) AS sources, count(DISTINCT host) AS hosts FROM bl GROUP BY 1, 2 HAVING count(*) >= 50)""", "bl"))
def _(spark, d):
    return rounded(logs.block_stats(blocks(spark, d), KEY))


GAPS = [5, 15, 30, 60, 360]


@query(
    "d12_block_threshold_study",
    with_views(
        "SELECT gap_minutes, count(*) AS blocks, round(avg(n), 6) AS mean_size, round(quantile_cont(n, 0.5), 6) AS median_size, max(n) AS max_size, count(*) FILTER (WHERE n >= 10) AS blocks_ge_10, count(*) FILTER (WHERE n >= 50) AS blocks_ge_50, count(*) FILTER (WHERE n >= 100) AS blocks_ge_100 FROM ("
        + " UNION ALL ".join(f"SELECT CAST({g} AS DOUBLE) AS gap_minutes, service, b, count(*) AS n FROM (SELECT service, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL '{g} minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY ts, line_id) AS b FROM lg) GROUP BY service, b" for g in GAPS)
        + ") GROUP BY gap_minutes",
        "log_lines",
        lg="SELECT *, lag(ts) OVER (PARTITION BY service ORDER BY ts, line_id) AS p FROM log_lines",
    ),
)
def _(spark, d):
    return rounded(logs.block_threshold_study(ds.log_lines(spark, d), KEY, GAPS))


@query("d08_log_windows", log_sql(f"SELECT service, block_id, window_start, window_end, total_logs, error_count, info_count, unique_sources, unique_hosts, unique_exception_types, {rnd('error_rate, previous_error_rate, error_rate_delta, previous_total_logs, volume_delta, rolling_error_rate_3, rolling_volume_3')}, CASE WHEN error_count > 0 THEN 1 ELSE 0 END AS has_error FROM lw", "lw"))
def _(spark, d):
    return rounded(logs.log_windows(blocks(spark, d), KEY, 60).drop("hour", "day_of_week", "is_weekend"))


@query("d10_offset_windows", log_sql("SELECT line_id, CAST(floor((epoch_us(ts) - epoch_us(f)) / 300000000) AS BIGINT) AS window_index, f + to_seconds(CAST(floor((epoch_us(ts) - epoch_us(f)) / 300000000) AS BIGINT) * 300) AS window_start FROM (SELECT *, min(ts) OVER (PARTITION BY service, block_id) AS f FROM bl)", "bl"))
def _(spark, d):
    return logs.assign_offset_window(blocks(spark, d), KEY).select("line_id", "window_index", "window_start")


@query("d09_semantic_windows", log_sql(f"SELECT service, block_id, window_start, semantic_total_logs, semantic_anomaly_count, {rnd('semantic_mean_score, semantic_max_score, semantic_mean_confidence, semantic_max_confidence, semantic_anomaly_rate')}, semantic_sources, semantic_hosts FROM sw", "sw"))
def _(spark, d):
    b = blocks(spark, d).withColumns({"margin": F.col("margin") - 0.5, "window_start": F.window("ts", "60 minutes")["start"]})
    return rounded(logs.semantic_windows(logs.semantic_score(b), ["service", "block_id", "window_start"]))


@query("c02_attach_semantic", log_sql(f"SELECT service, block_id, window_start, total_logs, semantic_total_logs, semantic_anomaly_count, {rnd('semantic_anomaly_rate, semantic_mean_confidence')} FROM fw", "fw"))
def _(spark, d):
    w = anomalous_log_windows(spark, d)
    return rounded(w.select("service", "block_id", "window_start", "total_logs", "semantic_total_logs", "semantic_anomaly_count", "semantic_anomaly_rate", "semantic_mean_confidence"))


@query("c17_logs_in_valid_windows", log_sql("SELECT line_id, service, block_id FROM bl WHERE EXISTS (SELECT 1 FROM aw WHERE aw.is_aiops_anomaly = 1 AND aw.service = bl.service AND aw.block_id = bl.block_id AND aw.window_start = time_bucket(INTERVAL '60 minutes', bl.ts))", "aw"))
def _(spark, d):
    b = blocks(spark, d).withColumn("window_start", F.window("ts", "60 minutes")["start"])
    keys = ["service", "block_id", "window_start"]
    valid = anomalous_log_windows(spark, d).filter("is_aiops_anomaly = 1").select(*keys)
    return b.join(valid, keys, "left_semi").select("line_id", "service", "block_id")


LOG_REASON_SQL = """coalesce(nullif(concat_ws(' | ', CASE WHEN semantic_anomaly_rate >= 0.75 THEN 'HIGH_SEMANTIC_ANOMALY_DENSITY' WHEN semantic_anomaly_rate >= 0.5 THEN 'ELEVATED_SEMANTIC_ANOMALY_DENSITY' END, CASE WHEN error_rate >= 0.75 THEN 'VERY_HIGH_ERROR_RATE' WHEN error_rate >= 0.5 THEN 'HIGH_ERROR_RATE' END,
 CASE WHEN error_rate_delta >= 0.3 THEN 'RAPID_ERROR_RATE_INCREASE' END, CASE WHEN volume_delta >= 0.5 THEN 'RAPID_TRAFFIC_INCREASE' END, CASE WHEN semantic_anomaly_count >= 20 THEN 'HIGH_ANOMALOUS_EVENT_VOLUME' END, CASE WHEN unique_sources >= 4 THEN 'MULTI_SERVICE_ACTIVITY' END), ''), 'MULTIVARIATE_OPERATIONAL_ANOMALY')"""


@query("f03_log_anomaly_reasons", log_sql(f"SELECT service, block_id, window_start, CASE WHEN aiops_anomaly_score >= 0.8 THEN 'CRITICAL' WHEN aiops_anomaly_score >= 0.6 THEN 'HIGH' WHEN aiops_anomaly_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, {LOG_REASON_SQL} AS reason FROM aw", "aw"))
def _(spark, d):
    w = anomalous_log_windows(spark, d)
    return w.select("service", "block_id", "window_start", score_level(F.col("aiops_anomaly_score")).alias("severity"), log_anomaly_reason().alias("reason"))


LI_SQL = {
    "ep": "SELECT *, sum(CASE WHEN p IS NULL OR window_start - p > INTERVAL '60 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY window_start) AS g FROM (SELECT *, lag(window_start) OVER (PARTITION BY service ORDER BY window_start) AS p FROM aw WHERE is_aiops_anomaly = 1)",
    "gi": """SELECT service, min(window_start) AS incident_start, max(window_end) AS incident_end, count(*) AS anomalous_windows, max(aiops_anomaly_score) AS ms, avg(aiops_anomaly_score) AS as_, max(error_rate) AS me, avg(error_rate) AS ae, max(semantic_anomaly_rate) AS mr, avg(semantic_anomaly_rate) AS ar,
 max(total_logs) AS max_total_logs, sum(semantic_anomaly_count) AS total_semantic_anomalous_logs, max(unique_sources) AS max_unique_sources, max(unique_hosts) AS max_unique_hosts, max(error_rate_delta) AS ed, max(volume_delta) AS vd,
 arg_max({'s': semantic_anomaly_rate, 'e': error_rate, 'd': error_rate_delta, 'v': volume_delta, 'u': unique_sources, 'a': aiops_anomaly_score}, {'a': aiops_anomaly_score, 't': -epoch_us(window_start)}) AS pk FROM ep GROUP BY service, g""",
}


@query(
    "d14_f06_log_incidents",
    log_sql(
        f"""SELECT 'INC-' || lpad(CAST(row_number() OVER (ORDER BY incident_start, service) AS VARCHAR), 4, '0') AS incident_id, service, incident_start, incident_end, round(date_diff('microsecond', incident_start, incident_end) / 60000000.0, 2) AS duration_minutes, anomalous_windows,
 round(ms, 4) AS max_aiops_anomaly_score, round(as_, 4) AS mean_aiops_anomaly_score, round(me, 4) AS max_error_rate, round(ae, 4) AS mean_error_rate, round(mr, 4) AS max_semantic_anomaly_rate, round(ar, 4) AS mean_semantic_anomaly_rate, max_total_logs, {big('total_semantic_anomalous_logs')}, max_unique_sources, max_unique_hosts,
 CASE WHEN greatest(ms, me, mr) >= 0.9 THEN 'CRITICAL' WHEN greatest(ms, me, mr) >= 0.75 OR vd >= 1 THEN 'HIGH' WHEN greatest(ms, me, mr) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS incident_severity,
 CASE WHEN pk.s >= 0.5 AND pk.e >= 0.5 THEN 'SEMANTIC_AND_ERROR_ANOMALY' WHEN pk.e >= 0.5 THEN 'ERROR_RATE_ANOMALY' WHEN pk.v >= 0.5 THEN 'TRAFFIC_ANOMALY' WHEN pk.s >= 0.5 THEN 'SEMANTIC_ANOMALY' WHEN pk.d >= 0.2 THEN 'RAPID_ERROR_INCREASE' WHEN pk.u >= 3 THEN 'MULTI_SERVICE_ANOMALY' WHEN pk.a >= 0.8 THEN 'HIGH_MULTIVARIATE_ANOMALY' ELSE 'MULTIVARIATE_OPERATIONAL_ANOMALY' END AS incident_type,
 coalesce(nullif(concat_ws(' | ', CASE WHEN mr >= 0.5 THEN 'HIGH_SEMANTIC_ANOMALY_DENSITY' END, CASE WHEN me >= 0.5 THEN 'HIGH_ERROR_RATE' END, CASE WHEN me >= 0.8 THEN 'VERY_HIGH_ERROR_RATE' END, CASE WHEN ed >= 0.2 THEN 'RAPID_ERROR_RATE_INCREASE' END, CASE WHEN vd >= 0.5 THEN 'TRAFFIC_INCREASE' END, CASE WHEN max_unique_sources >= 3 THEN 'MULTI_SERVICE_ACTIVITY' END, CASE WHEN ms >= 0.8 THEN 'HIGH_MULTIVARIATE_ANOMALY' END), ''), 'MULTIVARIATE_OPERATIONAL_ANOMALY') AS incident_reason FROM gi""",
        "aw",
        **LI_SQL,
    ),
)
def _(spark, d):
    return log_incidents(materialize(anomalous_log_windows(spark, d)), KEY, 60)


# --- correlation ------------------------------------------------------------------------
AWX = "SELECT service, window_start, max(aiops_anomaly_score) AS log_anomaly_score, max(is_aiops_anomaly) AS log_anomaly, max(error_rate) AS error_rate, max(semantic_anomaly_rate) AS semantic_anomaly_rate FROM aw GROUP BY 1, 2"
MW60_SQL = MW_SQL.replace("5 minutes", "60 minutes")
CORR_COLS = [*cor.METRIC_COLUMNS]
COR_SQL = f"""SELECT *, 50 * greatest(0, least(1, log_anomaly_score)) + 30 * greatest(0, least(1, metric_anomaly)) + 20 * greatest(0, least(1, metric_max_anomaly_score)) AS multi_source_score, CASE WHEN log_anomaly = 1 AND metric_anomaly = 1 THEN 1 ELSE 0 END AS multi_source_signal,
 CASE WHEN log_anomaly = 1 AND metric_anomaly <> 1 THEN 1 ELSE 0 END AS log_only_signal, CASE WHEN log_anomaly <> 1 AND metric_anomaly = 1 THEN 1 ELSE 0 END AS metric_only_signal, CASE WHEN log_anomaly = 1 OR metric_anomaly = 1 THEN 1 ELSE 0 END AS incident_signal
 FROM (SELECT awx.*, {", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in CORR_COLS)} FROM awx LEFT JOIN mw60 USING (service, window_start))"""


def correlated(spark, d):
    w = anomalous_log_windows(spark, d).groupBy("service", "window_start").agg(
        F.max("aiops_anomaly_score").alias("log_anomaly_score"), F.max("is_aiops_anomaly").alias("log_anomaly"), F.max("error_rate").alias("error_rate"), F.max("semantic_anomaly_rate").alias("semantic_anomaly_rate")
    )
    return cor.correlate(w, cor.metric_windows(voted(spark, d), KEY, 60), ["service", "window_start"])


def corr_sql(body: str, **extra: str) -> str:
    return with_views(body, "log_lines", "telemetry", **LOGS, **DETECT_SQL, votes=VOTES_SQL, mw60=MW60_SQL, awx=AWX, co=COR_SQL, **extra)


SINGLE = "CASE WHEN {c} >= 0.8 THEN 'HIGH' WHEN {c} >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END"
RISKL = "CASE WHEN {c} >= 80 THEN 'CRITICAL' WHEN {c} >= 60 THEN 'HIGH' WHEN {c} >= 40 THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    "c01_f07_correlate",
    corr_sql(
        f"""SELECT service, window_start, {rnd('multi_source_score')}, multi_source_signal, log_only_signal, metric_only_signal, incident_signal, CASE WHEN log_anomaly = 1 AND metric_anomaly = 1 THEN 'MULTI_SOURCE' WHEN log_anomaly = 1 THEN 'LOG_ONLY' WHEN metric_anomaly = 1 THEN 'METRIC_ONLY' ELSE 'NORMAL' END AS signal_type,
 CASE WHEN log_anomaly = 1 AND metric_anomaly = 1 THEN {RISKL.format(c='multi_source_score')} WHEN log_anomaly = 1 THEN {SINGLE.format(c='log_anomaly_score')} WHEN metric_anomaly = 1 THEN {SINGLE.format(c='metric_max_anomaly_score')} ELSE 'NORMAL' END AS correlation_severity,
 coalesce(nullif(concat_ws(' + ', CASE WHEN log_anomaly = 1 THEN 'log_anomaly' END, CASE WHEN metric_anomaly = 1 THEN 'metric_anomaly' END, CASE WHEN metric_anomaly_rate >= 0.2 THEN 'high_metric_anomaly_density' END, CASE WHEN metric_unique_series >= 2 THEN 'multi_metric_series' END, CASE WHEN error_rate >= 0.5 THEN 'high_log_error_rate' END, CASE WHEN semantic_anomaly_rate >= 0.5 THEN 'high_log_semantic_anomaly_rate' END), ''), 'normal') AS correlation_reason FROM co"""
    ),
)
def _(spark, d):
    c = correlated(spark, d)
    return rounded(c.select("service", "window_start", "multi_source_score", "multi_source_signal", "log_only_signal", "metric_only_signal", "incident_signal", "signal_type", "correlation_severity", "correlation_reason"))


MS_SQL = {
    "me": "SELECT *, sum(CASE WHEN p IS NULL OR window_start - p > INTERVAL '60 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY window_start) AS g FROM (SELECT *, lag(window_start) OVER (PARTITION BY service ORDER BY window_start) AS p FROM co WHERE incident_signal = 1)",
    "mi": """SELECT service, min(window_start) AS incident_start, max(window_start) AS incident_end, count(*) AS incident_windows, max(log_anomaly_score) AS max_log_anomaly_score, max(metric_max_anomaly_score) AS max_metric_anomaly_score, max(metric_anomaly_rate) AS max_metric_anomaly_rate, avg(error_rate) AS mean_log_error_rate, max(error_rate) AS max_log_error_rate,
 max(semantic_anomaly_rate) AS max_semantic_anomaly_rate, max(metric_unique_series) AS max_metric_series, sum(metric_anomaly_points) AS total_metric_anomaly_points, sum(multi_source_signal) AS multi_source_windows, sum(log_only_signal) AS log_only_windows, sum(metric_only_signal) AS metric_only_windows, max(multi_source_score) AS max_multi_source_score, avg(multi_source_score) AS mean_multi_source_score FROM me GROUP BY service, g""",
}


@query(
    "d16_f08_multisource_incidents",
    corr_sql(
        f"""SELECT 'INC-MS-' || lpad(CAST(row_number() OVER (ORDER BY incident_start, service) AS VARCHAR), 4, '0') AS incident_id, service, incident_start, incident_end, incident_windows, {rnd('max_log_anomaly_score, max_metric_anomaly_score, max_metric_anomaly_rate, mean_log_error_rate, max_log_error_rate, max_semantic_anomaly_rate, max_metric_series, total_metric_anomaly_points')},
 {big('multi_source_windows, log_only_windows, metric_only_windows')}, {rnd('max_multi_source_score, mean_multi_source_score')}, round(date_diff('microsecond', incident_start, incident_end) / 60000000.0 + 60, 6) AS duration_minutes,
 CASE WHEN multi_source_windows > 0 AND max_metric_series >= 2 AND max_log_error_rate >= 0.5 THEN 'MULTI_SOURCE_MULTI_SERVICE' WHEN multi_source_windows > 0 THEN 'LOG_METRIC_CORRELATED' WHEN log_only_windows > 0 THEN 'LOG_ONLY' ELSE 'METRIC_ONLY' END AS incident_type, {RISKL.format(c='max_multi_source_score')} AS incident_severity,
 coalesce(nullif(concat_ws(' + ', CASE WHEN multi_source_windows > 0 THEN 'logs_and_metrics_correlated' END, CASE WHEN max_log_error_rate >= 0.5 THEN 'high_log_error_rate' END, CASE WHEN max_semantic_anomaly_rate >= 0.5 THEN 'high_semantic_anomaly_rate' END, CASE WHEN max_metric_anomaly_rate >= 0.2 THEN 'high_metric_anomaly_density' END, CASE WHEN max_metric_series >= 2 THEN 'multiple_metric_series' END), ''), 'single_source_anomaly') AS incident_reason FROM mi""",
        **MS_SQL,
    ),
)
def _(spark, d):
    return rounded(cor.multisource_incidents(materialize(correlated(spark, d)), KEY, 60, 60))
