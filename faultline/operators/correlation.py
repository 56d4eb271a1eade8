"""Metric windows, resampling, log/metric correlation and multi-source incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.rules import RISK_CUTS, clip, level, reasons
from faultline.functions.timefn import floor_to, minutes_between
from faultline.operators.incidents import global_number, sessionize
from faultline.operators.quantiles import quantiles_by
from faultline.operators.interval_aggregates import interval_statistics
from faultline.operators.skew import Timeline, join_on


def metric_windows(points: DataFrame, keys: list[str], minutes: int = 5) -> DataFrame:
    """Roll-up of scored metric points per window over all series of the key."""
    return (
        points.withColumn("window_start", floor_to(F.col("ts"), f"{minutes} minutes"))
        .groupBy(*keys, "window_start")
        .agg(
            F.count("value").alias("metric_points"),
            F.sum("metric_anomaly").alias("metric_anomaly_points"),
            F.avg("metric_anomaly").alias("metric_anomaly_rate"),
            F.max("metric_anomaly_score").alias("metric_max_anomaly_score"),
            F.avg("metric_anomaly_score").alias("metric_mean_anomaly_score"),
            F.count_distinct("metric").alias("metric_unique_series"),
            F.avg("value").alias("metric_mean_value"),
            F.stddev_samp("value").alias("metric_std_value"),
        )
        .withColumn("metric_anomaly", (F.col("metric_anomaly_points") >= 1).cast("int"))
    )


def resample_metric(points: DataFrame, keys: list[str], minutes: int = 5) -> DataFrame:
    """Count, mean, std, min, max, first, last and in-window change of every series. First
    and last are picked by time, so they do not depend on row order."""
    at = F.struct("ts", "point_id")
    return (
        points.withColumn("slot", floor_to(F.col("ts"), f"{minutes} minutes"))
        .groupBy(*keys, "slot")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.min_by("value", at).alias("first"),
            F.max_by("value", at).alias("last"),
        )
        .withColumn("change_pct", F.try_divide(F.col("last") - F.col("first"), F.abs("first")) * 100)
    )


METRIC_COLUMNS = [
    "metric_points",
    "metric_anomaly_points",
    "metric_anomaly_rate",
    "metric_max_anomaly_score",
    "metric_mean_anomaly_score",
    "metric_unique_series",
    "metric_mean_value",
    "metric_std_value",
    "metric_anomaly",
]


def correlate(logs: DataFrame, metrics: DataFrame, on: list[str], full_outer: bool = False) -> DataFrame:
    """Log windows joined with metric windows: signals, score, type, severity, reason."""
    df = join_on(logs, metrics, on, "left") if not full_outer else logs.join(metrics, on, "full")
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in METRIC_COLUMNS})
    if full_outer:
        log_columns = ["log_anomaly", "log_anomaly_score", "error_rate", "semantic_anomaly_rate"]
        df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in log_columns})
    log, metric = F.col("log_anomaly") == 1, F.col("metric_anomaly") == 1
    df = df.withColumns(
        {
            "log_signal": log.cast("int"),
            "metric_signal": metric.cast("int"),
            "multi_source_signal": (log & metric).cast("int"),
            "log_only_signal": (log & ~metric).cast("int"),
            "metric_only_signal": (~log & metric).cast("int"),
            "multi_source_score": 50 * clip(F.col("log_anomaly_score"), 0, 1)
            + 30 * clip(F.col("metric_anomaly"), 0, 1)
            + 20 * clip(F.col("metric_max_anomaly_score"), 0, 1),
            # Names of the signals.
            "signal_type": F.when(log & metric, "MULTI_SOURCE").when(log, "LOG_ONLY").when(metric, "METRIC_ONLY").otherwise("NORMAL"),
            "incident_signal": (log | metric).cast("int"),
        }
    )
    single = [(0.80, "HIGH"), (0.60, "MEDIUM")]
    severity = (
        F.when(log & metric, level(F.col("multi_source_score"), RISK_CUTS, "LOW"))
        .when(log, level(F.col("log_anomaly_score"), single, "LOW"))
        .when(metric, level(F.col("metric_max_anomaly_score"), single, "LOW"))
        .otherwise("NORMAL")
    )
    text = reasons(
        [
            (log, "log_anomaly"),
            (metric, "metric_anomaly"),
            (F.col("metric_anomaly_rate") >= 0.20, "high_metric_anomaly_density"),
            (F.col("metric_unique_series") >= 2, "multi_metric_series"),
            (F.col("error_rate") >= 0.50, "high_log_error_rate"),
            (F.col("semantic_anomaly_rate") >= 0.50, "high_log_semantic_anomaly_rate"),
        ],
        " + ",
        "normal",
    )
    return df.withColumns({"correlation_severity": severity, "correlation_reason": text})


def multisource_incidents(correlated: DataFrame, keys: list[str], gap_minutes: float = 5, window_minutes: int = 5) -> DataFrame:
    """Episodes of incident windows with sixteen aggregates, INC-MS-%04d ids and class."""
    signals = correlated.filter(F.col("incident_signal") == 1)
    episodes = sessionize(signals, keys, "window_start", gap_minutes, output="_episode")
    m, s, a = F.max, F.sum, F.avg
    df = (
        episodes.groupBy(*keys, "_episode")
        .agg(
            F.min("window_start").alias("incident_start"),
            m("window_start").alias("incident_end"),
            F.count(F.lit(1)).alias("incident_windows"),
            m("log_anomaly_score").alias("max_log_anomaly_score"),
            m("metric_max_anomaly_score").alias("max_metric_anomaly_score"),
            m("metric_anomaly_rate").alias("max_metric_anomaly_rate"),
            a("error_rate").alias("mean_log_error_rate"),
            m("error_rate").alias("max_log_error_rate"),
            m("semantic_anomaly_rate").alias("max_semantic_anomaly_rate"),
            m("metric_unique_series").alias("max_metric_series"),
            s("metric_anomaly_points").alias("total_metric_anomaly_points"),
            s("multi_source_signal").alias("multi_source_windows"),
            s("log_only_signal").alias("log_only_windows"),
            s("metric_only_signal").alias("metric_only_windows"),
            m("multi_source_score").alias("max_multi_source_score"),
            a("multi_source_score").alias("mean_multi_source_score"),
        )
        .withColumn("duration_minutes", minutes_between(F.col("incident_start"), F.col("incident_end")) + window_minutes)
    )
    multi, busy = F.col("multi_source_windows") > 0, F.col("max_log_error_rate") >= 0.50
    df = df.withColumns(
        {
            # Type and reason names with their limits.
            "incident_type": F.when(multi & (F.col("max_metric_series") >= 2) & busy, "MULTI_SOURCE_MULTI_SERVICE")
            .when(multi, "LOG_METRIC_CORRELATED")
            .when(F.col("log_only_windows") > 0, "LOG_ONLY")
            .otherwise("METRIC_ONLY"),
            "incident_severity": level(F.col("max_multi_source_score"), RISK_CUTS, "LOW"),
            "incident_reason": reasons(
                [
                    (multi, "logs_and_metrics_correlated"),
                    (busy, "high_log_error_rate"),
                    (F.col("max_semantic_anomaly_rate") >= 0.50, "high_semantic_anomaly_rate"),
                    (F.col("max_metric_anomaly_rate") >= 0.20, "high_metric_anomaly_density"),
                    (F.col("max_metric_series") >= 2, "multiple_metric_series"),
                ],
                " + ",
                "single_source_anomaly",
            ),
        }
    )
    numbered = global_number(df, ["incident_start", *keys], "_number")
    return numbered.withColumn("incident_id", F.format_string("INC-MS-%04d", F.col("_number"))).drop("_episode", "_number")


def align_metrics(long: DataFrame, keys: list[str], metric: str, value: str, metrics: list[str] | None = None) -> DataFrame:
    """All metrics of a time side by side: one pivot instead of a chain of outer joins.
    The metric names are few and known to the catalogue; they are read when not given."""
    grouped = long.groupBy(*keys).pivot(metric, metrics) if metrics else long.groupBy(*keys).pivot(metric)
    return grouped.agg(F.avg(value))


def anomaly_counts(scored: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """Per time: share and number of metrics with |z| > 3, > 5, and the same by domain."""
    high = F.coalesce(F.abs(F.col(z)) > 3, F.lit(False))
    aggregates = [
        F.count_if(high).alias("multisource_anomaly_count"),
        F.avg(high.cast("int")).alias("multisource_anomaly_ratio"),
        F.count_if(F.coalesce(F.abs(F.col(z)) > 5, F.lit(False))).alias("multisource_high_anomaly_count"),
    ]
    for domain, text in {"network": "network", "disk": "diskio", "system": "system_"}.items():
        member = F.lower("metric").contains(text)
        aggregates.append(F.count_if(high & member).alias(domain + "_anomaly_count"))
        aggregates.append(F.coalesce(F.avg(F.when(member, high.cast("int"))), F.lit(0.0)).alias(domain + "_anomaly_ratio"))
    return scored.groupBy(*keys).agg(*aggregates)


def global_change(long: DataFrame, series: list[str], at: list[str], ts: str, value: str) -> DataFrame:
    """Per time: mean and median absolute change over the metrics, number above 50 %."""

    def change(w):
        previous = F.lag(value).over(w)
        return {"_change": F.abs((F.col(value) - previous) / (F.abs(previous) + 1e-9))}

    changed = Timeline(long, series, [ts]).frames(change, before=1).result()
    return quantiles_by(
        changed,
        at,
        {"global_abs_change_median": ("_change", 0.5)},
        [F.avg("_change").alias("global_abs_change_mean"), F.count_if(F.col("_change") > 0.50).alias("global_large_change_count")],
    )


def anomaly_pressure(df: DataFrame, keys: list[str], ts: str, ratio: str = "multisource_anomaly_ratio") -> DataFrame:
    """Rolling anomaly share over 3 and 6 rows and its change."""
    line = Timeline(df, keys, [ts]).frames(
        lambda w: {
            "anomaly_pressure_15m": F.avg(ratio).over(w.rowsBetween(-2, 0)),
            "anomaly_pressure_30m": F.avg(ratio).over(w.rowsBetween(-5, 0)),
        },
        lambda w: {"anomaly_pressure_change": F.col("anomaly_pressure_15m") - F.lag("anomaly_pressure_15m").over(w)},
        before=6,
    )
    return line.result()


def class_comparison(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mean by class, difference, share missing and positive rate of every feature."""
    entry = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
    long = df.select(F.col(label).alias("_y"), F.explode(F.array(*[entry(c) for c in features])).alias("e")).select("_y", "e.*")
    one = lambda y: F.avg(F.when(F.col("_y") == y, F.col("v")))
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        one(1).alias("mean_positive"),
        one(0).alias("mean_negative"),
        (one(1) - one(0)).alias("difference"),
        F.avg("_y").alias("positive_rate"),
        F.avg(F.col("v").isNull().cast("int")).alias("missing_rate"),
    )


def phase_statistics(points: DataFrame, phases: DataFrame, keys: list[str], series: list[str], ts: str, tie: str, ids: list[str]) -> DataFrame:
    """Statistics of the metric points of every fault phase: moments, median, last value,
    anomalies by |z| > 3. ``points`` have value and z, ``phases`` their ids and phase_start and phase_end."""
    return interval_statistics(points, phases, keys, series, ts, tie, ids, "phase_start", "phase_end")


def change_to_during(stats: DataFrame, group: list[str]) -> DataFrame:
    """Percent change from the mean of each earlier phase to the mean during the fault."""
    mean = lambda p: F.max(F.when(F.col("phase") == p, F.col("mean")))
    change: list[Column] = [
        (F.try_divide(mean("during") - mean(p), F.abs(mean(p))) * 100).alias(f"change_{p}_to_during_pct")
        for p in ("pre_10m", "pre_5m", "pre_2m")
    ]
    return stats.groupBy(*group).agg(*change)


def band_statistics(points: DataFrame, bands: DataFrame, keys: list[str], series: list[str], ts: str, tie: str, ids: list[str]) -> DataFrame:
    """Mean, median, MAD and anomaly rate of every pre-fault band."""
    found = interval_statistics(points, bands, keys, series, ts, tie, ids, "phase_start", "phase_end", spread=True)
    return found.select(*dict.fromkeys([*series, *ids]), "n", "mean", "median", "mad", "anomaly_rate")
