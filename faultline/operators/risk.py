"""Incident risk scores, warnings and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.rules import RISK_CUTS, clip, count_true, level, reasons
from faultline.functions.timefn import minutes_between
from faultline.operators.incidents import minmax, one_row, quantile_thresholds, rank_desc
from faultline.operators.quantiles import quantiles_by
from faultline.operators.skew import Timeline
from faultline.operators.temporal_joins import active_event, next_event

LAGGED = {
    "anomaly_score": "anomaly_score",
    "is_anomaly": "is_anomaly",
    "event_count": "event_count",
    "avg_duration_ms": "avg_duration",
    "p95_duration_ms": "p95_duration",
    "error_density": "error_density",
}
CHANGING = {"event_count": "event_count", "avg_duration_ms": "avg_latency", "p95_duration_ms": "p95_latency", "error_density": "error_density"}


def risk_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lags, deltas, means of three and anomaly persistence; no later rows are used."""
    numeric = df.withColumn("is_anomaly", F.coalesce(F.col("is_anomaly").cast("int"), F.lit(0)))

    def stage(w):
        last3 = w.rowsBetween(-2, 0)
        out = {f"{name}_lag_{n}": F.coalesce(F.lag(c, n).over(w).cast("double"), F.lit(0.0)) for c, name in LAGGED.items() for n in (1, 2, 3)}
        for c, name in CHANGING.items():
            out[name + "_delta"] = F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c))
            out[name + "_rolling_3"] = F.avg(c).over(last3)
        out["anomaly_persistence_3"] = F.sum("is_anomaly").over(last3)
        return out

    return Timeline(numeric, keys, ["window_start"]).frames(stage, before=3).result()


def percentile_score(df: DataFrame, columns: list[str], q: float = 0.90) -> dict[str, Column]:
    """x / q90 * 100 clipped to 0..100; min-max where the quantile is not positive."""
    cut = one_row(quantile_thresholds(df, columns, q))
    fallback = minmax(df, {c: F.col(c) for c in columns}, 100.0)
    return {
        c: F.when(cut[c] > 0, clip(F.col(c) / cut[c] * 100, 0, 100)).otherwise(clip(fallback[c], 0, 100)) for c in columns
    }


def risk_score(features: DataFrame, rank: bool = True) -> DataFrame:
    """Transparent 0-100 risk of a window from nine weighted components."""
    rises = {c: F.greatest(F.col(c), F.lit(0.0)) for c in ("event_count_delta", "p95_latency_delta", "error_density_delta")}
    scaled = minmax(features, {"anomaly_score": F.col("anomaly_score"), **rises}, 100.0)
    at = percentile_score(features, ["event_count", "p95_duration_ms"])
    cut = one_row(quantile_thresholds(features, ["event_count", "p95_duration_ms"]))
    is_anomaly = F.col("is_anomaly")
    anomaly = clip(0.60 * scaled["anomaly_score"] + 0.40 * is_anomaly * 100.0, 0, 100)
    # The component weights.
    score = (
        0.25 * anomaly
        + 0.20 * clip(F.col("anomaly_persistence_3") / 3.0 * 100.0, 0, 100)
        + 0.15 * at["event_count"]
        + 0.15 * at["p95_duration_ms"]
        + 0.10 * clip(F.col("error_density") * 100.0, 0, 100)
        + 0.05 * clip(F.col("high_severity_rate") * 100.0, 0, 100)
        + 0.05 * scaled["event_count_delta"]
        + 0.03 * scaled["p95_latency_delta"]
        + 0.02 * scaled["error_density_delta"]
    )
    why = reasons(
        [
            (is_anomaly == 1, "anomaly signal"),
            (F.col("anomaly_persistence_3") >= 2, "persistent anomaly activity"),
            (F.col("event_count") >= cut["event_count"], "unusual event volume"),
            (F.col("p95_duration_ms") >= cut["p95_duration_ms"], "high P95 latency"),
            (F.col("error_density") >= 0.30, "high error density"),
            (F.col("high_severity_rate") >= 0.15, "high severity concentration"),
            (F.col("event_count_delta") > 0, "increasing event volume"),
            (F.col("p95_latency_delta") > 0, "increasing latency"),
        ],
        "; ",
        "normal multivariate behavior",
    )
    out = features.withColumn("risk_score", F.round(clip(score, 0, 100), 6))
    out = out.withColumns({"risk_level": level(F.col("risk_score"), RISK_CUTS, "LOW"), "risk_reason": why})
    return rank_desc(out, "risk_score", "risk_rank") if rank else out


def future_incidents(windows: DataFrame, incidents: DataFrame, keys: list[str], horizon_minutes: float) -> DataFrame:
    """incident_now (ends included) and whether one starts within the horizon, not now."""
    now = active_event(windows, incidents, keys, "window_start", "incident_start", "incident_end", "incident_id", closed=True)
    found = next_event(now, incidents, keys, "window_start", "incident_start", "incident_id")
    soon = F.coalesce(F.col("minutes_to_next") <= horizon_minutes, F.lit(False))
    return found.withColumns(
        {"incident_now": F.col("active") == 1, "future_incident": soon & (F.col("active") == 0)}
    ).drop("active")


def early_warnings(df: DataFrame) -> DataFrame:
    ahead = ~F.col("incident_now") & F.col("future_incident")
    return df.withColumns(
        {"early_warning": ahead & (F.col("risk_score") >= 40), "high_risk_warning": ahead & (F.col("risk_score") >= 60)}
    )


# Limits of the balanced risk engine.
MEANINGFUL_VOLUME, STRONG_VOLUME = 5, 10
STRONG_ANOMALY, STRONG_RATE, SINGLE_SIGNAL = 0.65, 0.70, 52.0
EARLY_RISK, HIGH_RISK = 40.0, 60.0


def risk_score_v31(df: DataFrame, keys: list[str]) -> DataFrame:
    """Balanced risk of a log window: nine signals, volume factor and three bonuses."""
    line = Timeline(df, keys, ["window_start"])
    df = line.frames(
        lambda w: {"semantic_delta": F.col("semantic_anomaly_rate") - F.coalesce(F.lag("semantic_anomaly_rate").over(w), F.lit(0.0))},
        before=1,
    ).result()
    scaled = minmax(
        df, {c: F.col(c) for c in ("error_rate_delta", "total_logs", "volume_delta", "semantic_delta", "unique_sources", "unique_hosts")}
    )
    df = df.withColumns(
        {
            "signal_anomaly": clip(F.col("aiops_anomaly_score"), 0, 1),
            "signal_error": clip(F.col("error_rate"), 0, 1),
            "signal_error_increase": scaled["error_rate_delta"],
            "signal_traffic": scaled["total_logs"],
            "signal_traffic_increase": scaled["volume_delta"],
            "signal_semantic": clip(F.col("semantic_anomaly_rate"), 0, 1),
            "signal_semantic_increase": scaled["semantic_delta"],
            "signal_multi_service": 0.6 * scaled["unique_sources"] + 0.4 * scaled["unique_hosts"],
        }
    )
    s = {n: F.col("signal_" + n) for n in ("anomaly", "error", "error_increase", "traffic", "traffic_increase", "semantic", "semantic_increase", "multi_service")}

    def persistence(w):
        last3 = w.rowsBetween(-2, 0)
        return {
            "anomaly_persistence": F.avg("signal_anomaly").over(last3),
            "error_persistence": F.avg("signal_error").over(last3),
            "semantic_persistence": F.avg("signal_semantic").over(last3),
            "persistent_anomaly_windows": F.sum((s["anomaly"] >= STRONG_ANOMALY).cast("int")).over(last3),
        }

    df = Timeline(df, keys, ["window_start"]).frames(persistence, before=2).result()
    logs, persistent = F.col("total_logs"), F.col("persistent_anomaly_windows")
    df = df.withColumns(
        {
            "volume_class": F.when(logs >= STRONG_VOLUME, "STRONG").when(logs >= MEANINGFUL_VOLUME, "MEANINGFUL").otherwise("VERY_LOW"),
            "volume_confidence": clip(logs / F.lit(float(STRONG_VOLUME)), 0, 1),
            "confirming_signals": count_true(*[s[n] >= 0.50 for n in ("anomaly", "error", "traffic", "semantic", "multi_service")]),
            "strong_signals": count_true(*[s[n] >= STRONG_RATE for n in ("anomaly", "error", "semantic")]),
            # The signal weights.
            "base_risk_score": 100
            * (
                0.25 * s["anomaly"] + 0.15 * F.col("anomaly_persistence") + 0.15 * s["semantic"] + 0.15 * s["error"]
                + 0.10 * s["traffic"] + 0.05 * s["error_increase"] + 0.05 * s["traffic_increase"]
                + 0.05 * s["semantic_increase"] + 0.05 * s["multi_service"]
            ),
            "volume_adjustment": F.when(logs <= 1, 0.35).when(logs <= 2, 0.50).when(logs < MEANINGFUL_VOLUME, 0.70).when(logs < STRONG_VOLUME, 0.90).otherwise(1.00),
            "persistence_bonus": F.when(persistent >= 3, 8.0).when(persistent >= 2, 5.0).otherwise(0.0),
        }
    )
    confirming = F.col("confirming_signals")
    strong = (s["anomaly"] >= STRONG_ANOMALY) | (s["error"] >= STRONG_RATE) | (s["semantic"] >= STRONG_RATE)
    df = df.withColumns(
        {
            "multi_signal_bonus": F.when(confirming >= 4, 8.0).when(confirming >= 3, 6.0).when(confirming >= 2, 3.0).otherwise(0.0),
            "strong_single_signal_bonus": F.when((logs >= MEANINGFUL_VOLUME) & strong, 5.0).otherwise(0.0),
        }
    )
    total = F.col("base_risk_score") * F.col("volume_adjustment") + F.col("persistence_bonus") + F.col("multi_signal_bonus") + F.col("strong_single_signal_bonus")
    # The small term makes exact halves round up whatever the order of the sum was.
    df = df.withColumn("risk_score", F.round(clip(total, 0, 100) + 1e-9, 2))
    # Reason texts with their limits.
    why = reasons(
        [
            (s["anomaly"] >= 0.65, "STRONG_AIOPS_ANOMALY"),
            (s["error"] >= 0.70, "HIGH_ERROR_RATE"),
            (s["error_increase"] >= 0.70, "RAPID_ERROR_RATE_INCREASE"),
            (s["semantic"] >= 0.70, "HIGH_SEMANTIC_ANOMALY"),
            (s["semantic_increase"] >= 0.70, "RAPID_SEMANTIC_INCREASE"),
            (s["traffic"] >= 0.70, "HIGH_TRAFFIC_VOLUME"),
            (s["traffic_increase"] >= 0.70, "RAPID_TRAFFIC_INCREASE"),
            (s["multi_service"] >= 0.70, "MULTI_SERVICE_ACTIVITY"),
            (persistent >= 2, "ANOMALY_PERSISTENCE"),
            (confirming >= 2, "MULTI_SIGNAL_CONFIRMATION"),
            (F.col("volume_class") == "VERY_LOW", "LOW_EVENT_VOLUME"),
        ],
        " | ",
        "LOW_CONFIDENCE_OPERATIONAL_SIGNAL",
    )
    return df.withColumns({"risk_level": level(F.col("risk_score"), RISK_CUTS, "LOW"), "risk_reason": why})


def warning_flags(df: DataFrame) -> DataFrame:
    """Early and high-risk warnings of the balanced engine and its false alarms."""
    score, logs = F.col("risk_score"), F.col("total_logs")
    loud = logs >= MEANINGFUL_VOLUME
    single = (F.col("signal_anomaly") >= STRONG_ANOMALY) | (loud & ((F.col("signal_error") >= STRONG_RATE) | (F.col("signal_semantic") >= STRONG_RATE)))
    multi, persistent = F.col("confirming_signals") >= 2, F.col("persistent_anomaly_windows") >= 2
    logic = ((score >= 45) & multi) | ((score >= 48) & persistent) | ((score >= SINGLE_SIGNAL) & single) | ((score >= 55) & loud)
    quiet, candidate = ~F.col("incident_now"), score >= EARLY_RISK
    early = quiet & F.col("future_incident") & candidate & logic
    return df.withColumns(
        {
            "strong_single_signal": single,
            "multi_signal_confirmation": multi,
            "persistent_signal": persistent,
            "early_warning": early,
            "high_risk_warning": early & (score >= HIGH_RISK),
            "false_positive_warning": quiet & ~F.col("future_incident") & candidate & logic,
        }
    )


def incident_warnings(windows: DataFrame, incidents: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """The earliest early warning ahead of every incident, with its lead time."""
    on = [*keys, "incident_id"]
    early = windows.filter("early_warning").filter(F.col("next_incident_id").isNotNull())
    lead = minutes_between(F.col("window_start"), F.col("next_incident_start"))
    first = (
        early.groupBy(*keys, F.col("next_incident_id").alias("incident_id"))
        .agg(F.max_by(F.struct(lead.alias("lead"), "risk_score", "risk_level", "total_logs", "confirming_signals"), lead).alias("w"))
    )
    joined = incidents.select(*on, "incident_start").join(first, on, "left")
    return joined.select(
        *id_cols,
        "incident_start",
        F.col("w").isNotNull().alias("preceded_by_warning"),
        F.col("w.lead").alias("lead_time_minutes"),
        F.col("w.risk_score").alias("warning_risk_score"),
        F.col("w.risk_level").alias("warning_risk_level"),
        F.col("w.total_logs").alias("warning_total_logs"),
        F.col("w.confirming_signals").alias("warning_confirming_signals"),
    )


def evaluate_warnings(evaluation: DataFrame, windows: DataFrame, version: str) -> DataFrame:
    """One row per version: coverage, coverage by lead time, warning precision, lead times. Without incidents the coverage is undefined (NaN)."""
    lead = F.col("lead_time_minutes")
    per_incident = quantiles_by(
        evaluation,
        [],
        {"median_lead_time": ("lead_time_minutes", 0.5)},
        [
            F.count(F.lit(1)).alias("incidents"),
            F.count_if("preceded_by_warning").alias("preceded"),
            *[F.count_if(lead >= m).alias(f"covered_{m}m") for m in (5, 10, 15)],
            F.avg(lead).alias("mean_lead_time"),
        ],
    )
    alarms = one_row(windows.agg(F.count_if("early_warning").alias("early"), F.count_if("false_positive_warning").alias("false")))
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("incidents")), F.lit(float("nan")))
    return per_incident.select(
        F.lit(version).alias("version"),
        "incidents",
        "preceded",
        share("preceded").alias("incident_coverage"),
        *[share(f"covered_{m}m").alias(f"coverage_{m}m_pct") for m in (5, 10, 15)],
        alarms["early"].alias("early_warning_windows"),
        alarms["false"].alias("false_positive_windows"),
        F.coalesce(F.try_divide(alarms["early"] * 100.0, alarms["early"] + alarms["false"]), F.lit(0.0)).alias("warning_precision"),
        F.coalesce("mean_lead_time", F.lit(0.0)).alias("mean_lead_time"),
        F.coalesce("median_lead_time", F.lit(0.0)).alias("median_lead_time"),
    )


def compare_versions(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
