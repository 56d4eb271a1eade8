"""From scored windows to incident episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.rules import (
    anomaly_reason,
    count_true,
    log_incident_reason,
    log_incident_severity,
    log_incident_type,
    reasons,
    score_level,
)
from faultline.functions.timefn import minutes_between
from faultline.operators.quantiles import quantiles_by
from faultline.operators.skew import Timeline, join_on

SEVERE = ["event_count", "avg_duration_ms", "p95_duration_ms", "high_severity_rate", "error_density"]


def one_row(df: DataFrame) -> dict[str, Column]:
    """The columns of a one-row DataFrame as scalar subqueries."""
    scalar = df.select(F.struct(*df.columns).alias("row")).scalar()
    return {c: scalar[c] for c in df.columns}


def quantile_thresholds(df: DataFrame, columns: list[str], q: float = 0.90) -> DataFrame:
    """One row with the exact q-quantile of every column."""
    return quantiles_by(df, [], {c: (c, q) for c in columns})


def minmax(df: DataFrame, columns: dict[str, Column], top: float = 1.0) -> dict[str, Column]:
    """Each column scaled to 0..top over the whole table; a constant column becomes 0."""
    ends = one_row(
        df.agg(
            *[F.min(c).alias(n + "_lo") for n, c in columns.items()], *[F.max(c).alias(n + "_hi") for n, c in columns.items()]
        )
    )
    return {
        n: F.when(ends[n + "_hi"] > ends[n + "_lo"], (c - ends[n + "_lo"]) / (ends[n + "_hi"] - ends[n + "_lo"]) * top).otherwise(
            F.lit(0.0)
        )
        for n, c in columns.items()
    }


def describe_anomalies(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Normalized score, level, reasons (strictly above the 90th percentile) and rank."""
    features = [c for c in [*SEVERE, "unique_event_types"] if c in df.columns]
    q90 = one_row(quantile_thresholds(df, features))
    scaled = minmax(df, {"n": F.col(score)})["n"]
    out = df.withColumn("anomaly_score_normalized", scaled).withColumns(
        {"anomaly_level": score_level(F.col("anomaly_score_normalized")), "anomaly_reason": anomaly_reason(q90)}
    )
    return rank_desc(out, score, "anomaly_rank")


def rank_desc(df: DataFrame, column: str, output: str, keys: list[str] | None = None) -> DataFrame:
    """Rank from the highest value, equal values sharing the smallest rank. The distinct
    values are counted first, then numbered as a sliced timeline, so the global form does
    not sort the table in one task."""
    keys = keys or []
    sizes = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    line = Timeline(sizes, keys, [column])
    ranks = line.running({output: ("sum", F.col("_n"))}, reverse=True, exclusive=True)
    ranked = ranks.columns({output: F.col(output) + 1}).result("_n")
    return join_on(df, ranked, [*keys, column], "left")


def incident_signals(df: DataFrame, q90: dict[str, Column], minimum: int = 2) -> DataFrame:
    """Severe flags (at or above the threshold), their count and the incident signal."""
    flags = {"severe_" + c: F.coalesce(F.coalesce(c, F.lit(0.0)) >= t, F.lit(False)) for c, t in q90.items()}
    out = df.withColumns(flags)
    out = out.withColumn("severe_signal_count", count_true(*[F.col(c) for c in flags]))
    return out.withColumn(
        "incident_signal", F.coalesce("is_anomaly", F.lit(False)) | (F.col("severe_signal_count") >= minimum)
    )


def sessionize(df: DataFrame, keys: list[str], ts: str, gap_minutes: float, ties: list[str] = (), output: str = "session_id") -> DataFrame:
    """Number the sessions of each key (from 1). A gap longer than the limit starts a new
    session; a gap equal to it does not. With no keys the numbering is global."""
    line = Timeline(df, keys, [ts, *ties])
    line = line.frames(lambda w: {"_previous": F.lag(ts).over(w)}, before=1)
    fresh = F.col("_previous").isNull() | (minutes_between(F.col("_previous"), F.col(ts)) > gap_minutes)
    line = line.columns({"_new": fresh.cast("int")}).running({output: ("sum", F.col("_new"))})
    return line.result("_previous", "_new")


def incident_episodes(df: DataFrame, keys: list[str], gap_minutes: float = 1) -> DataFrame:
    return sessionize(df.filter("incident_signal"), keys, "window_start", gap_minutes, output="incident_id")


PEAKS = ["anomaly_score", "event_count", "avg_duration_ms", "p95_duration_ms", "high_severity_rate", "error_density", "failure_rate", "severe_signal_count"]


def incident_summary(episodes: DataFrame, keys: list[str], window_minutes: float = 1) -> DataFrame:
    """One row per incident: extent, window count, peaks and duration."""
    return (
        episodes.groupBy(*keys, "incident_id")
        .agg(
            F.min("window_start").alias("incident_start"),
            F.max("window_start").alias("incident_end"),
            F.count(F.lit(1)).alias("duration_windows"),
            F.sum(F.col("is_anomaly").cast("int")).alias("anomalous_windows"),
            *[F.max(c).alias("max_" + c) for c in PEAKS],
        )
        .withColumn("duration_minutes", minutes_between(F.col("incident_start"), F.col("incident_end")) + window_minutes)
    )


def incident_class(df: DataFrame, q90: dict[str, Column]) -> DataFrame:
    """Severity, type and reason of summarized incidents."""
    score, severe, anomalous = F.col("max_anomaly_score"), F.col("max_severe_signal_count"), F.col("anomalous_windows")
    # Severity, type and reason names with their limits.
    severity = (
        F.when((score >= 0.10) | (severe >= 4), "CRITICAL")
        .when((score >= 0.02) | (severe >= 3), "HIGH")
        .when((severe >= 2) | (anomalous >= 1), "MEDIUM")
        .otherwise("LOW")
    )
    over = {c: F.col("max_" + c) >= t for c, t in q90.items()}
    kind = (
        F.when(over["p95_duration_ms"], "LATENCY_ANOMALY")
        .when(over["event_count"], "TRAFFIC_OR_VOLUME_ANOMALY")
        .when(over["error_density"], "ERROR_DENSITY_ANOMALY")
        .when(over["high_severity_rate"], "HIGH_SEVERITY_ANOMALY")
        .otherwise("MULTIVARIATE_ANOMALY")
    )
    listed = reasons(
        [
            (over["event_count"], "unusual event volume"),
            (over["avg_duration_ms"], "high average latency"),
            (over["p95_duration_ms"], "high P95 latency"),
            (over["error_density"], "high error density"),
            (over["high_severity_rate"], "high severity concentration"),
        ],
        "; ",
        "",
    )
    windows = F.when(anomalous > 0, F.format_string("%d anomaly window(s)", anomalous))
    text = F.concat_ws("; ", windows, F.nullif(listed, F.lit("")))
    return df.withColumns(
        {
            "incident_severity": severity,
            "incident_type": kind,
            "incident_reason": F.when(text == "", "multivariate operational anomaly").otherwise(text),
        }
    )


def attach_summary(episodes: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """The summary columns of its incident on every window. No hint: the planner
    broadcasts the summary only when its measured size allows it."""
    columns = ["incident_start", "incident_end", "duration_windows", "duration_minutes", "incident_severity", "incident_type", "incident_reason"]
    keep = [*keys, "incident_id", *columns]
    return join_on(episodes, summary.select(*keep), [*keys, "incident_id"], "left")


def global_number(df: DataFrame, order: list[str], output: str) -> DataFrame:
    """Dense row numbers over the whole table in the given order."""
    return Timeline(df, [], order).running({output: ("sum", F.lit(1))}).result()


def log_incidents(df: DataFrame, keys: list[str], gap_minutes: float = 5, minimum_windows: int = 1) -> DataFrame:
    """Anomalous log windows grouped into incidents with INC-%04d ids, peaks and class."""
    flagged = df.filter(F.lower(F.col("is_aiops_anomaly").cast("string")).isin("true", "1", "yes"))
    sessions = sessionize(flagged, keys, "window_start", gap_minutes, output="_group")
    peak = F.struct("semantic_anomaly_rate", "error_rate", "error_rate_delta", "volume_delta", "unique_sources", "aiops_anomaly_score")
    first_peak = F.struct("aiops_anomaly_score", -F.unix_micros(F.col("window_start").cast("timestamp")))
    grouped = (
        sessions.groupBy(*keys, "_group")
        .agg(
            F.min("window_start").alias("incident_start"),
            F.max("window_end").alias("incident_end"),
            F.count(F.lit(1)).alias("anomalous_windows"),
            *[f(c).alias(f"{n}_{c}") for c in ("aiops_anomaly_score", "error_rate", "semantic_anomaly_rate") for n, f in (("max", F.max), ("mean", F.avg))],
            F.max("total_logs").alias("max_total_logs"),
            F.sum("semantic_anomaly_count").alias("total_semantic_anomalous_logs"),
            F.max("unique_sources").alias("max_unique_sources"),
            F.max("unique_hosts").alias("max_unique_hosts"),
            F.max("error_rate_delta").alias("_error_delta"),
            F.max("volume_delta").alias("_volume"),
            F.max_by(peak, first_peak).alias("_peak"),
        )
        .filter(F.col("anomalous_windows") >= minimum_windows)
    )
    score, semantic, error = (F.col("max_" + c) for c in ("aiops_anomaly_score", "semantic_anomaly_rate", "error_rate"))
    classed = grouped.withColumns(
        {
            "duration_minutes": F.round(minutes_between(F.col("incident_start"), F.col("incident_end")), 2),
            "incident_severity": log_incident_severity(score, semantic, error, F.col("_volume")),
            "incident_type": log_incident_type(F.col("_peak")),
            "incident_reason": log_incident_reason(
                score, semantic, error, F.col("_error_delta"), F.col("_volume"), F.col("max_unique_sources")
            ),
        }
    )
    rounded = [c for c in classed.columns if c.startswith(("max_", "mean_")) and c.endswith(("score", "rate"))]
    classed = classed.withColumns({c: F.round(c, 4) for c in rounded})
    numbered = global_number(classed, ["incident_start", *keys], "_number")
    named = numbered.withColumn("incident_id", F.format_string("INC-%04d", F.col("_number")))
    return named.drop("_group", "_error_delta", "_volume", "_peak", "_number")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, keys: list[str], order: list[Column], k: int, output: str = "rank") -> DataFrame:
    """First k rows of each key. The rank filter is applied before the shuffle as well, so
    a hot key sends k rows per task, not all of them."""
    return df.withColumn(output, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(output) <= k)
