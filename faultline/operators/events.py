"""Event signals and fixed-window features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.timefn import calendar, floor_to
from faultline.operators.quantiles import quantiles_by

# Event types that count as failures, and the failure vocabulary.
FAILURE_TYPES = ["SERVER_ERROR", "ROUTING_ERROR", "HTTP_EXCEPTION", "DB_ERROR", "HTTP_ERROR"]
FAILURE_WORDS = ["failure", "failed", "error", "critical", "exception", "timeout", "crash", "fatal", "server_error", "5xx"]
SLOW_MS = [100, 500, 1000]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def event_signals(df: DataFrame) -> DataFrame:
    """0/1 signal columns of each event; nulls count as 0."""
    kind = F.col("event_type")
    signals = {
        "failure_signal": (F.col("status") == "FAILURE") | kind.isin(FAILURE_TYPES) | (F.col("level") == "ERROR"),
        "high_severity_signal": F.col("severity") == "HIGH",
        "server_error_signal": kind == "SERVER_ERROR",
        "routing_error_signal": kind == "ROUTING_ERROR",
        "db_error_signal": kind == "DB_ERROR",
        "http_error_signal": kind.isin("HTTP_ERROR", "HTTP_EXCEPTION"),
        "http_request_signal": kind == "INCOMING_REQUEST",
        "db_query_signal": kind == "DB_QUERY",
    }
    signals |= {f"slow_{ms}ms": F.col("duration_ms") > ms for ms in SLOW_MS}
    return df.withColumns({name: _flag(c) for name, c in signals.items()})


def failure_mask(text: Column, status_code: Column) -> Column:
    """A failure word in the text or an HTTP status of 500 and above."""
    words = "|".join(FAILURE_WORDS)
    return F.coalesce(F.lower(text).rlike(words), F.lit(False)) | F.coalesce(status_code >= 500, F.lit(False))


SIGNAL_COUNTS = {
    "failure_count": "failure_signal",
    "high_severity_count": "high_severity_signal",
    "server_error_count": "server_error_signal",
    "routing_error_count": "routing_error_signal",
    "db_error_count": "db_error_signal",
    "http_error_count": "http_error_signal",
    "http_request_count": "http_request_signal",
    "db_query_count": "db_query_signal",
    "slow_100ms_count": "slow_100ms",
    "slow_500ms_count": "slow_500ms",
    "slow_1000ms_count": "slow_1000ms",
}
ERROR_COUNTS = ["server_error_count", "routing_error_count", "db_error_count", "http_error_count"]
DISTINCTS = {"unique_paths": "path", "unique_event_types": "event_type", "unique_categories": "category", "unique_severities": "severity"}


def window_aggregates(distinct=F.count_distinct) -> list[Column]:
    return [
        F.sum("event_count").alias("event_count"),
        F.count(F.lit(1)).alias("raw_row_count"),
        *[F.sum(c).alias(n) for n, c in SIGNAL_COUNTS.items()],
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.max("duration_ms"), F.lit(0.0)).alias("max_duration_ms"),
        *[distinct(c).alias(n) for n, c in DISTINCTS.items()],
    ]


def rates(df: DataFrame) -> DataFrame:
    rows = F.col("raw_row_count")
    return df.withColumns(
        {
            "failure_rate": F.col("failure_count") / rows,
            "high_severity_rate": F.col("high_severity_count") / rows,
            "error_density": sum((F.col(c) for c in ERROR_COUNTS), F.lit(0)) / rows,
        }
    )


def prepare(df: DataFrame) -> DataFrame:
    """Null strings become '', a missing event_count counts as 1, rows without a time drop."""
    texts = {c: F.coalesce(c, F.lit("")) for c in ("event_type", "category", "severity", "status", "level", "path")}
    count = F.coalesce(F.col("event_count"), F.lit(1)) if "event_count" in df.columns else F.lit(1)
    return event_signals(df.filter(F.col("timestamp").isNotNull()).withColumns({**texts, "event_count": count}))


def event_windows(df: DataFrame, keys: list[str], size: str = "1 minute", approximate: bool = False) -> DataFrame:
    """Per key and tumbling window: counters, latency, distinct counts, rates, calendar.

    ``approximate`` trades the exact p95 and distinct counts for sketches that merge
    map-side, which is the cheaper choice on very large windows.
    """
    events = prepare(df).withColumn("window_start", floor_to(F.col("timestamp"), size))
    group = [*keys, "window_start"]
    if approximate:
        p95 = F.percentile_approx("duration_ms", 0.95, 10_000).alias("p95_duration_ms")
        windows = events.groupBy(*group).agg(*window_aggregates(F.approx_count_distinct), p95)
    else:
        windows = quantiles_by(events, group, {"p95_duration_ms": ("duration_ms", 0.95)}, window_aggregates())
    windows = windows.withColumn("p95_duration_ms", F.coalesce("p95_duration_ms", F.lit(0.0)))
    parts = calendar(F.col("window_start"))
    return rates(windows).withColumns({n: parts[n] for n in ("hour", "minute", "day_of_week", "day_name")})


def window_granularity(df: DataFrame, minutes: list[int]) -> DataFrame:
    """One row per window size: window counts by class, event and latency statistics and
    the size that balances clean and failing windows best (at least 20 windows)."""
    sized = prepare(df).withColumn("window_minutes", F.explode(F.array(*[F.lit(m) for m in minutes])))
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    windows = (
        sized.withColumn("slot", F.floor(micros / (F.col("window_minutes") * 60_000_000)))
        .groupBy("window_minutes", "slot")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("event_count").alias("events"),
            F.sum("failure_signal").alias("failures"),
            F.avg("duration_ms").alias("latency"),
            F.max("duration_ms").alias("top_latency"),
        )
        .withColumns({"failing": (F.col("failures") > 0).cast("int"), "failure_rate": F.col("failures") / F.col("rows")})
    )
    study = quantiles_by(
        windows,
        ["window_minutes"],
        {"median_events": ("events", 0.5)},
        [
            F.count(F.lit(1)).alias("windows"),
            F.sum(1 - F.col("failing")).alias("windows_without_failure"),
            F.sum("failing").alias("windows_with_failure"),
            F.avg("failing").alias("failure_window_rate"),
            F.avg("events").alias("mean_events"),
            F.max("events").alias("max_events"),
            F.avg("failure_rate").alias("mean_failure_rate"),
            F.max("failure_rate").alias("max_failure_rate"),
            F.avg("latency").alias("mean_latency"),
            F.max("top_latency").alias("max_latency"),
        ],
    )
    usable = (F.col("windows") >= 20) & (F.col("windows_without_failure") > 0) & (F.col("windows_with_failure") > 0)
    scored = study.withColumn("score", F.when(usable, 2 * F.col("windows_without_failure") + F.col("windows_with_failure")))
    best = scored.agg(F.max_by("window_minutes", F.when(usable, F.struct("score", "windows"))).alias("best")).scalar()
    return scored.withColumn("recommended", F.coalesce(F.col("window_minutes") == best, F.lit(False)))
