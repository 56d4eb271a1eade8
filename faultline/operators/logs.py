"""Log blocks, log windows and the semantic roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.timefn import floor_to, micros, minutes_between, shift
from faultline.operators.incidents import sessionize
from faultline.operators.quantiles import quantiles_by
from faultline.operators.skew import Timeline, join_on


def log_blocks(df: DataFrame, keys: list[str], gap_minutes: float = 30) -> DataFrame:
    """Log lines with the number of their activity block."""
    return sessionize(df, keys, "ts", gap_minutes, ["line_id"], output="block_id")


def block_stats(blocks: DataFrame, keys: list[str], minimum: int = 50) -> DataFrame:
    """Extent, volume and mix of every block with at least ``minimum`` lines."""
    return (
        blocks.groupBy(*keys, "block_id")
        .agg(
            F.min("ts").alias("block_start"),
            F.max("ts").alias("block_end"),
            F.count(F.lit(1)).alias("total_logs"),
            F.count_if(F.col("label") == "error").alias("error_logs"),
            F.count_if(F.col("label") == "info").alias("info_logs"),
            F.count_distinct("source").alias("sources"),
            F.count_distinct("host").alias("hosts"),
        )
        .filter(F.col("total_logs") >= minimum)
        .withColumns(
            {
                "duration_minutes": minutes_between(F.col("block_start"), F.col("block_end")),
                "error_rate": F.col("error_logs") / F.col("total_logs"),
            }
        )
    )


def block_threshold_study(df: DataFrame, keys: list[str], gaps: list[float]) -> DataFrame:
    """Blocks under several gap limits: one lag pass, one running count per limit."""
    line = Timeline(df, keys, ["ts", "line_id"]).frames(lambda w: {"_previous": F.lag("ts").over(w)}, before=1)
    gap = minutes_between(F.col("_previous"), F.col("ts"))
    fresh = {f"_b{i}": ("sum", (gap.isNull() | (gap > g)).cast("int")) for i, g in enumerate(gaps)}
    numbered = line.running(fresh).result()
    long = numbered.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(float(g)).alias("gap_minutes"), F.col(f"_b{i}").alias("block")) for i, g in enumerate(gaps)])).alias("g")
    ).select(*keys, "g.*")
    sizes = long.groupBy(*keys, "gap_minutes", "block").agg(F.count(F.lit(1)).alias("size"))
    at_least = [F.count_if(F.col("size") >= n).alias(f"blocks_ge_{n}") for n in (10, 50, 100)]
    return quantiles_by(
        sizes,
        ["gap_minutes"],
        {"median_size": ("size", 0.5)},
        [F.count(F.lit(1)).alias("blocks"), F.avg("size").alias("mean_size"), F.max("size").alias("max_size"), *at_least],
    )


def log_windows(blocks: DataFrame, keys: list[str], minutes: int = 5) -> DataFrame:
    """Per block and window: volumes, error rate, distinct counts, deltas to the previous
    window of the block and means of the last three."""
    group = [*keys, "block_id"]
    windows = (
        blocks.withColumn("window_start", floor_to(F.col("ts"), f"{minutes} minutes"))
        .groupBy(*group, "window_start")
        .agg(
            F.count(F.lit(1)).alias("total_logs"),
            F.count_if(F.col("label") == "error").alias("error_count"),
            F.count_if(F.col("label") == "info").alias("info_count"),
            F.count_distinct("source").alias("unique_sources"),
            F.count_distinct("host").alias("unique_hosts"),
            F.count_distinct("exception_type").alias("unique_exception_types"),
        )
        .withColumns({"error_rate": F.col("error_count") / F.col("total_logs"), "window_end": shift(F.col("window_start"), mins=minutes)})
    )
    zero = F.lit(0.0)

    def change(w):
        last3 = w.rowsBetween(-2, 0)
        before_rate, before_logs = F.lag("error_rate").over(w), F.lag("total_logs").over(w)
        return {
            "previous_error_rate": F.coalesce(before_rate, zero),
            "error_rate_delta": F.coalesce(F.col("error_rate") - before_rate, zero),
            "previous_total_logs": F.coalesce(before_logs.cast("double"), zero),
            "volume_delta": F.coalesce((F.col("total_logs") - before_logs).cast("double"), zero),
            "rolling_error_rate_3": F.avg("error_rate").over(last3),
            "rolling_volume_3": F.avg("total_logs").over(last3),
        }

    out = Timeline(windows, group, ["window_start"]).frames(change, before=2).result()
    return out.withColumns(
        {
            "hour": F.hour("window_start"),
            "day_of_week": F.weekday("window_start"),
            "is_weekend": (F.weekday("window_start") >= 5).cast("int"),
            "has_error": (F.col("error_count") > 0).cast("int"),
        }
    )


def assign_offset_window(blocks: DataFrame, keys: list[str], seconds: int = 300) -> DataFrame:
    """Window number counted from the first line of the block."""
    group = [*keys, "block_id"]
    first = blocks.groupBy(*group).agg(F.min("ts").alias("_first"))
    joined = join_on(blocks, first, group, "left")
    offset = F.floor((micros(F.col("ts")) - micros(F.col("_first"))) / F.lit(seconds * 1_000_000))
    start = F.col("_first") + F.make_dt_interval(secs=offset.cast("decimal(18,6)") * seconds)
    return joined.withColumns({"window_index": offset, "window_start": start}).drop("_first")


def semantic_score(df: DataFrame, margin: str = "margin") -> DataFrame:
    """Prediction by the sign of the classifier margin; confidence is |margin| over its maximum."""
    top = df.agg(F.max(F.abs(F.col(margin)))).scalar()
    return df.withColumns(
        {
            "semantic_anomaly": (F.col(margin) > 0).cast("int"),
            "semantic_confidence": F.coalesce(F.try_divide(F.abs(F.col(margin)), top), F.lit(0.0)),
        }
    )


def semantic_windows(df: DataFrame, group: list[str]) -> DataFrame:
    """Roll-up of scored log lines per block window."""
    flag = F.col("semantic_anomaly")
    return (
        df.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("semantic_total_logs"),
            F.sum(flag).alias("semantic_anomaly_count"),
            F.avg("margin").alias("semantic_mean_score"),
            F.max("margin").alias("semantic_max_score"),
            F.avg("semantic_confidence").alias("semantic_mean_confidence"),
            F.max("semantic_confidence").alias("semantic_max_confidence"),
            F.count_distinct("source").alias("semantic_sources"),
            F.count_distinct("host").alias("semantic_hosts"),
        )
        .withColumn("semantic_anomaly_rate", F.col("semantic_anomaly_count") / F.col("semantic_total_logs"))
    )


def attach_semantic(windows: DataFrame, semantic: DataFrame, group: list[str]) -> DataFrame:
    """Left join of the semantic roll-up; windows without scored lines get 0."""
    added = [c for c in semantic.columns if c not in group]
    joined = join_on(windows, semantic, group, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in added})


def require_common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys present in both; fails when there is none."""
    common = a.select(*keys).intersect(b.select(*keys))
    if common.isEmpty():
        raise ValueError(f"no common {keys}")
    return common


def positive_events(df: DataFrame, label: str, ts: str) -> DataFrame:
    """Distinct times of the rows whose label reads as positive; every row counts when no
    label does. Decided by one scalar subquery, not by a second pass on the driver."""
    # Labels accepted as positive.
    accepted = ["1", "true", "yes", "incident", "anomaly", "failure", "fault", "error", "critical", "high", "outage"]
    positive = F.coalesce(F.lower(F.trim(F.col(label).cast("string"))).isin(accepted), F.lit(False))
    any_positive: Column = df.agg(F.max(positive)).scalar()
    return df.filter(F.col(ts).isNotNull()).filter(positive | ~F.coalesce(any_positive, F.lit(False))).select(ts).distinct()
