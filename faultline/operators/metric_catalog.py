"""Inventory of metric files and selection of candidate metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import METRIC_GROUPS, METRIC_TYPES, first_part, metric_period, metric_scope, safe_metric_name
from faultline.operators.incidents import top_k_by


def classify_names(df: DataFrame, column: str, services: list[str]) -> DataFrame:
    """Service, metric type, group, scope, period and clean name of every file name."""
    c = F.col(column)
    return df.withColumns(
        {
            "service": first_part(c, [([s.lower()], s) for s in services], None),
            "metric_type": first_part(c, METRIC_TYPES, "other"),
            "metric_group": first_part(c, METRIC_GROUPS, "other"),
            "scope": metric_scope(c),
            "period": metric_period(c),
            "metric_name": safe_metric_name(c),
        }
    )


def metric_inventory(lines: DataFrame, column: str, services: list[str]) -> DataFrame:
    """Metric files named in listing lines, classified, one row per path."""
    path = F.regexp_extract(F.trim(F.col(column)), r"(?i)(metric[\\/].*?\.csv)\s*$", 1)
    found = lines.select(F.regexp_replace(path, "/", "\\\\").alias("path_in_archive")).filter(F.col("path_in_archive") != "").distinct()
    named = found.withColumn("filename", F.regexp_extract("path_in_archive", r"([^\\]+)$", 1))
    return classify_names(named, "filename", services)


# Reason, name parts that must all occur, preferred parts (when some file of
# the reason has one), files per service, files for the system, priority.
RULES = [
    ("docker_network_errors", ["docker_network_", "error"], [], 4, 0, 1),
    ("docker_network_packets", ["docker_network_", "packets"], [], 2, 0, 2),
    ("docker_diskio", ["docker_diskio"], ["summary"], 4, 0, 3),
    ("system_load", ["system_load"], [], 0, 5, 4),
    ("system_cpu", ["system_cpu"], ["norm"], 0, 5, 5),
    ("system_memory", ["system_memory"], ["usage", "used", "free", "available", "util"], 0, 5, 6),
]


def select_candidates(inventory: DataFrame, period: str) -> DataFrame:
    """Candidate files of one period: six rules with caps per service and for the system.

    A reason falls back to all of its files when none has a preferred part. A path takes
    the first reason that fits; ties inside a cap go by file name.
    """
    name = F.lower("filename")
    inside = inventory.filter(name.contains(period.lower())).withColumn("service", F.coalesce("service", F.lit("SYSTEM")))
    fits, preferred = {}, {}
    for reason, parts, better, *_ in RULES:
        fits[reason] = F.lit(True)
        for part in parts:
            fits[reason] = fits[reason] & name.contains(part)
        preferred[reason] = F.lit(not better)
        for part in better:
            preferred[reason] = preferred[reason] | name.contains(part)
    any_better = inside.agg(*[F.coalesce(F.max(fits[r] & preferred[r]), F.lit(False)).alias(r) for r in fits]).select(F.struct("*").alias("b")).scalar()
    reason = F.lit(None).cast("string")
    cap, rank = F.lit(0), F.lit(99)
    for r, _, _, per_service, for_system, priority in reversed(RULES):
        chosen = fits[r] & (preferred[r] | ~any_better[r])
        reason = F.when(chosen, r).otherwise(reason)
        cap = F.when(F.col("selection_reason") == r, F.when(F.col("service") == "SYSTEM", for_system).otherwise(per_service)).otherwise(cap)
        rank = F.when(F.col("selection_reason") == r, priority).otherwise(rank)
    marked = inside.withColumn("selection_reason", reason).filter(F.col("selection_reason").isNotNull())
    marked = marked.withColumns({"_cap": cap, "priority": rank})
    kept = top_k_by(marked, ["service", "selection_reason"], [F.col("filename"), F.col("path_in_archive")], max(max(per_service, for_system) for _, _, _, per_service, for_system, _ in RULES), "_n").filter(F.col("_n") <= F.col("_cap"))
    return kept.drop("_n", "_cap").orderBy("priority", "service", "filename")
