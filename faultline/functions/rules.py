"""Scoring rules as column expressions: levels, reason lists, ticket risk, advice."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Cuts = Iterable[tuple[float, str]]


def level(score: Column, cuts: Cuts, otherwise: str) -> Column:
    """The name of the first cut the score reaches; cuts run from high to low."""
    out = None
    for cut, name in cuts:
        out = F.when(score >= cut, name) if out is None else out.when(score >= cut, name)
    return out.otherwise(otherwise)


def reasons(rules: Iterable[tuple[Column, str]], separator: str, otherwise: str) -> Column:
    """The texts of all rules that hold, in order, or ``otherwise`` when none does."""
    text = F.concat_ws(separator, *[F.when(rule, F.lit(name)) for rule, name in rules])
    return F.when(text == "", otherwise).otherwise(text)


def count_true(*conditions: Column) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


# Cut points of the published levels.
ANOMALY_CUTS = [(0.80, "CRITICAL"), (0.60, "HIGH"), (0.40, "MEDIUM")]
RISK_CUTS = [(80.0, "CRITICAL"), (60.0, "HIGH"), (40.0, "MEDIUM")]
PROBABILITY_CUTS = [(0.75, "CRITICAL"), (0.50, "HIGH"), (0.25, "MEDIUM")]
ALERT_CUTS = [(0.25, "HIGH"), (0.10, "MEDIUM")]
TICKET_CUTS = [(80, "CRITICAL"), (60, "HIGH"), (35, "MEDIUM")]

# Features compared with their own 90th percentile, with their reason text.
SEVERE_REASONS = [
    ("event_count", "unusual event volume"),
    ("avg_duration_ms", "high average latency"),
    ("p95_duration_ms", "high P95 latency"),
    ("high_severity_rate", "high severity concentration"),
    ("error_density", "high error density"),
    ("unique_event_types", "unusual event diversity"),
]


def score_level(normalized: Column) -> Column:
    return level(normalized, ANOMALY_CUTS, "LOW")


def prob_level(probability: Column, cuts: Cuts = PROBABILITY_CUTS) -> Column:
    return level(probability, cuts, "LOW")


def anomaly_reason(q90: dict[str, Column]) -> Column:
    """Which features lie strictly above their 90th percentile."""
    rules = [(F.col(c) > q90[c], text) for c, text in SEVERE_REASONS if c in q90]
    return reasons(rules, "; ", "multivariate behavioral anomaly")


def log_anomaly_reason() -> Column:
    semantic, error = F.col("semantic_anomaly_rate"), F.col("error_rate")
    return reasons(
        [
            (semantic >= 0.75, "HIGH_SEMANTIC_ANOMALY_DENSITY"),
            ((semantic >= 0.50) & (semantic < 0.75), "ELEVATED_SEMANTIC_ANOMALY_DENSITY"),
            (error >= 0.75, "VERY_HIGH_ERROR_RATE"),
            ((error >= 0.50) & (error < 0.75), "HIGH_ERROR_RATE"),
            (F.col("error_rate_delta") >= 0.30, "RAPID_ERROR_RATE_INCREASE"),
            (F.col("volume_delta") >= 0.50, "RAPID_TRAFFIC_INCREASE"),
            (F.col("semantic_anomaly_count") >= 20, "HIGH_ANOMALOUS_EVENT_VOLUME"),
            (F.col("unique_sources") >= 4, "MULTI_SERVICE_ACTIVITY"),
        ],
        " | ",
        "MULTIVARIATE_OPERATIONAL_ANOMALY",
    )


def log_incident_type(peak: Column) -> Column:
    """Dominant type of a log incident, read from its peak window (a struct)."""
    semantic, error = peak["semantic_anomaly_rate"] >= 0.50, peak["error_rate"] >= 0.50
    return (
        F.when(semantic & error, "SEMANTIC_AND_ERROR_ANOMALY")
        .when(error, "ERROR_RATE_ANOMALY")
        .when(peak["volume_delta"] >= 0.50, "TRAFFIC_ANOMALY")
        .when(semantic, "SEMANTIC_ANOMALY")
        .when(peak["error_rate_delta"] >= 0.20, "RAPID_ERROR_INCREASE")
        .when(peak["unique_sources"] >= 3, "MULTI_SERVICE_ANOMALY")
        .when(peak["aiops_anomaly_score"] >= 0.80, "HIGH_MULTIVARIATE_ANOMALY")
        .otherwise("MULTIVARIATE_OPERATIONAL_ANOMALY")
    )


def log_incident_severity(score: Column, semantic: Column, error: Column, volume: Column) -> Column:
    top = F.greatest(score, semantic, error)
    return (
        F.when(top >= 0.90, "CRITICAL")
        .when((top >= 0.75) | (volume >= 1.00), "HIGH")
        .when(top >= 0.50, "MEDIUM")
        .otherwise("LOW")
    )


def log_incident_reason(score: Column, semantic: Column, error: Column, error_delta: Column, volume: Column, sources: Column) -> Column:
    return reasons(
        [
            (semantic >= 0.50, "HIGH_SEMANTIC_ANOMALY_DENSITY"),
            (error >= 0.50, "HIGH_ERROR_RATE"),
            (error >= 0.80, "VERY_HIGH_ERROR_RATE"),
            (error_delta >= 0.20, "RAPID_ERROR_RATE_INCREASE"),
            (volume >= 0.50, "TRAFFIC_INCREASE"),
            (sources >= 3, "MULTI_SERVICE_ACTIVITY"),
            (score >= 0.80, "HIGH_MULTIVARIATE_ANOMALY"),
        ],
        " | ",
        "MULTIVARIATE_OPERATIONAL_ANOMALY",
    )


# Points of the ticket risk score.
PRIORITY_POINTS = {"HIGH": 70, "MEDIUM": 45}
TYPE_POINTS = {"incident": 15, "problem": 10, "change": 5}
OUTAGE_QUEUE = "service outages and maintenance"


def ticket_risk_score(ticket_type: Column, priority: Column, queue: Column) -> Column:
    by_priority, by_type = F.lit(20), F.lit(0)
    for name, points in PRIORITY_POINTS.items():
        by_priority = F.when(F.upper(priority) == name, points).otherwise(by_priority)
    for name, points in TYPE_POINTS.items():
        by_type = F.when(F.lower(F.trim(ticket_type)) == name, points).otherwise(by_type)
    outage = F.when(F.lower(F.trim(queue)) == OUTAGE_QUEUE, 15).otherwise(0)
    return F.least(F.lit(100), by_priority + by_type + outage)


def recommendation(queue: Column, priority: Column) -> Column:
    """Advice sentence; empty or missing parts drop out of it."""
    # The sentences.
    has_queue, has_priority = F.coalesce(queue, F.lit("")) != "", F.coalesce(priority, F.lit("")) != ""
    return (
        F.when(
            has_queue & has_priority,
            F.format_string(
                "Assign the ticket to the %s team with %s priority and monitor the incident through its resolution lifecycle.",
                queue,
                priority,
            ),
        )
        .when(
            has_queue,
            F.format_string("Assign the ticket to the %s team and monitor the incident through its resolution lifecycle.", queue),
        )
        .when(has_priority, F.format_string("Handle the ticket with %s priority and monitor it through its resolution lifecycle.", priority))
        .otherwise("Review the ticket and assign it to the appropriate support team for resolution.")
    )


def routing_advice(queue: Column, priority: Column) -> Column:
    p = F.upper(priority)
    return (
        F.when(
            p == "HIGH",
            F.format_string(
                "Immediate attention recommended. Route the ticket to **%s** and prioritize investigation. "
                "Consider escalation to the responsible support team.",
                queue,
            ),
        )
        .when(
            p == "MEDIUM",
            F.format_string(
                "Assign the ticket to **%s**. Monitor the resolution process and ensure the issue is handled "
                "within the expected service level.",
                queue,
            ),
        )
        .otherwise(
            F.format_string(
                "Route the ticket to **%s** for standard processing. Resolution can follow the normal support workflow.", queue
            )
        )
    )


# The action texts of the support plan.
ESCALATE = "Escalader immediatement le ticket a l'equipe d'astreinte."
ACKNOWLEDGE = "Accuser reception du ticket et planifier son traitement."
COMPARE = "Comparer la solution proposee avec les tickets historiques similaires."
VALIDATE = "Demander une validation humaine avant toute action irreversible."


def action_plan(queue: Column, priority: Column, has_context: Column) -> Column:
    urgent = F.lower(priority).isin("high", "critical", "urgent")
    steps = F.array(
        F.when(urgent, ESCALATE).otherwise(ACKNOWLEDGE),
        F.concat(F.lit("Affecter le ticket a la file "), F.coalesce(queue, F.lit("support")), F.lit(".")),
        F.when(has_context, F.lit(COMPARE)),
        F.lit(VALIDATE),
    )
    return F.array_compact(steps)
