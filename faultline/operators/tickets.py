"""Ticket preparation, medallion tables and ticket analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.rules import TICKET_CUTS, level, recommendation, ticket_risk_score
from faultline.functions.text import clean_text
from faultline.operators.skew import range_numbered

COLUMNS = ["subject", "body", "answer", "type", "queue", "priority", "language"]
TAGS = [f"tag_{i}" for i in range(1, 9)]
#: Text of the rows that one task orders.
RANGE_BYTES = 64_000_000


def preprocess_tickets(df: DataFrame) -> DataFrame:
    """Cleaned ticket text; rows without subject and body, or without text, drop."""
    joined = F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    named = {c: F.coalesce(c, F.lit("Unknown")) for c in ("type", "queue", "priority", "language")}
    # Exploded, as a filter on the cleaned text would clean it once more.
    out = df.na.drop("all", subset=["subject", "body"]).withColumns(named).withColumn("ticket_text", F.explode(F.array(clean_text(joined))))
    keep = [c for c in df.columns if c not in {*COLUMNS, *TAGS}]
    return out.filter(F.length("ticket_text") > 0).select(*keep, "ticket_text", "type", "queue", "priority", "language", "answer")


def bronze_tickets(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS, *TAGS)


def _ranges(bronze: DataFrame) -> int:
    """Ranges of about RANGE_BYTES of text, at least one for every core."""
    size = bronze.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in [*COLUMNS, *TAGS]), F.lit(0)))).first()[0]
    return max(bronze.sparkSession.sparkContext.defaultParallelism, (size or 0) // RANGE_BYTES + 1)


def silver_tickets(bronze: DataFrame, dense_ids: bool = False) -> DataFrame:
    """Trimmed tickets with a text and an id. The default id is a row hash, which needs no
    order; ``dense_ids`` numbers the rows from 1 by all columns, missing values last, equal rows as they come."""
    trimmed = {c: F.trim(c) for c in [*COLUMNS, *TAGS]}
    if dense_ids:
        numbered = range_numbered(bronze.withColumn("_row", F.monotonically_increasing_id()), [*[F.col(c).asc_nulls_last() for c in [*COLUMNS, *TAGS]], F.col("_row")], "ticket_id", _ranges(bronze))
        numbered = numbered.withColumn("ticket_id", F.col("ticket_id") + 1).drop("_row")
    else:
        numbered = bronze.withColumn("ticket_id", F.xxhash64(*[F.col(c) for c in [*COLUMNS, *TAGS]]))
    out = numbered.withColumns(trimmed).withColumnRenamed("type", "ticket_type")
    return out.withColumn("ticket_text", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))))


def priority_counts() -> list:
    return [
        F.count(F.lit(1)).alias("total_tickets"),
        *[F.count_if(F.col("priority") == p).alias(p + "_priority_tickets") for p in ("high", "medium", "low")],
    ]


def ticket_analytics(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("type").alias("ticket_type"), "priority", "queue").agg(*priority_counts()).orderBy(
        F.col("total_tickets").desc(), "ticket_type", "priority", "queue"
    )


def rollup_tickets(df: DataFrame) -> DataFrame:
    """Totals by type, queue, priority and type x priority in one pass."""
    t, q, p = F.col("type"), F.col("queue"), F.col("priority")
    out = df.groupingSets([[t], [q], [p], [t, p]], t, q, p).agg(
        F.grouping_id().cast("int").alias("gid"), F.count(F.lit(1)).alias("total_tickets")
    )
    # grouping_id bits are (type, queue, priority); a set bit means rolled up.
    names = F.create_map(*[F.lit(x) for x in (3, "type", 5, "queue", 6, "priority", 2, "type_priority")])
    return out.select(names[F.col("gid")].alias("dimension"), "type", "queue", "priority", "total_tickets")


def history_stats(df: DataFrame) -> DataFrame:
    """Totals, the three distributions and the mean confidence of stored predictions."""
    t, q, p = F.col("ticket_type"), F.col("queue"), F.col("priority")
    out = df.groupingSets([[], [t], [p], [q]], t, p, q).agg(
        F.grouping_id().cast("int").alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("average_confidence")
    )
    names = F.create_map(*[F.lit(x) for x in (7, "total", 3, "type", 5, "priority", 6, "queue")])
    return out.select(names[F.col("gid")].alias("dimension"), F.coalesce(t, p, q).alias("label"), "n", "average_confidence")


def filter_analytics(df: DataFrame, types: list[str] = (), priorities: list[str] = (), queues: list[str] = ()) -> DataFrame:
    """KPI totals of the tickets that pass the chosen filters (an empty choice passes all)."""
    for column, chosen in (("type", types), ("priority", priorities), ("queue", queues)):
        if chosen:
            df = df.filter(F.col(column).isin(list(chosen)))
    return df.agg(*priority_counts())


def gold_predictions(df: DataFrame) -> DataFrame:
    return df.select("ticket_id", "ticket_text", "type", "priority", "queue", "created_at")


def ticket_risk(df: DataFrame) -> DataFrame:
    """Rule-based risk, level, escalation flag and advice of every ticket."""
    scored = df.withColumn("risk_points", ticket_risk_score(F.col("type"), F.col("priority"), F.col("queue")))
    return scored.withColumns(
        {
            "risk_level": level(F.col("risk_points"), TICKET_CUTS, "LOW"),
            "escalation": F.col("risk_points") >= 70,
            "recommendation": recommendation(F.col("queue"), F.col("priority")),
        }
    )
