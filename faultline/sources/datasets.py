"""The library's input tables, derived from the given test tables.

Each derivation reads a whole table and exists twice: as a DataFrame and, in ``VIEWS``,
as the SQL the oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label domains of the ticket data.
TYPES = ["Incident", "Request", "Problem", "Change"]
PRIORITIES = ["high", "medium", "low"]
QUEUES = [
    "Technical Support",
    "Product Support",
    "Customer Service",
    "IT Support",
    "Billing and Payments",
    "Returns and Exchanges",
    "Service Outages and Maintenance",
    "Sales and Pre-Sales",
    "Human Resources",
    "General Inquiry",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("svc"), F.col("user_id") % 10).alias("service"),
    )


ERROR_TYPES = ["SERVER_ERROR", "ROUTING_ERROR", "HTTP_EXCEPTION", "DB_ERROR", "HTTP_ERROR"]
OTHER_TYPES = {"click": "INCOMING_REQUEST", "view": "DB_QUERY", "purchase": "ORDER", "signup": "LOGIN"}
CATEGORIES = ["HTTP", "DB", "AUTH", "SYSTEM"]


def ops_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: timestamp, event_type, category, severity, status, level, path, duration."""
    e, is_error = _events(spark, sf_dir), F.col("event_type") == "error"
    other = F.create_map(*[F.lit(x) for pair in OTHER_TYPES.items() for x in pair])
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        "service",
        F.when(is_error, _pick(ERROR_TYPES, F.col("k") % 5)).otherwise(other[F.col("event_type")]).alias("event_type"),
        _pick(CATEGORIES, F.col("k") % 4).alias("category"),
        F.when(is_error & (F.col("k") >= 50), "HIGH").when(F.col("k") < 20, "LOW").otherwise("MEDIUM").alias("severity"),
        F.when(is_error & (F.col("k") % 2 == 0), "FAILURE").otherwise("SUCCESS").alias("status"),
        F.when(is_error, "ERROR").otherwise("INFO").alias("level"),
        F.when(F.col("k") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/p"), F.col("k") % 13).alias("path"),
        F.when(F.col("k") % 17 != 0, F.col("value") * 10).alias("duration_ms"),
        F.when(is_error, F.lit(500) + F.col("k") % 4).otherwise(F.lit(200) + F.col("k") % 3).alias("status_code"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled log lines; label error or info."""
    is_error = F.col("event_type") == "error"
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("line_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        "ts",
        "service",
        F.concat(F.lit("host"), F.col("user_id") % 20).alias("host"),
        F.concat(F.lit("comp"), F.col("k") % 7).alias("source"),
        F.when(is_error, "error").otherwise("info").alias("label"),
        F.concat_ws(" ", "event_type", F.lit("code"), F.col("k")).alias("description"),
        F.when(is_error, F.concat(F.lit("E"), F.col("k") % 5)).alias("exception_type"),
        (F.col("value") / 100).alias("margin"),
    )


METRICS = {
    "click": ("docker_cpu_total", "cpu"),
    "view": ("docker_memory_usage", "memory"),
    "purchase": ("docker_network_in_errors", "network"),
    "signup": ("docker_diskio_summary", "disk_io"),
    "error": ("system_load_1", "load"),
}


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric series: (service, metric) is the series, label marks true anomalies."""
    names = F.create_map(*[F.lit(x) for k, (m, _) in METRICS.items() for x in (k, m)])
    groups = F.create_map(*[F.lit(x) for k, (_, g) in METRICS.items() for x in (k, g)])
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("point_id"),
        "service",
        names[F.col("event_type")].alias("metric"),
        groups[F.col("event_type")].alias("metric_group"),
        "ts",
        "value",
        F.when(F.col("k") >= 90, 1).otherwise(0).alias("label"),
    )


FAULT_TYPES = ["cpu_overload", "memory_leak", "login_failure", "file_moving"]


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault intervals: every error event opens one, k minutes long."""
    return (
        _events(spark, sf_dir)
        .filter(F.col("event_type") == "error")
        .select(
            F.col("event_id").alias("fault_id"),
            "service",
            _pick(FAULT_TYPES, F.col("k") % 4).alias("fault_type"),
            F.col("ts").alias("fault_start"),
            (F.col("ts") + F.make_dt_interval(mins=F.col("k"))).alias("fault_end"),
            (F.col("k") >= 95).alias("duration_suspicious"),
        )
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_tickets(table(spark, sf_dir, "documents"))


def as_tickets(d: DataFrame) -> DataFrame:
    """Raw tickets from documents: first line is the subject, the rest the body."""
    subject = F.substring_index("text", "\n", 1)
    by_language = F.create_map(*[F.lit(x) for pair in zip(["en", "fr", "de", "es"], TYPES) for x in pair])
    return d.select(
        "doc_id",
        subject.alias("subject"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"),
        F.concat(F.lit("Answered by "), "source").alias("answer"),
        by_language[F.col("lang")].alias("type"),
        _pick(QUEUES, F.substring("source", 4, 10).cast("int") % 10).alias("queue"),
        F.when(F.col("n_chars") < 800, "low").when(F.col("n_chars") < 2500, "medium").otherwise("high").alias("priority"),
        F.col("lang").alias("language"),
        F.col("source").alias("tag_1"),
        F.col("lang").alias("tag_2"),
        *[F.lit(None).cast("string").alias(f"tag_{i}") for i in range(3, 9)],
    )


def ticket_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted ticket labels with the evaluation columns the studies read."""
    at = lambda names, c, shift: _pick(names, (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)) - 1 + shift) % len(names))
    wrong = (F.col("doc_id") % 5 == 0).cast("int")
    return tickets(spark, sf_dir).select(
        "doc_id",
        "language",
        F.col("type").alias("true_type"),
        at(TYPES, "type", wrong).alias("predicted_type"),
        F.col("queue").alias("true_queue"),
        at(QUEUES, "queue", (F.col("doc_id") % 3) * (1 + F.col("doc_id") % 2)).alias("queue_from_predicted_type"),
        at(QUEUES, "queue", (F.col("doc_id") % 2)).alias("queue_from_true_type"),
        F.col("priority").alias("true_priority"),
        at(PRIORITIES, "priority", (F.col("doc_id") % 4 == 0).cast("int")).alias("predicted_priority"),
    )


def scored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary label with a score in [0, 1), for the threshold and AUC studies."""
    return _events(spark, sf_dir).select(
        "event_id",
        "service",
        "event_type",
        "ts",
        (F.col("k") >= 70).cast("int").alias("y"),
        F.round(F.col("value") / (F.col("value") + 50), 4).alias("score"),
        F.col("value"),
    )


_OTHER = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OTHER_TYPES.items())
_METRIC = " ".join(f"WHEN '{k}' THEN '{m}'" for k, (m, _) in METRICS.items())
_GROUP = " ".join(f"WHEN '{k}' THEN '{g}'" for k, (_, g) in METRICS.items())


def _shifted(names: list[str], column: str, shift: str) -> str:
    listed = _sql_list(names)
    return f"{listed}[CAST((list_position({listed}, {column}) - 1 + {shift}) % {len(names)} + 1 AS INTEGER)]"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        "SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, "
        "'svc' || (user_id % 10) AS service FROM events",
    ),
    "ops_events": (
        ("ev",),
        f"""SELECT event_id, ts AS "timestamp", service,
        CASE event_type WHEN 'error' THEN {_sql_list(ERROR_TYPES)}[k % 5 + 1] {_OTHER} END AS event_type,
        {_sql_list(CATEGORIES)}[k % 4 + 1] AS category,
        CASE WHEN event_type = 'error' AND k >= 50 THEN 'HIGH' WHEN k < 20 THEN 'LOW' ELSE 'MEDIUM' END AS severity,
        CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
        CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
        CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/p' || (k % 13) AS path,
        CASE WHEN k % 17 <> 0 THEN value * 10 END AS duration_ms,
        CASE WHEN event_type = 'error' THEN 500 + k % 4 ELSE 200 + k % 3 END AS status_code FROM ev""",
    ),
    "log_lines": (
        ("ev",),
        """SELECT event_id AS line_id, epoch_ms(ts) AS timestamp_ms, ts, service, 'host' || (user_id % 20) AS host,
        'comp' || (k % 7) AS source, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS label,
        event_type || ' code ' || k AS description,
        CASE WHEN event_type = 'error' THEN 'E' || (k % 5) END AS exception_type, value / 100 AS margin FROM ev""",
    ),
    "telemetry": (
        ("ev",),
        f"""SELECT event_id AS point_id, service, CASE event_type {_METRIC} END AS metric,
        CASE event_type {_GROUP} END AS metric_group, ts, value, CASE WHEN k >= 90 THEN 1 ELSE 0 END AS label FROM ev""",
    ),
    "faults": (
        ("ev",),
        f"""SELECT event_id AS fault_id, service, {_sql_list(FAULT_TYPES)}[k % 4 + 1] AS fault_type, ts AS fault_start,
        ts + to_minutes(k) AS fault_end, k >= 95 AS duration_suspicious FROM ev WHERE event_type = 'error'""",
    ),
    "tickets": (
        (),
        f"""SELECT doc_id, split_part(text, chr(10), 1) AS subject,
        substr(text, length(split_part(text, chr(10), 1)) + 2) AS body, 'Answered by ' || source AS answer,
        CASE lang WHEN 'en' THEN 'Incident' WHEN 'fr' THEN 'Request' WHEN 'de' THEN 'Problem' WHEN 'es' THEN 'Change' END AS "type",
        {_sql_list(QUEUES)}[CAST(substr(source, 4) AS INTEGER) % 10 + 1] AS queue,
        CASE WHEN n_chars < 800 THEN 'low' WHEN n_chars < 2500 THEN 'medium' ELSE 'high' END AS priority,
        lang AS "language", source AS tag_1, lang AS tag_2, NULL::VARCHAR AS tag_3, NULL::VARCHAR AS tag_4,
        NULL::VARCHAR AS tag_5, NULL::VARCHAR AS tag_6, NULL::VARCHAR AS tag_7, NULL::VARCHAR AS tag_8 FROM documents""",
    ),
    "ticket_predictions": (
        ("tickets",),
        f"""SELECT doc_id, "language", "type" AS true_type,
        {_shifted(TYPES, '"type"', "CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END")} AS predicted_type, queue AS true_queue,
        {_shifted(QUEUES, "queue", "(doc_id % 3) * (1 + doc_id % 2)")} AS queue_from_predicted_type,
        {_shifted(QUEUES, "queue", "(doc_id % 2)")} AS queue_from_true_type, priority AS true_priority,
        {_shifted(PRIORITIES, "priority", "CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END")} AS predicted_priority FROM tickets""",
    ),
    "scored_points": (
        ("ev",),
        """SELECT event_id, service, event_type, ts, CASE WHEN k >= 70 THEN 1 ELSE 0 END AS y,
        round(value / (value + 50), 4) AS score, value FROM ev""",
    ),
}


def with_views(body: str, *names: str, **extra: str) -> str:
    """SQL that starts from the named derived tables (and their own inputs)."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = [f'{n} AS ({VIEWS[n][1]})' for n in ordered] + [f"{n} AS ({text})" for n, text in extra.items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
