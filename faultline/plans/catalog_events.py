"""Queries over the event log: signals, windows, anomalies, incidents, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import timefn
from faultline.functions.rules import ALERT_CUTS, SEVERE_REASONS, prob_level
from faultline.operators import events as ev
from faultline.operators import incidents as inc
from faultline.operators import risk
from faultline.operators.quantiles import quantiles_by
from faultline.plans.registry import big, query, rnd, rounded
from faultline.session import materialize
from faultline.sources import datasets as ds
from faultline.sources.datasets import with_views

SIGNALS_SQL = """SELECT *,
 CASE WHEN status = 'FAILURE' OR event_type IN ('SERVER_ERROR','ROUTING_ERROR','HTTP_EXCEPTION','DB_ERROR','HTTP_ERROR') OR level = 'ERROR' THEN 1 ELSE 0 END AS failure_signal,
 CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END AS high_severity_signal,
 CASE WHEN event_type = 'SERVER_ERROR' THEN 1 ELSE 0 END AS server_error_signal,
 CASE WHEN event_type = 'ROUTING_ERROR' THEN 1 ELSE 0 END AS routing_error_signal,
 CASE WHEN event_type = 'DB_ERROR' THEN 1 ELSE 0 END AS db_error_signal,
 CASE WHEN event_type IN ('HTTP_ERROR','HTTP_EXCEPTION') THEN 1 ELSE 0 END AS http_error_signal,
 CASE WHEN event_type = 'INCOMING_REQUEST' THEN 1 ELSE 0 END AS http_request_signal,
 CASE WHEN event_type = 'DB_QUERY' THEN 1 ELSE 0 END AS db_query_signal,
 CASE WHEN duration_ms > 100 THEN 1 ELSE 0 END AS slow_100ms,
 CASE WHEN duration_ms > 500 THEN 1 ELSE 0 END AS slow_500ms,
 CASE WHEN duration_ms > 1000 THEN 1 ELSE 0 END AS slow_1000ms FROM ops_events"""

COUNTS = "failure_count high_severity_count server_error_count routing_error_count db_error_count http_error_count http_request_count db_query_count slow_100ms_count slow_500ms_count slow_1000ms_count"


def windows_sql(interval: str) -> str:
    sums = ", ".join(f"CAST(sum({s}) AS BIGINT) AS {n}" for n, s in ev.SIGNAL_COUNTS.items())
    return f"""SELECT *, failure_count / raw_row_count AS failure_rate, high_severity_count / raw_row_count AS high_severity_rate,
 (server_error_count + routing_error_count + db_error_count + http_error_count) / raw_row_count AS error_density,
 CAST(hour(window_start) AS INTEGER) AS "hour", CAST(minute(window_start) AS INTEGER) AS "minute", CAST(isodow(window_start) - 1 AS INTEGER) AS day_of_week, dayname(window_start) AS day_name FROM (
 SELECT service, time_bucket(INTERVAL '{interval}', "timestamp") AS window_start, count(*) AS event_count, count(*) AS raw_row_count, {sums},
 coalesce(avg(duration_ms), 0) AS avg_duration_ms, coalesce(max(duration_ms), 0) AS max_duration_ms,
 coalesce(quantile_cont(duration_ms, 0.95), 0) AS p95_duration_ms, count(DISTINCT path) AS unique_paths,
 count(DISTINCT event_type) AS unique_event_types, count(DISTINCT category) AS unique_categories, count(DISTINCT severity) AS unique_severities
 FROM sig GROUP BY 1, 2)"""


SCORED_SQL = "SELECT *, 0.5 * error_density + 0.5 * high_severity_rate - 0.1 AS anomaly_score, 0.5 * error_density + 0.5 * high_severity_rate - 0.1 > 0.3 AS is_anomaly FROM w60"
Q90_SQL = ", ".join(f"(SELECT quantile_cont({c}, 0.9) FROM scored) AS q_{c}" for c in [*inc.SEVERE, "unique_event_types"])
SIGNAL_SQL = f"""SELECT *, (CAST(event_count >= q_event_count AS INTEGER) + CAST(avg_duration_ms >= q_avg_duration_ms AS INTEGER) + CAST(p95_duration_ms >= q_p95_duration_ms AS INTEGER)
 + CAST(high_severity_rate >= q_high_severity_rate AS INTEGER) + CAST(error_density >= q_error_density AS INTEGER)) AS severe_signal_count FROM (SELECT *, {Q90_SQL} FROM scored)"""
INCIDENT_SIGNAL_SQL = "SELECT *, is_anomaly OR severe_signal_count >= 2 AS incident_signal FROM signals"
EPISODE_SQL = """SELECT *, CAST(sum(CASE WHEN p IS NULL OR window_start - p > INTERVAL '60 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY window_start) AS BIGINT) AS incident_id
 FROM (SELECT *, lag(window_start) OVER (PARTITION BY service ORDER BY window_start) AS p FROM flagged WHERE incident_signal)"""
SUMMARY_SQL = """SELECT service, incident_id, min(window_start) AS incident_start, max(window_start) AS incident_end, count(*) AS duration_windows,
 CAST(sum(CAST(is_anomaly AS INTEGER)) AS BIGINT) AS anomalous_windows, max(anomaly_score) AS max_anomaly_score, max(event_count) AS max_event_count, max(avg_duration_ms) AS max_avg_duration_ms,
 max(p95_duration_ms) AS max_p95_duration_ms, max(high_severity_rate) AS max_high_severity_rate, max(error_density) AS max_error_density, max(failure_rate) AS max_failure_rate,
 max(severe_signal_count) AS max_severe_signal_count, date_diff('microsecond', min(window_start), max(window_start)) / 60000000.0 + 60 AS duration_minutes,
 any_value(q_event_count) AS q_event_count, any_value(q_avg_duration_ms) AS q_avg_duration_ms, any_value(q_p95_duration_ms) AS q_p95_duration_ms,
 any_value(q_high_severity_rate) AS q_high_severity_rate, any_value(q_error_density) AS q_error_density FROM episodes GROUP BY service, incident_id"""
CLASS_SQL = """SELECT *, CASE WHEN max_anomaly_score >= 0.10 OR max_severe_signal_count >= 4 THEN 'CRITICAL' WHEN max_anomaly_score >= 0.02 OR max_severe_signal_count >= 3 THEN 'HIGH'
 WHEN max_severe_signal_count >= 2 OR anomalous_windows >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS incident_severity,
 CASE WHEN max_p95_duration_ms >= q_p95_duration_ms THEN 'LATENCY_ANOMALY' WHEN max_event_count >= q_event_count THEN 'TRAFFIC_OR_VOLUME_ANOMALY'
 WHEN max_error_density >= q_error_density THEN 'ERROR_DENSITY_ANOMALY' WHEN max_high_severity_rate >= q_high_severity_rate THEN 'HIGH_SEVERITY_ANOMALY' ELSE 'MULTIVARIATE_ANOMALY' END AS incident_type,
 coalesce(nullif(concat_ws('; ', CASE WHEN anomalous_windows > 0 THEN anomalous_windows || ' anomaly window(s)' END, CASE WHEN max_event_count >= q_event_count THEN 'unusual event volume' END,
 CASE WHEN max_avg_duration_ms >= q_avg_duration_ms THEN 'high average latency' END, CASE WHEN max_p95_duration_ms >= q_p95_duration_ms THEN 'high P95 latency' END,
 CASE WHEN max_error_density >= q_error_density THEN 'high error density' END, CASE WHEN max_high_severity_rate >= q_high_severity_rate THEN 'high severity concentration' END), ''), 'multivariate operational anomaly') AS incident_reason FROM summary"""

CHAIN = {
    "sig": SIGNALS_SQL,
    "w60": windows_sql("60 minutes"),
    "scored": SCORED_SQL,
    "signals": SIGNAL_SQL,
    "flagged": INCIDENT_SIGNAL_SQL,
    "episodes": EPISODE_SQL,
    "summary": SUMMARY_SQL,
    "classed": CLASS_SQL,
}


def chain_sql(body: str, upto: str, **extra: str) -> str:
    names = list(CHAIN)
    return with_views(body, "ops_events", **{n: CHAIN[n] for n in names[: names.index(upto) + 1]}, **extra)


KEYS = ["service"]


def scored_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows per service with a simple severity score in place of a model."""
    w = ev.event_windows(ds.ops_events(spark, d), KEYS, "60 minutes")
    score = 0.5 * F.col("error_density") + 0.5 * F.col("high_severity_rate") - 0.1
    return w.withColumns({"anomaly_score": score, "is_anomaly": score > 0.3})


def incident_chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict]:
    """Windows are materialized once: thresholds, signals and episodes all read them."""
    windows = materialize(scored_windows(spark, d))
    q90 = inc.one_row(inc.quantile_thresholds(windows, inc.SEVERE))
    flagged = inc.incident_signals(windows, q90)
    return flagged, inc.incident_episodes(flagged, KEYS, 60), q90


def classed_incidents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    flagged, episodes, q90 = incident_chain(spark, d)
    return flagged, episodes, inc.incident_class(inc.incident_summary(episodes, KEYS, 60), q90)


@query("b06_event_signals", with_views("SELECT event_id, failure_signal, high_severity_signal, server_error_signal, routing_error_signal, db_error_signal, http_error_signal, http_request_signal, db_query_signal FROM sig", "ops_events", sig=SIGNALS_SQL))
def _(spark, d):
    return ev.event_signals(ds.ops_events(spark, d)).select("event_id", *[c for c in ev.SIGNAL_COUNTS.values() if not c.startswith("slow")])


@query("b07_latency_flags", with_views("SELECT event_id, slow_100ms, slow_500ms, slow_1000ms FROM sig", "ops_events", sig=SIGNALS_SQL))
def _(spark, d):
    return ev.event_signals(ds.ops_events(spark, d)).select("event_id", "slow_100ms", "slow_500ms", "slow_1000ms")


@query(
    "b08_failure_mask",
    with_views(
        "SELECT service, count(*) AS failures FROM ops_events WHERE regexp_matches(lower(event_type || ' ' || level), "
        "'failure|failed|error|critical|exception|timeout|crash|fatal|server_error|5xx') OR status_code >= 500 GROUP BY service",
        "ops_events",
    ),
)
def _(spark, d):
    e = ds.ops_events(spark, d)
    return e.filter(ev.failure_mask(F.concat_ws(" ", "event_type", "level"), F.col("status_code"))).groupBy("service").agg(F.count(F.lit(1)).alias("failures"))


W_COLS = f"""service, window_start, event_count, raw_row_count, {COUNTS.replace(' ', ', ')}, {rnd('avg_duration_ms, max_duration_ms, p95_duration_ms, failure_rate, high_severity_rate, error_density')},
 unique_paths, unique_event_types, unique_categories, unique_severities, "hour", "minute", day_of_week, day_name"""


@query("d04_event_windows", with_views(f"SELECT {W_COLS} FROM w1", "ops_events", sig=SIGNALS_SQL, w1=windows_sql("1 minute")))
def _(spark, d):
    return rounded(ev.event_windows(ds.ops_events(spark, d), KEYS, "1 minute"))


@query("d05_window_p95", with_views(f"SELECT service, window_start, {rnd('p95_duration_ms')} FROM w5", "ops_events", sig=SIGNALS_SQL, w5=windows_sql("5 minutes")))
def _(spark, d):
    e = ds.ops_events(spark, d).withColumn("window_start", timefn.floor_to(F.col("timestamp"), "5 minutes"))
    p = quantiles_by(e, ["service", "window_start"], {"p95_duration_ms": ("duration_ms", 0.95)})
    return rounded(p.withColumn("p95_duration_ms", F.coalesce("p95_duration_ms", F.lit(0.0))))


@query("d06_window_distincts", with_views("SELECT service, window_start, unique_paths, unique_event_types, unique_categories, unique_severities FROM w60", "ops_events", sig=SIGNALS_SQL, w60=windows_sql("60 minutes")))
def _(spark, d):
    e = ev.prepare(ds.ops_events(spark, d)).withColumn("window_start", timefn.floor_to(F.col("timestamp"), "60 minutes"))
    return e.groupBy("service", "window_start").agg(*[F.count_distinct(c).alias(n) for n, c in ev.DISTINCTS.items()])


@query(
    "d07_window_granularity",
    with_views(
        f"""SELECT window_minutes, windows, {big('windows_without_failure, windows_with_failure')}, {rnd('failure_window_rate, mean_events, median_events')}, max_events,
 {rnd('mean_failure_rate, max_failure_rate, mean_latency, max_latency')}, CAST(score AS BIGINT) AS score,
 coalesce(window_minutes = (SELECT window_minutes FROM st WHERE score IS NOT NULL ORDER BY score DESC, windows DESC LIMIT 1), false) AS recommended FROM st""",
        "ops_events",
        sig=SIGNALS_SQL,
        g="""SELECT window_minutes, count(*) AS n, sum(failure_signal) AS f, avg(duration_ms) AS lat, max(duration_ms) AS mx
 FROM (SELECT *, unnest([1, 2, 5, 10, 15]) AS window_minutes FROM sig) GROUP BY window_minutes, floor(epoch_us("timestamp") / (window_minutes * 60000000))""",
        st="""SELECT *, CASE WHEN windows >= 20 AND windows_without_failure > 0 AND windows_with_failure > 0 THEN 2 * windows_without_failure + windows_with_failure END AS score FROM (
 SELECT window_minutes, count(*) AS windows, sum(CASE WHEN f = 0 THEN 1 ELSE 0 END) AS windows_without_failure, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS windows_with_failure,
 avg(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS failure_window_rate, avg(n) AS mean_events, quantile_cont(n, 0.5) AS median_events, max(n) AS max_events,
 avg(f / n) AS mean_failure_rate, max(f / n) AS max_failure_rate, avg(lat) AS mean_latency, max(mx) AS max_latency FROM g GROUP BY window_minutes)""",
    ),
)
def _(spark, d):
    return rounded(ev.window_granularity(ds.ops_events(spark, d), [1, 2, 5, 10, 15]))


@query("d18_quantile_thresholds", chain_sql(f"SELECT {', '.join(f'round(quantile_cont({c}, 0.9), 6) AS {c}' for c in inc.SEVERE)} FROM scored", "scored"))
def _(spark, d):
    return rounded(inc.quantile_thresholds(scored_windows(spark, d), inc.SEVERE))


REASON_SQL = "coalesce(nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {c} > q_{c} THEN '{t}' END" for c, t in SEVERE_REASONS) + "), ''), 'multivariate behavioral anomaly')"


@query(
    "f01_f02_anomaly_levels_and_reasons",
    chain_sql(
        f"""SELECT service, window_start, {rnd('anomaly_score_normalized')}, CASE WHEN anomaly_score_normalized >= 0.8 THEN 'CRITICAL' WHEN anomaly_score_normalized >= 0.6 THEN 'HIGH'
 WHEN anomaly_score_normalized >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS anomaly_level, {REASON_SQL} AS anomaly_reason, anomaly_rank FROM (SELECT *,
 (anomaly_score - min(anomaly_score) OVER ()) / (max(anomaly_score) OVER () - min(anomaly_score) OVER ()) AS anomaly_score_normalized, rank() OVER (ORDER BY anomaly_score DESC) AS anomaly_rank FROM signals)""",
        "signals",
    ),
)
def _(spark, d):
    described = inc.describe_anomalies(materialize(scored_windows(spark, d)))
    return rounded(described.select("service", "window_start", "anomaly_score_normalized", "anomaly_level", "anomaly_reason", "anomaly_rank"))


@query("f04_incident_signals", chain_sql("SELECT service, window_start, is_anomaly, severe_signal_count, incident_signal FROM flagged", "flagged"))
def _(spark, d):
    return incident_chain(spark, d)[0].select("service", "window_start", "is_anomaly", "severe_signal_count", "incident_signal")


@query("e11_sessionize", with_views("""SELECT event_id, user_id, CAST(sum(CASE WHEN p IS NULL OR ts - p > INTERVAL '5 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_id
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"""))
def _(spark, d):
    return inc.sessionize(ds.table(spark, d, "events"), ["user_id"], "ts", 5, ["event_id"]).select("event_id", "user_id", "session_id")


@query("e11_sessionize_global", with_views("""SELECT event_id, CAST(sum(CASE WHEN p IS NULL OR ts - p > INTERVAL '5 minutes' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS BIGINT) AS session_id
 FROM (SELECT *, lag(ts) OVER (ORDER BY ts, event_id) AS p FROM events)"""))
def _(spark, d):
    return inc.sessionize(ds.table(spark, d, "events"), [], "ts", 5, ["event_id"]).select("event_id", "session_id")


S_COLS = f"service, incident_id, incident_start, incident_end, duration_windows, anomalous_windows, {rnd('max_anomaly_score')}, max_event_count, {rnd('max_avg_duration_ms, max_p95_duration_ms, max_high_severity_rate, max_error_density, max_failure_rate')}, max_severe_signal_count, {rnd('duration_minutes')}"


@query("d13_incident_summary", chain_sql(f"SELECT {S_COLS} FROM summary", "summary"))
def _(spark, d):
    return rounded(inc.incident_summary(incident_chain(spark, d)[1], KEYS, 60))


@query("f05_incident_class", chain_sql("SELECT service, incident_id, incident_severity, incident_type, incident_reason FROM classed", "classed"))
def _(spark, d):
    return classed_incidents(spark, d)[2].select("service", "incident_id", "incident_severity", "incident_type", "incident_reason")


@query("c03_attach_summary", chain_sql("SELECT e.service, e.window_start, e.incident_id, c.incident_start, c.incident_end, c.incident_severity, c.incident_type FROM episodes e LEFT JOIN classed c ON e.service = c.service AND e.incident_id = c.incident_id", "classed"))
def _(spark, d):
    _, episodes, classed = classed_incidents(spark, d)
    return inc.attach_summary(episodes, classed, KEYS).select("service", "window_start", "incident_id", "incident_start", "incident_end", "incident_severity", "incident_type")


@query(
    "e17_minmax",
    chain_sql("SELECT service, window_start, round((event_count - min(event_count) OVER ()) / (max(event_count) OVER () - min(event_count) OVER ()) * 100.0, 6) AS event_count_100, round((error_density - min(error_density) OVER ()) / (max(error_density) OVER () - min(error_density) OVER ()) * 100.0, 6) AS error_density_100, 0.0 AS constant_100 FROM w60", "w60"),
)
def _(spark, d):
    w = materialize(ev.event_windows(ds.ops_events(spark, d), KEYS, "60 minutes"))
    s = inc.minmax(w, {"event_count_100": F.col("event_count"), "error_density_100": F.col("error_density"), "constant_100": F.lit(3.0)}, 100.0)
    return rounded(w.select("service", "window_start", *[c.cast("double").alias(n) for n, c in s.items()]))


@query(
    "e18_percentile_score",
    chain_sql("SELECT service, window_start, round(least(100.0, greatest(0.0, p95_duration_ms / (SELECT quantile_cont(p95_duration_ms, 0.9) FROM w60) * 100)), 6) AS p95_score FROM w60", "w60"),
)
def _(spark, d):
    w = materialize(ev.event_windows(ds.ops_events(spark, d), KEYS, "60 minutes"))
    return rounded(w.select("service", "window_start", risk.percentile_score(w, ["p95_duration_ms"])["p95_duration_ms"].alias("p95_score")))


@query("e19_rank_desc", with_views("SELECT event_id, rank() OVER (ORDER BY value DESC) AS value_rank, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS user_rank FROM events"))
def _(spark, d):
    e = ds.table(spark, d, "events").select("event_id", "user_id", "value")
    return inc.rank_desc(inc.rank_desc(e, "value", "value_rank"), "value", "user_rank", ["user_id"]).drop("user_id", "value")


RISK_SQL = {
    "f": """SELECT *, event_count - coalesce(lag(event_count) OVER o, event_count) AS event_count_delta, avg_duration_ms - coalesce(lag(avg_duration_ms) OVER o, avg_duration_ms) AS avg_latency_delta,
 p95_duration_ms - coalesce(lag(p95_duration_ms) OVER o, p95_duration_ms) AS p95_latency_delta, error_density - coalesce(lag(error_density) OVER o, error_density) AS error_density_delta,
 coalesce(lag(anomaly_score, 2) OVER o, 0) AS anomaly_score_lag_2, coalesce(lag(event_count, 3) OVER o, 0) AS event_count_lag_3, avg(event_count) OVER r AS event_count_rolling_3,
 sum(CAST(is_anomaly AS INTEGER)) OVER r AS anomaly_persistence_3 FROM scored
 WINDOW o AS (PARTITION BY service ORDER BY window_start), r AS (PARTITION BY service ORDER BY window_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "m": """SELECT min(anomaly_score) AS a0, max(anomaly_score) AS a1, min(greatest(event_count_delta, 0)) AS e0, max(greatest(event_count_delta, 0)) AS e1, min(greatest(p95_latency_delta, 0)) AS l0, max(greatest(p95_latency_delta, 0)) AS l1,
 min(greatest(error_density_delta, 0)) AS d0, max(greatest(error_density_delta, 0)) AS d1, quantile_cont(event_count, 0.9) AS qe, quantile_cont(p95_duration_ms, 0.9) AS qp FROM f""",
    "rs": """SELECT f.*, qe, qp, round(least(100, greatest(0, 0.25 * least(100, greatest(0, 0.60 * (anomaly_score - a0) / (a1 - a0) * 100 + 0.40 * CAST(is_anomaly AS INTEGER) * 100))
 + 0.20 * least(100, anomaly_persistence_3 / 3 * 100) + 0.15 * least(100, greatest(0, event_count / qe * 100)) + 0.15 * least(100, greatest(0, p95_duration_ms / qp * 100))
 + 0.10 * least(100, error_density * 100) + 0.05 * least(100, high_severity_rate * 100) + 0.05 * (greatest(event_count_delta, 0) - e0) / (e1 - e0) * 100
 + 0.03 * (greatest(p95_latency_delta, 0) - l0) / (l1 - l0) * 100 + 0.02 * (greatest(error_density_delta, 0) - d0) / (d1 - d0) * 100)), 6) AS risk_score FROM f CROSS JOIN m""",
}
RISK_LEVEL_SQL = "CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
FUTURE_SQL = """SELECT r.*, EXISTS (SELECT 1 FROM summary s WHERE s.service = r.service AND r.window_start BETWEEN s.incident_start AND s.incident_end) AS incident_now,
 (SELECT min(incident_start) FROM summary s WHERE s.service = r.service AND s.incident_start > r.window_start) AS nxt FROM rs r"""


@query(
    "f09_risk_score",
    chain_sql(
        f"""SELECT service, window_start, risk_score, {RISK_LEVEL_SQL} AS risk_level, rank() OVER (ORDER BY risk_score DESC) AS risk_rank, coalesce(nullif(concat_ws('; ', CASE WHEN is_anomaly THEN 'anomaly signal' END,
 CASE WHEN anomaly_persistence_3 >= 2 THEN 'persistent anomaly activity' END, CASE WHEN event_count >= qe THEN 'unusual event volume' END, CASE WHEN p95_duration_ms >= qp THEN 'high P95 latency' END,
 CASE WHEN error_density >= 0.30 THEN 'high error density' END, CASE WHEN high_severity_rate >= 0.15 THEN 'high severity concentration' END, CASE WHEN event_count_delta > 0 THEN 'increasing event volume' END,
 CASE WHEN p95_latency_delta > 0 THEN 'increasing latency' END), ''), 'normal multivariate behavior') AS risk_reason FROM rs""",
        "scored",
        **RISK_SQL,
    ),
)
def _(spark, d):
    features = materialize(risk.risk_features(scored_windows(spark, d), KEYS))
    return risk.risk_score(features).select("service", "window_start", "risk_score", "risk_level", "risk_rank", "risk_reason")


@query("e01_e20_risk_features", chain_sql(f"SELECT service, window_start, {rnd('anomaly_score_lag_2, avg_latency_delta, p95_latency_delta, error_density_delta, event_count_rolling_3')}, CAST(event_count_lag_3 AS DOUBLE) AS event_count_lag_3, event_count_delta, CAST(anomaly_persistence_3 AS BIGINT) AS anomaly_persistence_3 FROM f", "scored", f=RISK_SQL["f"]))
def _(spark, d):
    f = risk.risk_features(scored_windows(spark, d), KEYS)
    return rounded(f.select("service", "window_start", "anomaly_score_lag_2", "avg_latency_delta", "p95_latency_delta", "error_density_delta", "event_count_rolling_3", "event_count_lag_3", "event_count_delta", "anomaly_persistence_3"))


@query(
    "c06_early_warnings",
    chain_sql(
        """SELECT service, window_start, incident_now, NOT incident_now AND coalesce(nxt - window_start <= INTERVAL '180 minutes', false) AS future_incident,
 NOT incident_now AND coalesce(nxt - window_start <= INTERVAL '180 minutes', false) AND risk_score >= 40 AS early_warning, NOT incident_now AND coalesce(nxt - window_start <= INTERVAL '180 minutes', false) AND risk_score >= 60 AS high_risk_warning FROM fu""",
        "summary",
        **RISK_SQL,
        fu=FUTURE_SQL,
    ),
)
def _(spark, d):
    flagged, episodes, _ = incident_chain(spark, d)
    scored = risk.risk_score(materialize(risk.risk_features(flagged, KEYS)), rank=False)
    summary = inc.incident_summary(episodes, KEYS, 60)
    found = risk.early_warnings(risk.future_incidents(scored, summary, KEYS, 180))
    return found.select("service", "window_start", "incident_now", "future_incident", "early_warning", "high_risk_warning")


@query("f12_probability_level", with_views("SELECT event_id, CASE WHEN score >= 0.75 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN score >= 0.25 THEN 'HIGH' WHEN score >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS alert_level FROM scored_points", "scored_points"))
def _(spark, d):
    s = ds.scored_points(spark, d)
    return s.select("event_id", prob_level(F.col("score")).alias("level"), prob_level(F.col("score"), ALERT_CUTS).alias("alert_level"))


@query("e23_calendar", with_views("""SELECT event_id, CAST(hour(ts) AS INTEGER) AS "hour", CAST(minute(ts) AS INTEGER) AS "minute", CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(day(ts) AS INTEGER) AS day_of_month,
 CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, dayname(ts) AS day_name, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos FROM events"""))
def _(spark, d):
    return rounded(ds.table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in timefn.calendar(F.col("ts")).items()]))

