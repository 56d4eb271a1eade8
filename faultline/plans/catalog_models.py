"""Queries that train and apply models, and the streaming jobs run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.rules import ALERT_CUTS, prob_level
from faultline.operators import incidents as inc
from faultline.operators import logs as lg
from faultline.operators import ml
from faultline.operators import temporal_joins as tj
from faultline.operators import tickets as tk
from faultline.operators import timeseries as tsr
from faultline.operators.events import event_windows
from faultline.operators.evaluation import auc, average_precision
from faultline.operators.iforest import IsolationForest
from faultline.plans.catalog_events import scored_windows
from faultline.plans.catalog_series import HOUR_SQL, SERIES, anomalous_log_windows, hourly
from faultline.plans.registry import query, rounded
from faultline.session import materialize, spread
from faultline.sources import datasets as ds
from faultline.sources.datasets import with_views

def prepared(spark, d):
    return materialize(tk.preprocess_tickets(ds.as_tickets(spread(ds.table(spark, d, "documents")))))


def split(spark, d):
    p = prepared(spark, d)
    # As many parts as the texts were read in: the planner would merge them to fewer than there are cores.
    s = materialize(ml.stratified_split(p, ["type", "queue", "priority"], "doc_id").repartition(max(p.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)))
    return s.filter("split = 'train'").drop("split"), s.filter("split = 'test'").drop("split")


_fitted: dict[tuple, object] = {}


def kept(spark, d, name, fit):
    """A model of the application: fitted once for each folder, then shared by the queries that use it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _fitted:
        _fitted[key] = fit(spark, d)
    return _fitted[key]


@query("g04_stratified_split", with_views('SELECT "type", CAST(n - t AS BIGINT) AS train_rows, CAST(t AS BIGINT) AS test_rows FROM (SELECT "type", count(*) AS n, round(count(*) * 0.2) AS t FROM tickets GROUP BY 1)', "tickets"))
def _(spark, d):
    s = ml.stratified_split(ds.tickets(spark, d).select("doc_id", "type"), ["type"], "doc_id")
    return s.groupBy("type").agg(F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "test").alias("test_rows"))


@query("g05_class_weights", with_views('SELECT queue, count(*) AS n, round((SELECT count(*) FROM tickets) / ((SELECT count(DISTINCT queue) FROM tickets) * count(*)), 6) AS weight FROM tickets GROUP BY queue', "tickets"))
def _(spark, d):
    return rounded(ml.class_weights(ds.tickets(spark, d), "queue"))


# Rows of the test part: a fifth of every combination of labels, or of every type where some combination has one row.
TEST_SQL = """SELECT CAST(CASE WHEN (SELECT min(n) FROM by_all) >= 2 THEN (SELECT sum(round(n * 0.2)) FROM by_all) ELSE (SELECT sum(round(n * 0.2)) FROM by_type) END AS BIGINT) AS n"""
SPLIT_SQL = dict(by_all='SELECT count(*) AS n FROM tickets GROUP BY "type", queue, priority', by_type='SELECT count(*) AS n FROM tickets GROUP BY "type"', ts=TEST_SQL)


def quality_sql(*models: str) -> str:
    """A row for each model: its test rows, and that it is as good as asked."""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS model, n AS rows, true AS fits, true AS predicts FROM ts" for m in models)
    return with_views(rows, "tickets", **SPLIT_SQL)


def quality(model, train, test, label, name, fits, predicts):
    """Test rows, and whether the accuracies on the rows of the fit and on the test rows reach the given minima."""
    at_least = lambda rows, least: ml.evaluate(model.transform(rows, "predicted"), label, "predicted", name).select("model", "rows", (F.col("accuracy") >= least).alias("good"))
    known = at_least(train, fits).select("model", F.col("good").alias("fits"))
    return at_least(test, predicts).withColumnRenamed("good", "predicts").join(known, "model").select("model", "rows", "fits", "predicts")


@query("g06_type_classifier", quality_sql("type_svc"))
def _(spark, d):
    """The type follows from the language, so it can be learned."""
    train, test = split(spark, d)
    return quality(ml.train_type(train), train, test, "type", "type_svc", 0.99, 0.9)


@query("g07_queue_classifiers", quality_sql("v4", "A", "B", "C", "D"))
def _(spark, d):
    """The queue of the test tickets has nothing to do with their text: known rows must be learned, new ones cannot be told."""
    train, test = split(spark, d)
    counts, out = ml.shared_counts(train, characters=True), None
    for variant in ml.QUEUE_VARIANTS:
        row = quality(ml.train_queue(train, variant, counts=counts), train, test, "queue", variant, 0.8, 0.0)
        out = row if out is None else out.unionByName(row)
    return out


@query("g07_queue_reports")
def _(spark, d):
    """The variants' figures on the test rows."""
    train, test = split(spark, d)
    counts, out = ml.shared_counts(train, characters=True), None
    for variant in ml.QUEUE_VARIANTS:
        row = ml.evaluate(ml.train_queue(train, variant, counts=counts).transform(test, "predicted"), "queue", "predicted", variant)
        out = row if out is None else out.unionByName(row)
    return out


@query("g08_priority_classifier", quality_sql("priority_svc"))
def _(spark, d):
    """The priority follows from the length of the text: better than the largest class's share by words alone."""
    train, test = split(spark, d)
    return quality(ml.train_priority(train), train, test, "priority", "priority_svc", 0.9, 0.34)


# Fixed values are in datasets.py: the labels a ticket may have.
LABELS_SQL = with_views(
    'SELECT t.n AS tickets, true AS types_known, true AS queues_known, true AS priorities_known, true AS type_predicted FROM ts t', "tickets", **SPLIT_SQL
)


def cascade(spark, d):
    """Fitted type, queue (v4) and priority models, and the test tickets."""
    train, test = split(spark, d)
    counts = ml.shared_counts(train)
    return {"type": ml.train_type(train, counts=counts), "queue": ml.train_queue(train, "v4", counts=counts), "priority": ml.train_priority(train, counts=counts)}, test


@query("g03_g09_predict_tickets")
def _(spark, d):
    models, test = kept(spark, d, "cascade", cascade)
    return ml.predict_tickets(test, models).select("doc_id", "type", "queue", "priority")


@query("g09_cascade_labels", LABELS_SQL)
def _(spark, d):
    """Every test ticket gets one known label of each kind; the type, which can be learned, is right for nine of ten."""
    models, test = kept(spark, d, "cascade", cascade)
    found = ml.predict_tickets(test, models).select("doc_id", F.col("type").alias("p"), F.col("queue").alias("q"), F.col("priority").alias("r"))
    both = found.join(test.select("doc_id", "type"), "doc_id")
    known = lambda c, names: F.coalesce(F.every(F.col(c).isin(names)), F.lit(False))
    return both.agg(
        F.count(F.lit(1)).alias("tickets"), known("p", ds.TYPES).alias("types_known"), known("q", ds.QUEUES).alias("queues_known"),
        known("r", [x.upper() for x in ds.PRIORITIES]).alias("priorities_known"), (F.avg((F.col("p") == F.col("type")).cast("int")) >= 0.9).alias("type_predicted"),
    )


@query("g10_compare_models")
def _(spark, d):
    train, test = split(spark, d)
    # All 30,000 terms for the linear models; trees need a number for every term and row.
    return ml.compare_models(train, test, "type", ["svc", "logistic", "forest", "boosted"], {"svc": 30_000, "logistic": 30_000, "forest": 1_000, "boosted": 1_000})


@query("g11_benchmark")
def _(spark, d):
    p = prepared(spark, d)
    return ml.benchmark({"short": p.filter("priority <> 'high'"), "long": p.filter("priority <> 'low'")}, "type", "doc_id")


@query("g12_log_semantic", with_views("SELECT label, count(*) AS rows, sum(CASE WHEN label = 'error' THEN 1 ELSE 0 END)::BIGINT AS flagged FROM log_lines GROUP BY label", "log_lines"))
def _(spark, d):
    """Error lines name their event, so all of them and no others are flagged."""
    lines = ds.log_lines(spark, d).drop("margin").withColumn("y", (F.col("label") == "error").cast("int"))
    scored = lg.semantic_score(ml.score_logs(lines, *ml.log_semantic(lines, "description", "y")))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("semantic_anomaly").cast("long").alias("flagged"))


# Features of the window detector.
WINDOW_FEATURES = ["event_count", "raw_row_count", "avg_duration_ms", "max_duration_ms", "p95_duration_ms", "high_severity_count", "high_severity_rate", "error_density", "unique_paths", "unique_event_types", "unique_categories", "unique_severities"]


@query("g13_isolation_forest")
def _(spark, d):
    w = materialize(event_windows(ds.ops_events(spark, d), ["service"], "60 minutes").withColumn("window_id", F.xxhash64("service", "window_start")))
    forest = IsolationForest(WINDOW_FEATURES, "window_id", trees=200, contamination=0.15).fit(w)
    scored = materialize(forest.transform(w))
    return inc.describe_anomalies(scored).select("service", "window_start", "anomaly_score", "is_anomaly", "anomaly_level", "anomaly_reason", "anomaly_rank")


@query("g13_forest_flags", with_views("SELECT count(*) AS rows, true AS share_fits, true AS flags_fit FROM (SELECT DISTINCT service, time_bucket(INTERVAL '60 minutes', \"timestamp\") FROM ops_events)", "ops_events"))
def _(spark, d):
    """At most the asked share is flagged, nearly all of it (equal scores at the limit stay unflagged), and exactly the scores above 0."""
    w = materialize(event_windows(ds.ops_events(spark, d), ["service"], "60 minutes").withColumn("window_id", F.xxhash64("service", "window_start")))
    scored = IsolationForest(WINDOW_FEATURES, "window_id", trees=200, contamination=0.15).fit(w).transform(w)
    flagged, rows = F.count_if("is_anomaly"), F.count(F.lit(1))
    return scored.agg(rows.alias("rows"), flagged.between(0.10 * rows, 0.15 * rows + 1).alias("share_fits"), F.every(F.col("is_anomaly") == (F.col("anomaly_score") > 0)).alias("flags_fit"))


@query("g13_log_window_forest")
def _(spark, d):
    w = materialize(anomalous_log_windows(spark, d).withColumn("window_id", F.xxhash64("service", "block_id", "window_start")))
    names = ["total_logs", "error_count", "error_rate", "unique_sources", "unique_hosts", "error_rate_delta", "volume_delta", "semantic_anomaly_rate", "semantic_mean_confidence"]
    return IsolationForest(names, "window_id", trees=300, contamination=0.10).fit(w).transform(w).select("service", "block_id", "window_start", "anomaly_score", "is_anomaly")


@query("g14_next_anomaly")
def _(spark, d):
    w = materialize(scored_windows(spark, d))
    _, test = ml.train_next_anomaly(w, ["service"], WINDOW_FEATURES, ["window_start"])
    return test.select("service", "window_start", "target", "incident_risk", inc.score_level(F.col("incident_risk")).alias("level"))


def prediction_rows(spark, d):
    """Hourly series rows with past-only features and the next-fault label."""
    m = tsr.temporal_matrix(hourly(spark, d), SERIES, "slot", "value")
    labelled = tj.horizon_labels(m, ds.faults(spark, d), ["service"], "slot", "fault_start", "fault_id", [15])
    return materialize(labelled.drop("next_fault_id", "next_fault_start", "minutes_to_next", "incident_now"))


NUMERIC = ["value", "value_lag_1", "value_lag_2", "delta_1", "delta_2", "pct_change_1", "rolling_mean", "rolling_std"]
# Cut in time order: 70 % to fit, 15 % to choose a threshold, 15 % to test.
PARTS_SQL = """SELECT split, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, true AS fits FROM (
 SELECT y, CASE WHEN pos <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN pos <= floor(n * 0.85 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM (
 SELECT *, row_number() OVER (ORDER BY {order}) AS pos, count(*) OVER () AS n FROM {rows})) GROUP BY split"""
NEXT_SQL = """SELECT h.*, CASE WHEN date_diff('microsecond', h.slot, f.fault_start) <= 900000000 THEN 1 ELSE 0 END AS y FROM {rows} h ASOF LEFT JOIN faults f ON h.service = f.service AND h.slot < f.fault_start"""
TIMES_SQL = "SELECT DISTINCT service, slot FROM hr"


def parts(scored, label):
    """Rows and positives of each part; the fitted part must be told apart (ROC-AUC 0.7 or more). Rows of one class have no AUC and nothing to tell apart."""
    found = auc(scored.filter("split = 'train'"), [], label, "risk").first()
    fitted = not found["n_pos"] or not found["n_neg"] or (found["auc"] or 0.0) >= 0.7
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives"), F.lit(fitted).alias("fits"))


def incident_model(spark, d):
    return ml.train_incident(prediction_rows(spark, d), NUMERIC, "service", "incident_next_15m", ["slot", "service", "metric"])


@query("g15_incident_predictor")
def _(spark, d):
    sweep, scored = kept(spark, d, "incident", incident_model)
    test = scored.filter("split = 'test'")
    best = sweep.filter("is_best").select("threshold").first()[0]
    report = ml.classification_report(test.withColumn("p", (F.col("risk") >= best).cast("int")), "incident_next_15m", "p")
    roc, pr = auc(test, [], "incident_next_15m", "risk").first()["auc"], average_precision(test, [], "incident_next_15m", "risk").first()["average_precision"]
    return report.withColumns({"threshold": F.lit(best), "roc_auc": F.lit(roc).cast("double"), "pr_auc": F.lit(pr).cast("double")})


@query("g15_incident_parts", with_views(PARTS_SQL.format(order="slot, service, metric", rows="lb"), "telemetry", "faults", hr=HOUR_SQL, lb=NEXT_SQL.format(rows="hr")))
def _(spark, d):
    return parts(kept(spark, d, "incident", incident_model)[1], "incident_next_15m")


METRIC_NAMES = sorted(m for m, _ in ds.METRICS.values())


def risk_model(spark, d):
    """Boosted trees over all twelve features of every metric at a time."""
    rows = ml.packed_rows(prediction_rows(spark, d), ["service", "slot"], "metric", METRIC_NAMES, [F.max("incident_next_15m").alias("y")])
    return ml.train_risk(rows, "y", ["slot", "service"], METRIC_NAMES)


@query("g16_risk_importance")
def _(spark, d):
    return ml.feature_importance(kept(spark, d, "risk", risk_model)[0], ml.feature_names(METRIC_NAMES), spark)


@query(
    "g16_risk_features",
    "SELECT m || e AS feature, true AS is_share FROM (SELECT unnest([" + ", ".join(f"'{m}'" for m in METRIC_NAMES) + "]) AS m), (SELECT unnest([" + ", ".join(f"'{e}'" for e in ml.FEATURE_ENDINGS.values()) + "]) AS e)",
)
def _(spark, d):
    """Twelve features for each metric, whose importances are shares of one."""
    found = ml.feature_importance(kept(spark, d, "risk", risk_model)[0], ml.feature_names(METRIC_NAMES), spark)
    total = found.agg(F.sum("importance")).scalar()
    return found.select("feature", (F.col("importance").between(0, 1) & (F.abs(total - 1) < 1e-9)).alias("is_share"))


@query("g16_risk_parts", with_views(PARTS_SQL.format(order="slot, service", rows="lb"), "telemetry", "faults", hr=HOUR_SQL, tm=TIMES_SQL, lb=NEXT_SQL.format(rows="tm")))
def _(spark, d):
    return parts(kept(spark, d, "risk", risk_model)[1], "y")


def held_out_risk(spark, d):
    """The times after those of the fit."""
    model, rows = kept(spark, d, "risk", risk_model)
    return rows.filter("split <> 'train'"), model


@query("g17_score_risk")
def _(spark, d):
    rows, model = held_out_risk(spark, d)
    return ml.score_risk(rows, model, "slot", last=24).select("service", "slot", "risk", "risk_level", "alert")


@query(
    "g17_recent_levels",
    with_views("SELECT service, slot, true AS level_fits FROM tm WHERE slot IN (SELECT DISTINCT slot FROM ho ORDER BY slot DESC LIMIT 24) AND (service, slot) IN (SELECT (service, slot) FROM ho)", "telemetry", hr=HOUR_SQL, tm=TIMES_SQL,
               ho="SELECT service, slot FROM (SELECT *, row_number() OVER (ORDER BY slot, service) AS pos, count(*) OVER () AS n FROM tm) WHERE pos > floor(n * 0.7 + 1e-9)"),
)
def _(spark, d):
    """The last 24 times; level and alert follow from the risk."""
    rows, model = held_out_risk(spark, d)
    risk = F.col("risk")
    fits = risk.between(0, 1) & (F.col("risk_level") == prob_level(risk, ALERT_CUTS)) & (F.col("alert") == (risk >= 0.25))
    return ml.score_risk(rows, model, "slot", last=24).select("service", "slot", fits.alias("level_fits"))


@query("g17_risk_kpis")
def _(spark, d):
    rows, model = held_out_risk(spark, d)
    return ml.risk_kpis(ml.score_risk(rows, model, "slot"))
