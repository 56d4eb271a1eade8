"""Queries over tickets, predictions and plain tables: sources, quality, evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from faultline.functions import rules
from faultline.functions.text import METRIC_GROUPS, METRIC_TYPES, clean_text, combine_text, normalize_text, parse_document
from faultline.operators import evaluation as evl
from faultline.operators import logs as lg
from faultline.operators import metric_catalog as mc
from faultline.operators import quality as ql
from faultline.operators import tickets as tk
from faultline.operators.events import event_signals
from faultline.operators.incidents import top_k
from faultline.plans.catalog_events import SIGNALS_SQL
from faultline.plans.catalog_series import DETECT_SQL, VOTES_SQL, voted
from faultline.plans.registry import big, query, rnd, rounded
from faultline.session import scratch_path, spread
from faultline.sources import datasets as ds
from faultline.sources import tables as tb
from faultline.sources.datasets import PRIORITIES, QUEUES, TYPES, with_views

# --- sources ----------------------------------------------------------------------------
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("a01_csv_scan", f"SELECT o_orderpriority, count(*) AS n, {rnd('total', 2)} FROM (SELECT o_orderpriority, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS total FROM orders) GROUP BY o_orderpriority, total")
def _(spark, d):
    path = scratch_path(spark, "orders")
    tb.write_table(ds.table(spark, d, "orders"), path, "csv")
    return rounded(tb.read_table(spark, path, ORDERS).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("a02_sql_scan", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS balance FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    return rounded(tb.sql_scan(spark, "SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS balance FROM {customer} GROUP BY c_mktsegment", customer=ds.table(spark, d, "customer")).withColumn("n", F.col("n")))


@query("a03_read_series", with_views("SELECT service AS family, metric AS series_id, count(*) AS n, round(avg(value), 6) AS mean, CAST(sum(label) AS BIGINT) AS anomalies FROM telemetry GROUP BY 1, 2 HAVING count(*) >= 200", "telemetry"))
def _(spark, d):
    path = scratch_path(spark, "series")
    t = ds.telemetry(spark, d).select("service", "metric", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "value", "label")
    cores = spark.sparkContext.defaultParallelism
    t.repartition(4 * cores, "service", "metric").write.option("header", "true").partitionBy("service", "metric").csv(path)  # a count, else small partitions are merged
    at = spark._jvm.org.apache.hadoop.fs.Path
    folders = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for file in folders.globStatus(at(f"{path}/service=*/metric=*/*.csv")):  # one file for each series, moved to <family>/<series>.csv as the series come
        family, series = (re.search(rf"{c}=([^/]+)", file.getPath().toString())[1] for c in ("service", "metric"))
        folders.mkdirs(at(f"{path}/tree/{family}"))
        folders.rename(file.getPath(), at(f"{path}/tree/{family}/{series}.csv"))
    kept = tb.read_series(spark, f"{path}/tree/*/*.csv", 200)
    return rounded(kept.groupBy("family", "series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.sum("label").alias("anomalies")))


PERIOD_SQL = "SELECT metric || CASE WHEN day(ts) <= 16 THEN '_2024-01-01_2024-01-16' ELSE '_2024-01-16_2024-01-31' END AS file, CAST(ts AS DATE) AS day, value, metric, point_id, ts FROM telemetry WHERE day(ts) <> 16 UNION ALL SELECT metric || p, CAST(ts AS DATE), value + o, metric, point_id, ts FROM telemetry CROSS JOIN (VALUES ('_2024-01-01_2024-01-16', 0), ('_2024-01-16_2024-01-31', 1)) v(p, o) WHERE day(ts) = 16"


def period_files(spark, d):
    """Two period files that both hold the 16th; the second one with shifted values."""
    first, second = "_2024-01-01_2024-01-16", "_2024-01-16_2024-01-31"
    t = ds.telemetry(spark, d).select("metric", "ts", "value", F.dayofmonth("ts").alias("day"))
    part = lambda rows, suffix, shift: rows.select(F.concat("metric", F.lit(suffix)).alias("file"), "ts", (F.col("value") + shift).alias("value"))
    other = t.filter("day <> 16").select(F.concat("metric", F.when(F.col("day") <= 16, first).otherwise(second)).alias("file"), "ts", "value")
    shared = t.filter("day = 16")
    return tb.union_all([other, part(shared, first, 0), part(shared, second, 1)])


@query("a04_stitch_periods", with_views("SELECT metric, ts, substr(file, length(metric) + 1) AS period, value FROM (SELECT *, row_number() OVER (PARTITION BY metric, ts ORDER BY substr(file, length(metric) + 1), value) AS rn FROM pf) WHERE rn = 1", "telemetry", pf=PERIOD_SQL))
def _(spark, d):
    return tb.stitch_periods(period_files(spark, d), "file", "ts", "value")


@query("a04_stitch_report", with_views("SELECT metric, count(*) AS rows_before, count(DISTINCT ts) AS rows_after FROM pf GROUP BY metric", "telemetry", pf=PERIOD_SQL))
def _(spark, d):
    files = period_files(spark, d)
    named = files.withColumn("metric", F.regexp_replace("file", r"_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})", ""))
    return tb.stitch_report(named, tb.stitch_periods(files, "file", "ts", "value"), "metric")


@query("a04_missing_periods", with_views("SELECT DISTINCT a.service, b.day FROM telemetry a CROSS JOIN (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') AS day FROM telemetry) b WHERE NOT EXISTS (SELECT 1 FROM telemetry t WHERE t.service = a.service AND strftime(t.ts, '%Y-%m-%d %H') = b.day)", "telemetry"))
def _(spark, d):
    t = ds.telemetry(spark, d).select("service", F.date_format("ts", "yyyy-MM-dd HH").alias("day"))
    return tb.missing_periods(t, "service", "day")


@query("a05_dedup_latest", "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(spark, d):
    return tb.dedup_latest(ds.table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query("a06_union_labeled", with_views("SELECT label, exception_type, count(*) AS n FROM log_lines GROUP BY 1, 2", "log_lines"))
def _(spark, d):
    rows = ds.log_lines(spark, d)
    error = rows.filter("label = 'error'").drop("label")
    info = rows.filter("label = 'info'").drop("label", "exception_type")
    return tb.union_labeled({"error": error, "info": info}).groupBy("label", "exception_type").agg(F.count(F.lit(1)).alias("n"))


@query("a07_validate_table", "SELECT count(*) AS rows, count(*) - count(text) AS text_nulls, count(*) - count(lang) AS lang_nulls, count(text) - count(DISTINCT text) AS text_duplicates, count(*) = 0 AS is_empty FROM documents")
def _(spark, d):
    return ql.validate_table(ds.table(spark, d, "documents"), ["doc_id", "text", "lang"], ["text", "lang"], ["text"])


@query("a08_load_table", "SELECT count(*) AS loaded_rows FROM customer")
def _(spark, d):
    path = scratch_path(spark, "customer_table")
    tb.load_table(ds.table(spark, d, "nation"), path)
    tb.load_table(ds.table(spark, d, "customer"), path)
    return tb.VersionedTable(spark, path).rows().agg(F.count(F.lit(1)).alias("loaded_rows"))


HIST_SQL = """SELECT doc_id AS id, subject || ' ' || body AS ticket_text, "type" AS ticket_type, priority, queue, round(0.5 + (doc_id % 50) / 100.0, 4) AS confidence, TIMESTAMP '2024-01-01' + to_hours(doc_id % 480) AS created_at FROM tickets"""


def history_rows(spark, d):
    t = ds.tickets(spark, d)
    created = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("doc_id") % 480).cast("int"))
    return t.select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", "subject", "body").alias("ticket_text"), F.col("type").alias("ticket_type"), "priority", "queue",
        F.round(0.5 + (F.col("doc_id") % 50) / 100.0, 4).alias("confidence"), rules.recommendation(F.col("queue"), F.col("priority")).alias("recommendation"), created.alias("created_at"), F.lit("batch").alias("source"),
    )


def history(spark, d):
    h = tb.History(spark, scratch_path(spark, "history"))
    h.append(history_rows(spark, d))
    return h


@query("a09_history_recent", with_views("SELECT id, ticket_type, created_at FROM h ORDER BY created_at DESC, id DESC LIMIT 20", "tickets", h=HIST_SQL))
def _(spark, d):
    return history(spark, d).recent(20).select("id", "ticket_type", "created_at")


@query("a09_history_by_id", with_views("SELECT id, ticket_type, priority, queue FROM h WHERE id = 7", "tickets", h=HIST_SQL))
def _(spark, d):
    return history(spark, d).by_id(7).select("id", "ticket_type", "priority", "queue")


@query("a09_history_purge", with_views("SELECT count(*) AS kept, min(created_at) AS oldest FROM h WHERE created_at >= TIMESTAMP '2024-01-10 12:00:00'", "tickets", h=HIST_SQL))
def _(spark, d):
    h = history(spark, d)
    h.purge(10, F.lit("2024-01-20 12:00:00"))
    return h.rows().agg(F.count(F.lit(1)).alias("kept"), F.min("created_at").alias("oldest"))


@query("a10_sinks", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    path = scratch_path(spark, "orders_json")
    tb.write_table(ds.table(spark, d, "orders"), path, "json")
    return tb.read_table(spark, path, ORDERS, "json").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("a11_gold_predictions", with_views("SELECT id AS ticket_id, ticket_text, ticket_type AS \"type\", priority, queue, created_at FROM h", "tickets", h=HIST_SQL))
def _(spark, d):
    return tk.gold_predictions(history_rows(spark, d).withColumnsRenamed({"id": "ticket_id", "ticket_type": "type"}))


# --- cleaning and validation ------------------------------------------------------------
RAW_SQL = "SELECT event_id, service, CASE WHEN k % 19 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text, CASE WHEN k % 23 = 0 THEN 'n/a' WHEN k % 29 = 0 THEN 'inf' ELSE CAST(k AS VARCHAR) END AS k_text, ts, k, value FROM ev"


def raw_text(spark, d):
    e = ds._events(spark, d)
    ts_text = F.when(F.col("k") % 19 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    k_text = F.when(F.col("k") % 23 == 0, "n/a").when(F.col("k") % 29 == 0, "Infinity").otherwise(F.col("k").cast("string"))
    return e.select("event_id", "service", ts_text.alias("ts_text"), k_text.alias("k_text"), "ts", "k", "value")


@query("b01_coerce_timestamp", with_views("SELECT event_id, date_trunc('second', ts) AS parsed FROM ev WHERE k % 19 <> 0", "ev"))
def _(spark, d):
    t = ql.coerce_timestamp(raw_text(spark, d), "ts_text")
    return t.select("event_id", F.col("ts_text").cast("timestamp_ntz").alias("parsed"))


@query("b02_auto_timestamp", with_views("SELECT event_id, date_trunc('millisecond', ts) AS from_epoch, CASE WHEN k % 19 <> 0 THEN date_trunc('second', ts) END AS from_text FROM ev", "ev"))
def _(spark, d):
    t = raw_text(spark, d).withColumn("epoch_text", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    t = ql.auto_timestamp(ql.auto_timestamp(t, "epoch_text"), "ts_text")
    return t.select("event_id", F.col("epoch_text").cast("timestamp_ntz").alias("from_epoch"), F.col("ts_text").cast("timestamp_ntz").alias("from_text"))


@query("b03_reject_bad_series", with_views("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) >= 0.8 AND avg(CASE WHEN value > 20 THEN 1 ELSE 0 END) >= 0.5) GROUP BY user_id"))
def _(spark, d):
    e = ds.table(spark, d, "events").withColumns({"t": F.when(F.col("event_type") != "error", F.col("ts")), "v": F.when(F.col("value") > 20, F.col("value"))})
    return ql.reject_bad_series(e, ["user_id"], "t", "v").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("b04_coerce_numeric", with_views("SELECT event_id, CASE WHEN k % 23 = 0 OR k % 29 = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) END AS k_number FROM ev", "ev"))
def _(spark, d):
    return ql.coerce_numeric(raw_text(spark, d), ["k_text"]).select("event_id", F.col("k_text").alias("k_number"))


@query("b05_fill_strings", with_views("SELECT line_id, coalesce(exception_type, '') AS exception_type FROM log_lines", "log_lines"))
def _(spark, d):
    return ql.fill_strings(ds.log_lines(spark, d), ["exception_type"]).select("line_id", "exception_type")


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), 'http\\S+|www\\S+', ' ', 'g'), '\\S+@\\S+', ' ', 'g'), '[^a-zA-ZÀ-ÿ0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
NORMAL = "regexp_replace(regexp_replace(trim(lower({c})), '\\s+', ' ', 'g'), '^[ .,!?;:]+|[ .,!?;:]+$', '', 'g')"


@query("b09_clean_text", "SELECT doc_id, " + CLEAN.format(c="text") + " AS cleaned FROM documents")
def _(spark, d):
    return spread(ds.table(spark, d, "documents")).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query("b10_preprocess_tickets", with_views("SELECT doc_id, " + CLEAN.format(c="subject || ' ' || body") + ' AS ticket_text, "type", queue, priority, "language", answer FROM tickets WHERE length(' + CLEAN.format(c="subject || ' ' || body") + ") > 0", "tickets"))
def _(spark, d):
    return tk.preprocess_tickets(spread(ds.tickets(spark, d)))


@query("b11_normalize_text", "SELECT doc_id, " + NORMAL.format(c="text") + " AS normal FROM documents")
def _(spark, d):
    return ds.table(spark, d, "documents").select("doc_id", normalize_text(F.col("text")).alias("normal"))


@query("b12_combine_text", with_views("SELECT line_id, concat_ws(' ', nullif(trim(description), ''), nullif(trim(exception_type), ''), nullif(trim(source), '')) AS text FROM log_lines", "log_lines"))
def _(spark, d):
    return ds.log_lines(spark, d).select("line_id", combine_text("description", "exception_type", "source").alias("text"))


B_COLS = 'subject, body, answer, "type", queue, priority, "language", tag_1, tag_2, tag_3, tag_4, tag_5, tag_6, tag_7, tag_8'


@query("b13_bronze_tickets", with_views(f"SELECT {B_COLS} FROM tickets", "tickets"))
def _(spark, d):
    return tk.bronze_tickets(ds.tickets(spark, d))


@query("b14_silver_tickets", with_views("SELECT trim(subject) AS subject, trim(\"type\") AS ticket_type, trim(queue) AS queue, coalesce(trim(subject), '') || ' ' || coalesce(trim(body), '') AS ticket_text FROM tickets", "tickets"))
def _(spark, d):
    return tk.silver_tickets(tk.bronze_tickets(ds.tickets(spark, d))).select("subject", "ticket_type", "queue", "ticket_text")


@query("b14_silver_dense_ids", with_views("SELECT row_number() OVER (ORDER BY subject, body, answer, \"type\", queue, priority, \"language\", tag_1, tag_2) AS ticket_id, trim(subject) AS subject, trim(queue) AS queue FROM tickets", "tickets"))
def _(spark, d):
    return tk.silver_tickets(tk.bronze_tickets(ds.tickets(spark, d)), dense_ids=True).select("ticket_id", "subject", "queue")


CHECK_RULES = [("ticket_type", "not_null", None), ("ticket_type", "accepted_values", ["Incident", "Request"]), ("priority", "accepted_values", PRIORITIES), ("queue", "not_null", None), ("queue", "accepted_values", QUEUES[:6])]


@query(
    "b15_declarative_checks",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{k}' AS rule, f AS failing_rows, f = 0 AS passed FROM (SELECT count(*) FILTER (WHERE {'%s IS NULL' % q if k == 'not_null' else '%s NOT IN (%s)' % (q, ', '.join(repr(x) for x in v))}) AS f FROM tickets)"
            for c, k, v in CHECK_RULES
            for q in [{"ticket_type": '"type"'}.get(c, c)]
        ),
        "tickets",
    ),
)
def _(spark, d):
    return ql.run_checks(ds.tickets(spark, d).withColumnRenamed("type", "ticket_type"), CHECK_RULES)


@query("b16_check_labels", with_views("SELECT * FROM (VALUES ('Outage', 'missing'), ('Problem', 'unexpected'), ('Change', 'unexpected')) v(label, problem) WHERE problem = 'missing' OR label IN (SELECT \"type\" FROM tickets)", "tickets"))
def _(spark, d):
    return ql.check_labels(ds.tickets(spark, d), "type", ["Incident", "Request", "Outage"])


DOC_SQL = "SELECT doc_id, 'Type: ' || \"type\" || chr(10) || 'QUEUE:  ' || queue || chr(10) || 'Priority: ' || priority || chr(10) || 'Historical solution: ' || answer AS doc FROM tickets"


@query("b17_parse_document", with_views("SELECT doc_id, trim(regexp_extract(doc, '(?i)Type:\\s*(.+?)(\\n|$)', 1)) AS \"type\", trim(regexp_extract(doc, '(?i)Queue:\\s*(.+?)(\\n|$)', 1)) AS queue, trim(regexp_extract(doc, '(?i)Priority:\\s*(.+?)(\\n|$)', 1)) AS priority, CAST(NULL AS VARCHAR) AS \"language\", trim(regexp_extract(doc, '(?i)Historical solution:\\s*(.+?)(\\n|$)', 1)) AS historical_solution FROM dc", "tickets", dc=DOC_SQL))
def _(spark, d):
    doc = F.concat(F.lit("Type: "), "type", F.lit("\nQUEUE:  "), "queue", F.lit("\nPriority: "), "priority", F.lit("\nHistorical solution: "), "answer")
    return ds.tickets(spark, d).select("doc_id", *[c.alias(n) for n, c in parse_document(doc).items()])


NAME_SQL = """SELECT p_partkey, 'metric/' || ['dbservice1', 'mobservice2', 'host'][p_partkey % 3 + 1] || '/' || CASE WHEN p_partkey % 3 = 2 THEN ['system_load_1', 'system_cpu_total_norm_pct', 'system_memory_used', 'system_memory_cached', 'system_cpu_cores', 'filesystem_free'][p_partkey // 3 % 6 + 1] || '_' || p_partkey
 ELSE ['dbservice1', 'mobservice2'][p_partkey % 3 + 1] || '_0.0.0.' || (p_partkey % 5) || '_' || ['docker_network_in_errors', 'docker_network_out_packets', 'docker_diskio_summary_bytes', 'docker_diskio_reads', 'docker_cpu_total_norm_pct', 'docker_memory_usage_pct'][p_partkey // 3 % 6 + 1] || '_' || p_partkey END
 || ['_2021-07-01_2021-07-31', '_2021-08-01_2021-08-31'][p_partkey % 2 + 1] || '.csv' AS path FROM part"""


def listing(spark, d):
    """Listing lines of metric files, one per part."""
    p = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    service = pick(["dbservice1", "mobservice2", "host"], p % 3)
    kind = F.floor(p / 3) % 6
    system = F.concat(pick(["system_load_1", "system_cpu_total_norm_pct", "system_memory_used", "system_memory_cached", "system_cpu_cores", "filesystem_free"], kind), F.lit("_"), p)
    docker = F.concat(service, F.lit("_0.0.0."), p % 5, F.lit("_"), pick(["docker_network_in_errors", "docker_network_out_packets", "docker_diskio_summary_bytes", "docker_diskio_reads", "docker_cpu_total_norm_pct", "docker_memory_usage_pct"], kind), F.lit("_"), p)
    period = pick(["_2021-07-01_2021-07-31", "_2021-08-01_2021-08-31"], p % 2)
    path = F.concat(F.lit("metric/"), service, F.lit("/"), F.when(p % 3 == 2, system).otherwise(docker), period, F.lit(".csv"))
    return ds.table(spark, d, "part").select("p_partkey", path.alias("path"))


SERVICES = ["dbservice1", "mobservice2"]
METRIC_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(fn), '{p}')" for p in parts) + f" THEN '{r}'" for parts, r in METRIC_TYPES) + " ELSE 'other' END"
GROUP_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(fn), '{p}')" for p in parts) + f" THEN '{r}'" for parts, r in METRIC_GROUPS) + " ELSE 'other' END"
CAT_SQL = {
    "nm": NAME_SQL,
    "fl": "SELECT DISTINCT replace(path, '/', chr(92)) AS path_in_archive, split_part(path, '/', 3) AS fn FROM nm",
    "iv": f"""SELECT path_in_archive, fn AS filename, CASE WHEN contains(fn, 'dbservice1') THEN 'dbservice1' WHEN contains(fn, 'mobservice2') THEN 'mobservice2' END AS service, {METRIC_CASE} AS metric_type, {GROUP_CASE} AS metric_group, CASE WHEN contains(fn, 'docker_') THEN 'docker' WHEN contains(fn, 'system_') THEN 'system' ELSE 'service' END AS scope,
 regexp_extract(fn, '(\\d{{4}}-\\d{{2}}-\\d{{2}})_\\d{{4}}', 1) || '__' || regexp_extract(fn, '_(\\d{{4}}-\\d{{2}}-\\d{{2}})\\.csv', 1) AS period,
 regexp_replace(regexp_replace(CASE WHEN starts_with(st, 'system_') THEN st ELSE regexp_replace(st, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}', '', 'g') END, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS metric_name FROM (SELECT *, regexp_replace(lower(fn), '_\\d{{4}}-\\d{{2}}-\\d{{2}}_\\d{{4}}-\\d{{2}}-\\d{{2}}\\.csv$', '') AS st FROM fl)""",
    "au8": "SELECT * FROM iv WHERE contains(filename, '2021-08-01_2021-08-31')",
    "cd": """SELECT *, coalesce(service, 'SYSTEM') AS svc, CASE WHEN contains(filename, 'docker_network_') AND contains(filename, 'error') THEN 'docker_network_errors' WHEN contains(filename, 'docker_network_') AND contains(filename, 'packets') THEN 'docker_network_packets' WHEN contains(filename, 'docker_diskio') AND (contains(filename, 'summary') OR NOT (SELECT bool_or(contains(filename, 'docker_diskio') AND contains(filename, 'summary')) FROM au8)) THEN 'docker_diskio'
 WHEN contains(filename, 'system_load') THEN 'system_load' WHEN contains(filename, 'system_cpu') AND (contains(filename, 'norm') OR NOT (SELECT bool_or(contains(filename, 'system_cpu') AND contains(filename, 'norm')) FROM au8)) THEN 'system_cpu' WHEN contains(filename, 'system_memory') AND (regexp_matches(filename, 'usage|used|free|available|util') OR NOT (SELECT bool_or(contains(filename, 'system_memory') AND regexp_matches(filename, 'usage|used|free|available|util')) FROM au8)) THEN 'system_memory' END AS selection_reason FROM au8""",
}


@query("b18_classify_names", with_views("SELECT filename, service, metric_type, metric_group, scope, period, metric_name FROM iv", **CAT_SQL))
def _(spark, d):
    named = listing(spark, d).select(F.regexp_extract("path", "([^/]+)$", 1).alias("filename")).distinct()
    return mc.classify_names(named, "filename", SERVICES).select("filename", "service", "metric_type", "metric_group", "scope", "period", "metric_name")


@query("b19_metric_inventory", with_views("SELECT path_in_archive, filename, service, metric_type, scope, period FROM iv", **CAT_SQL))
def _(spark, d):
    lines = listing(spark, d).select(F.concat(F.lit("  2021-08-31 12:00:00  "), "path", F.lit("  ")).alias("line"))
    return mc.metric_inventory(lines, "line", SERVICES).select("path_in_archive", "filename", "service", "metric_type", "scope", "period")


@query("b20_select_candidates", with_views("SELECT filename, svc AS service, selection_reason, CASE selection_reason WHEN 'docker_network_errors' THEN 1 WHEN 'docker_network_packets' THEN 2 WHEN 'docker_diskio' THEN 3 WHEN 'system_load' THEN 4 WHEN 'system_cpu' THEN 5 ELSE 6 END AS priority FROM (SELECT *, row_number() OVER (PARTITION BY svc, selection_reason ORDER BY filename, path_in_archive) AS rn FROM cd WHERE selection_reason IS NOT NULL) WHERE rn <= CASE WHEN svc = 'SYSTEM' THEN CASE WHEN selection_reason LIKE 'system%' THEN 5 ELSE 0 END ELSE CASE selection_reason WHEN 'docker_network_errors' THEN 4 WHEN 'docker_network_packets' THEN 2 WHEN 'docker_diskio' THEN 4 ELSE 0 END END", **CAT_SQL))
def _(spark, d):
    inv = mc.metric_inventory(listing(spark, d), "path", SERVICES)
    return mc.select_candidates(inv, "2021-08-01_2021-08-31").select("filename", "service", "selection_reason", "priority")


@query("b21_filter_analytics", with_views("SELECT count(*) AS total_tickets, count(*) FILTER (WHERE priority = 'high') AS high_priority_tickets, count(*) FILTER (WHERE priority = 'medium') AS medium_priority_tickets, count(*) FILTER (WHERE priority = 'low') AS low_priority_tickets FROM tickets WHERE \"type\" IN ('Incident', 'Problem') AND priority IN ('high', 'medium')", "tickets"))
def _(spark, d):
    return tk.filter_analytics(ds.tickets(spark, d), ["Incident", "Problem"], ["high", "medium"])


@query("b23_drop_leakage", with_views("SELECT point_id, value, label AS incident_next_15m FROM telemetry", "telemetry"))
def _(spark, d):
    t = ds.telemetry(spark, d).select("point_id", "value", F.col("label").alias("incident_next_15m"), F.col("label").alias("incident_next_5m"), F.col("label").alias("incident_now"), F.col("value").alias("minutes_to_next_fault"))
    return ql.drop_leakage(t, "incident_next_15m")


@query("b24_impute_median", with_views("SELECT point_id, coalesce(v, m, 0) AS v, coalesce(v, g, 0) AS train_v FROM (SELECT *, CASE WHEN value > 40 THEN value END AS v FROM telemetry) JOIN (SELECT service, metric, quantile_cont(value, 0.5) FILTER (WHERE value > 40) AS m FROM telemetry GROUP BY 1, 2) USING (service, metric) CROSS JOIN (SELECT quantile_cont(value, 0.5) AS g FROM telemetry WHERE value > 40 AND ts < TIMESTAMP '2024-01-21')", "telemetry"))
def _(spark, d):
    v = F.when(F.col("value") > 40, F.col("value"))
    t = ds.telemetry(spark, d).withColumns({"v": v, "train_v": v})
    t = ql.impute_median(t, ["service", "metric"], ["v"])
    return ql.impute_median(t, [], ["train_v"], F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")).select("point_id", "v", "train_v")


@query("b25_positive_events", with_views("SELECT DISTINCT ts FROM log_lines WHERE label = 'error'", "log_lines"))
def _(spark, d):
    return lg.positive_events(ds.log_lines(spark, d), "label", "ts")


# --- ticket analytics and rules ----------------------------------------------------------
PRI = "count(*) AS total_tickets, count(*) FILTER (WHERE priority = 'high') AS high_priority_tickets, count(*) FILTER (WHERE priority = 'medium') AS medium_priority_tickets, count(*) FILTER (WHERE priority = 'low') AS low_priority_tickets"


@query("d01_ticket_analytics", with_views(f'SELECT "type" AS ticket_type, priority, queue, {PRI} FROM tickets GROUP BY 1, 2, 3', "tickets"))
def _(spark, d):
    return tk.ticket_analytics(ds.tickets(spark, d))


@query("d02_rollup_tickets", with_views("SELECT 'type' AS dimension, \"type\", NULL AS queue, NULL AS priority, count(*) AS total_tickets FROM tickets GROUP BY \"type\" UNION ALL SELECT 'queue', NULL, queue, NULL, count(*) FROM tickets GROUP BY queue UNION ALL SELECT 'priority', NULL, NULL, priority, count(*) FROM tickets GROUP BY priority UNION ALL SELECT 'type_priority', \"type\", NULL, priority, count(*) FROM tickets GROUP BY \"type\", priority", "tickets"))
def _(spark, d):
    return tk.rollup_tickets(ds.tickets(spark, d))


@query("d03_history_stats", with_views("SELECT 'total' AS dimension, CAST(NULL AS VARCHAR) AS label, count(*) AS n, round(avg(confidence), 4) AS average_confidence FROM h UNION ALL SELECT 'type', ticket_type, count(*), round(avg(confidence), 4) FROM h GROUP BY ticket_type UNION ALL SELECT 'priority', priority, count(*), round(avg(confidence), 4) FROM h GROUP BY priority UNION ALL SELECT 'queue', queue, count(*), round(avg(confidence), 4) FROM h GROUP BY queue", "tickets", h=HIST_SQL))
def _(spark, d):
    return tk.history_stats(history_rows(spark, d))


RISK_POINTS = "least(100, CASE priority WHEN 'high' THEN 70 WHEN 'medium' THEN 45 ELSE 20 END + CASE \"type\" WHEN 'Incident' THEN 15 WHEN 'Problem' THEN 10 WHEN 'Change' THEN 5 ELSE 0 END + CASE WHEN queue = 'Service Outages and Maintenance' THEN 15 ELSE 0 END)"


@query("f13_ticket_risk", with_views(f"SELECT doc_id, p AS risk_points, CASE WHEN p >= 80 THEN 'CRITICAL' WHEN p >= 60 THEN 'HIGH' WHEN p >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, p >= 70 AS escalation FROM (SELECT *, {RISK_POINTS} AS p FROM tickets)", "tickets"))
def _(spark, d):
    return tk.ticket_risk(ds.tickets(spark, d)).select("doc_id", "risk_points", "risk_level", "escalation")


@query(
    "f14_recommendation",
    with_views(
        """SELECT doc_id, 'Assign the ticket to the ' || queue || ' team with ' || priority || ' priority and monitor the incident through its resolution lifecycle.' AS recommendation,
 CASE priority WHEN 'high' THEN 'Immediate attention recommended. Route the ticket to **' || queue || '** and prioritize investigation. Consider escalation to the responsible support team.' WHEN 'medium' THEN 'Assign the ticket to **' || queue || '**. Monitor the resolution process and ensure the issue is handled within the expected service level.'
 ELSE 'Route the ticket to **' || queue || '** for standard processing. Resolution can follow the normal support workflow.' END AS advice,
 concat_ws(' / ', CASE WHEN priority = 'high' THEN 'Escalader immediatement le ticket a l''equipe d''astreinte.' ELSE 'Accuser reception du ticket et planifier son traitement.' END, 'Affecter le ticket a la file ' || queue || '.', CASE WHEN "type" = 'Incident' THEN 'Comparer la solution proposee avec les tickets historiques similaires.' END, 'Demander une validation humaine avant toute action irreversible.') AS plan FROM tickets""",
        "tickets",
    ),
)
def _(spark, d):
    q, p = F.col("queue"), F.col("priority")
    plan = rules.action_plan(q, p, F.col("type") == "Incident")
    return ds.tickets(spark, d).select("doc_id", rules.recommendation(q, p).alias("recommendation"), rules.routing_advice(q, p).alias("advice"), F.array_join(plan, " / ").alias("plan"))


# --- profiling ---------------------------------------------------------------------------
EVENT_COLS = ["event_id", "service", "event_type", "duration_ms", "status_code", "path"]


NUMBERS = {"min": "min({c})", "mean": "avg({c})", "max": "max({c})", "std": "stddev_samp({c})", **{f"q{q}": f"quantile_cont(CAST({{c}} AS DOUBLE), 0.{q})" for q in (25, 50, 75)}}


@query(
    "d25_profile_columns",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS unique_values, " + (", ".join(f'round({f.format(c=c)}, 6) + 0.0 AS "{n}"' for n, f in NUMBERS.items()) if t in ("bigint", "double", "int") else ", ".join(f'CAST(NULL AS DOUBLE) AS "{n}"' for n in NUMBERS)) + " FROM ops_events"
            for c, t in {"event_id": "bigint", "service": "string", "event_type": "string", "duration_ms": "double", "status_code": "int", "path": "string"}.items()
        ),
        "ops_events",
    ),
)
def _(spark, d):
    return rounded(ql.profile_columns(ds.ops_events(spark, d).select(*EVENT_COLS)))


@query("d25_top_values", with_views("SELECT column_name, value, n, \"rank\", round(n / (SELECT count(*) FROM ops_events) * 100, 6) AS percent FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS \"rank\" FROM (SELECT column_name, value, count(*) AS n FROM (SELECT 'path' AS column_name, path AS value FROM ops_events UNION ALL SELECT 'duration_ms', CASE WHEN duration_ms IS NULL THEN '<null>' ELSE 'known' END FROM ops_events) GROUP BY 1, 2)) WHERE \"rank\" <= 20", "ops_events"))
def _(spark, d):
    e = ds.ops_events(spark, d).select("path", F.when(F.col("duration_ms").isNotNull(), "known").alias("duration_ms"))
    return rounded(ql.top_values(e, ["path", "duration_ms"], 20))


@query("d25_profile_events", with_views("SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ops_events)) AS duplicates, count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS http_2xx, count(*) FILTER (WHERE status_code BETWEEN 300 AND 399) AS http_3xx, count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS http_4xx, count(*) FILTER (WHERE status_code BETWEEN 500 AND 599) AS http_5xx, count(*) FILTER (WHERE duration_ms > 100) AS slower_100ms, count(*) FILTER (WHERE duration_ms > 500) AS slower_500ms, count(*) FILTER (WHERE duration_ms > 1000) AS slower_1000ms, count(*) FILTER (WHERE regexp_matches(lower(event_type), 'error|exception') OR status_code >= 500) AS failure_rows, round(count(*) FILTER (WHERE regexp_matches(lower(event_type), 'error|exception') OR status_code >= 500) / count(*) * 100, 6) AS failure_percent FROM ops_events", "ops_events"))
def _(spark, d):
    return rounded(ql.profile_events(ds.ops_events(spark, d)))


@query("d25_profile_time", "SELECT 'hour' AS unit, CAST(hour(ts) AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'day_of_week', CAST(isodow(ts) - 1 AS VARCHAR), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'date', CAST(CAST(ts AS DATE) AS VARCHAR), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*) FROM events GROUP BY 2")
def _(spark, d):
    return ql.profile_time(ds.table(spark, d, "events"), "ts")


@query("d25_profile_text", "SELECT count(*) FILTER (WHERE trim(text) = '') AS empty, min(length(text)) AS min_length, round(avg(length(text)), 6) AS mean_length, max(length(text)) AS max_length, quantile_cont(length(text), 0.5) AS median_length FROM documents")
def _(spark, d):
    return rounded(ql.profile_text(ds.table(spark, d, "documents"), "text"))


HOUR_SQL = 'SELECT date_trunc(\'hour\', "timestamp") AS hour_start, count(*) AS events, CAST(sum(failure_signal) AS BIGINT) AS failures FROM sig GROUP BY 1'


@query("d26_hourly_failures", with_views("SELECT hour_start, events, failures, round(failures / events, 6) AS failure_rate FROM hr", "ops_events", sig=SIGNALS_SQL, hr=HOUR_SQL))
def _(spark, d):
    return rounded(ql.hourly_failures(event_signals(ds.ops_events(spark, d)), "timestamp"))


@query("d26_worst_hours", with_views("SELECT hour_start, events, failures, round(failures / events, 6) AS failure_rate FROM hr ORDER BY failures / events DESC, events DESC, hour_start LIMIT 20", "ops_events", sig=SIGNALS_SQL, hr=HOUR_SQL))
def _(spark, d):
    return rounded(ql.hourly_failures(event_signals(ds.ops_events(spark, d)), "timestamp", 20))


@query("d27_value_distribution", "SELECT l_returnflag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem) * 100, 6) AS percent FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return rounded(ql.value_distribution(ds.table(spark, d, "lineitem"), "l_returnflag"))


@query("d28_crosstab", "SELECT l_returnflag, f AS \"F\", o AS \"O\", f + o AS row_total, round(f / (f + o) * 100, 6) AS \"F_pct\", round(o / (f + o) * 100, 6) AS \"O_pct\" FROM (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1)")
def _(spark, d):
    return rounded(ql.crosstab(ds.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"]))


@query("d29_duplicate_conflicts", with_views("SELECT text, count(*) AS copies, count(DISTINCT queue) AS label_count, string_agg(DISTINCT queue, ', ' ORDER BY queue) AS labels, count(DISTINCT queue) > 1 AS conflicting FROM (SELECT queue, " + NORMAL.format(c="subject || ' ' || body") + " AS text FROM tickets) WHERE text <> '' GROUP BY text HAVING count(*) > 1", "tickets"))
def _(spark, d):
    return ql.duplicate_conflicts(spread(ds.tickets(spark, d)), normalize_text(F.concat_ws(" ", "subject", "body")), "queue")


@query("d32_cascade_impact", with_views("""SELECT count(*) AS rows, round(avg(CAST(true_type = predicted_type AS INTEGER)), 6) AS upstream_accuracy, round(avg(CAST(queue_from_true_type = true_queue AS INTEGER)), 6) AS accuracy_true_upstream, round(avg(CAST(queue_from_predicted_type = true_queue AS INTEGER)), 6) AS accuracy_predicted_upstream,
 count(*) FILTER (WHERE queue_from_true_type = true_queue AND queue_from_predicted_type <> true_queue) AS caused_errors, count(*) FILTER (WHERE queue_from_true_type <> true_queue AND queue_from_predicted_type = true_queue) AS lucky_fixes, count(*) FILTER (WHERE queue_from_true_type = true_queue AND queue_from_predicted_type <> true_queue AND true_type <> predicted_type) AS caused_by_wrong_upstream,
 round(avg(CAST(queue_from_predicted_type = true_queue AS INTEGER)) FILTER (WHERE true_type <> predicted_type), 6) AS accuracy_when_upstream_wrong, round(avg(CAST(queue_from_true_type = true_queue AS INTEGER)) - avg(CAST(queue_from_predicted_type = true_queue AS INTEGER)), 6) AS accuracy_drop FROM ticket_predictions""", "ticket_predictions"))
def _(spark, d):
    return rounded(evl.cascade_impact(ds.ticket_predictions(spark, d), "true_queue", "true_type", "predicted_type", "queue_from_true_type", "queue_from_predicted_type"))


# --- evaluation --------------------------------------------------------------------------
P_SQL = {
    "lb": "SELECT true_type AS label FROM ticket_predictions UNION SELECT predicted_type FROM ticket_predictions",
    "cs": "SELECT label, (SELECT count(*) FROM ticket_predictions WHERE true_type = label) AS support, (SELECT count(*) FROM ticket_predictions WHERE predicted_type = label) AS predicted, (SELECT count(*) FROM ticket_predictions WHERE true_type = label AND predicted_type = label) AS hits FROM lb",
    "sc": "SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall, CASE WHEN hits > 0 THEN 2 * hits / (predicted + support) ELSE 0.0 END AS f1 FROM cs",
}


@query("m01_class_scores", with_views(f"SELECT label, support, predicted, hits, {rnd('precision, recall, f1')} FROM sc", "ticket_predictions", **P_SQL))
def _(spark, d):
    return rounded(evl.class_scores(ds.ticket_predictions(spark, d), "true_type", "predicted_type"))


@query("m01_classification_report", with_views("SELECT CAST(sum(support) AS BIGINT) AS rows, round(sum(hits) / sum(support), 6) AS accuracy, " + ", ".join(f"round(avg({m}), 6) AS macro_{m}, round(sum({m} * support) / sum(support), 6) AS weighted_{m}" for m in ("precision", "recall", "f1")) + " FROM sc", "ticket_predictions", **P_SQL))
def _(spark, d):
    return rounded(evl.classification_report(ds.ticket_predictions(spark, d), "true_type", "predicted_type"))


@query("m02_confusion_matrix", with_views("SELECT true_type AS actual, predicted_type AS predicted, count(*) AS n FROM ticket_predictions GROUP BY 1, 2", "ticket_predictions"))
def _(spark, d):
    return evl.confusion_matrix(ds.ticket_predictions(spark, d), "true_type", "predicted_type")


@query("m02_confusion_pivot", with_views("SELECT true_type AS actual, " + ", ".join(f"count(*) FILTER (WHERE predicted_type = '{t}') AS \"{t}\"" for t in TYPES) + " FROM ticket_predictions GROUP BY 1", "ticket_predictions"))
def _(spark, d):
    return evl.confusion_matrix(ds.ticket_predictions(spark, d), "true_type", "predicted_type", TYPES)


PAIR_SQL = """SELECT *, n / sum(n) OVER () AS share_of_errors, n / class_rows AS share_of_class, row_number() OVER (PARTITION BY actual ORDER BY n DESC, predicted) = 1 AS most_common_for_class, CAST(row_number() OVER (ORDER BY n DESC, actual, predicted) AS INTEGER) AS pair_rank
 FROM (SELECT true_queue AS actual, queue_from_predicted_type AS predicted, count(*) AS n, (SELECT count(*) FROM ticket_predictions x WHERE x.true_queue = t.true_queue) AS class_rows FROM ticket_predictions t WHERE true_queue <> queue_from_predicted_type GROUP BY 1, 2)"""


@query("m03_confusion_pairs", with_views(f"SELECT actual, predicted, n, class_rows, {rnd('share_of_errors, share_of_class')}, most_common_for_class, pair_rank FROM pr", "ticket_predictions", pr=PAIR_SQL))
def _(spark, d):
    return rounded(evl.confusion_pairs(ds.ticket_predictions(spark, d), "true_queue", "queue_from_predicted_type"))


@query("m04_error_examples", with_views("SELECT * FROM (SELECT doc_id, true_queue, queue_from_predicted_type, pair_rank, n AS pair_count, CAST(row_number() OVER (PARTITION BY true_queue, queue_from_predicted_type ORDER BY doc_id) AS INTEGER) AS example FROM ticket_predictions JOIN pr ON actual = true_queue AND predicted = queue_from_predicted_type WHERE pair_rank <= 30) WHERE example <= 10", "ticket_predictions", pr=PAIR_SQL))
def _(spark, d):
    p = ds.ticket_predictions(spark, d).select("doc_id", "true_queue", "queue_from_predicted_type")
    return evl.error_examples(p, "true_queue", "queue_from_predicted_type", "doc_id", 30, 10)


AUC_SQL = "SELECT event_type, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS a FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY score) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0 AS r FROM scored_points) GROUP BY 1"


@query("m05_auc", with_views("SELECT event_type, n_pos, n_neg, round(a, 6) AS auc, round(greatest(a, 1 - a), 6) AS discriminative_auc, round(2 * a - 1, 6) + 0.0 AS cliffs_delta FROM au", "scored_points", au=AUC_SQL))
def _(spark, d):
    return rounded(evl.auc(ds.scored_points(spark, d), ["event_type"], "y", "score"))


@query("m05_auc_global", with_views("SELECT n1 AS n_pos, n0 AS n_neg, round(a, 6) AS auc, round(greatest(a, 1 - a), 6) AS discriminative_auc, round(2 * a - 1, 6) + 0.0 AS cliffs_delta FROM (SELECT count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS a FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored_points))", "scored_points"))
def _(spark, d):
    return rounded(evl.auc(ds.scored_points(spark, d), [], "y", "score"))


@query("m06_average_precision", with_views("SELECT event_type, CAST(sum(p) AS BIGINT) AS n_pos, round(sum(p * tp / al) / sum(p), 6) AS average_precision FROM (SELECT *, sum(p) OVER (PARTITION BY event_type ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY event_type ORDER BY score DESC) AS al FROM (SELECT event_type, score, sum(y) AS p, count(*) AS n FROM scored_points GROUP BY 1, 2)) GROUP BY event_type", "scored_points"))
def _(spark, d):
    return rounded(evl.average_precision(ds.scored_points(spark, d), ["event_type"], "y", "score"))


TH = [round(0.05 * i, 2) for i in range(1, 20)]
SWEEP_SQL = {
    "tv": "SELECT threshold, sum(CASE WHEN score >= threshold THEN y ELSE 0 END) AS tp, sum(CASE WHEN score >= threshold THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN score < threshold THEN y ELSE 0 END) AS fn, sum(CASE WHEN score < threshold THEN 1 - y ELSE 0 END) AS tn FROM scored_points CROSS JOIN (SELECT CAST(unnest([" + ", ".join(str(t) for t in TH) + "]) AS DOUBLE) AS threshold) GROUP BY 1",
    "tm": "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity, (tp + fp) / (tp + fp + fn + tn) AS positive_rate FROM tv",
    "tf": "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM tm",
}


@query("m07_m08_threshold_sweep", with_views(f"SELECT threshold, {big('tp, fp, fn, tn')}, {rnd('precision, recall, specificity, positive_rate, f1')}, threshold = (SELECT threshold FROM tf WHERE positive_rate <= 0.85 ORDER BY f1 DESC, threshold LIMIT 1) AS is_best FROM tf", "scored_points", **SWEEP_SQL))
def _(spark, d):
    return rounded(evl.threshold_sweep(ds.scored_points(spark, d), "y", "score", TH, 0.85))


DET = ["robust_z_prediction", "rolling_mad_prediction", "ewma_prediction"]


@query("m09_evaluate_by_family", with_views(f"SELECT metric_group, detector, rows, tp, fp, fn, {rnd('precision, recall, f1')}, CAST(row_number() OVER (PARTITION BY metric_group ORDER BY f1 DESC, detector) AS INTEGER) AS detector_rank FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM (" + " UNION ALL ".join(f"SELECT metric_group, '{c}' AS detector, count(*) AS rows, count(*) FILTER (WHERE {c} = 1 AND label = 1) AS tp, count(*) FILTER (WHERE {c} = 1 AND label = 0) AS fp, count(*) FILTER (WHERE {c} = 0 AND label = 1) AS fn FROM votes GROUP BY 1" for c in DET) + ")))", "telemetry", **DETECT_SQL, votes=VOTES_SQL))
def _(spark, d):
    return rounded(evl.evaluate_by(voted(spark, d), "label", DET, "metric_group"))


@query("m16_diff_predictions", with_views("SELECT doc_id, queue_from_true_type AS first, queue_from_predicted_type AS second FROM ticket_predictions WHERE queue_from_true_type <> queue_from_predicted_type", "ticket_predictions"))
def _(spark, d):
    p = ds.ticket_predictions(spark, d)
    return evl.diff_predictions(p.select("doc_id", F.col("queue_from_true_type").alias("q")), p.select("doc_id", F.col("queue_from_predicted_type").alias("q")), "doc_id", "q")


# --- sorts and sets ----------------------------------------------------------------------
@query("s01_sort", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def _(spark, d):
    return ds.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.col("c_acctbal").desc(), "c_custkey")


@query("s02_top_k", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def _(spark, d):
    return top_k(ds.table(spark, d, "events").select("event_id", "user_id", "value"), [F.col("value").desc(), F.col("event_id")], 20)


@query("s02_latest_per_key", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def _(spark, d):
    return tb.latest_rows(ds.table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 10)


OV = {"na": "SELECT DISTINCT lower(trim(text)) AS t FROM documents", "nb": "SELECT DISTINCT lower(trim(text)) AS t FROM benchmark UNION SELECT lower(trim(text)) FROM documents WHERE lang = 'de'"}


@query("s03_text_overlap", with_views("SELECT (SELECT count(*) FROM na) AS texts_a, (SELECT count(*) FROM nb) AS texts_b, count(*) AS shared, round(count(*) * 100.0 / least((SELECT count(*) FROM na), (SELECT count(*) FROM nb)), 6) AS overlap_percent, count(*) = (SELECT count(*) FROM na) AS a_within_b, count(*) = (SELECT count(*) FROM nb) AS b_within_a FROM na JOIN nb USING (t)", **OV))
def _(spark, d):
    norm = F.lower(F.trim("text")).alias("text")
    docs = ds.table(spark, d, "documents")
    b = ds.table(spark, d, "benchmark").select(norm).unionByName(docs.filter("lang = 'de'").select(norm))
    return rounded(ql.text_overlap(docs.select(norm), b, "text"))


@query("s04_common_keys", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    e = ds.table(spark, d, "events")
    return lg.require_common_keys(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), ["user_id"])


@query("s05_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'document' AS kind FROM documents UNION ALL SELECT 'page' FROM pages UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY kind")
def _(spark, d):
    parts = [ds.table(spark, d, t).select(F.lit(k).alias("kind")) for k, t in (("document", "documents"), ("page", "pages"), ("benchmark", "benchmark"))]
    return tb.union_all(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s06_duplicate_count", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS duplicates FROM events")
def _(spark, d):
    return ql.duplicate_count(ds.table(spark, d, "events"), ["user_id", "event_type"])


@query("s07_stable_sample", "SELECT event_id, user_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 500")
def _(spark, d):
    return ql.stable_sample(ds.table(spark, d, "events").select("event_id", "user_id", "value"), "event_id", 500)


@query("s08_pivot_counts", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def _(spark, d):
    return ds.table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("s08_melt", "SELECT l_orderkey, l_linenumber, 'l_discount' AS metric, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def _(spark, d):
    return ql.melt(ds.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"])


@query("g18_recent_metrics", with_views("SELECT point_id, metric_name AS metric, value FROM (SELECT point_id, 'value' AS metric_name, value FROM telemetry WHERE ts BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00' UNION ALL SELECT point_id, 'label', CAST(label AS DOUBLE) FROM telemetry WHERE ts BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00')", "telemetry"))
def _(spark, d):
    t = ds.telemetry(spark, d).select("point_id", "ts", "value", F.col("label").cast("double").alias("label"))
    return ql.recent_metrics(t, "ts", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 1440, ["point_id"], ["value", "label"])


@query("g19_base_metrics", "SELECT l_returnflag, round(avg(l_quantity), 6) AS Quantity_MEAN_lag, round(avg(l_tax), 6) AS tax__mean, round(max(l_discount), 6) AS discount__max FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    wide = ds.table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.max("l_discount").alias("discount__max"), F.count(F.lit(1)).alias("incident_now"), F.avg("l_quantity").alias("Quantity_MEAN_lag"), F.count(F.lit(1)).alias("rows"), F.avg("l_tax").alias("tax__mean")
    )
    return rounded(wide.select("l_returnflag", *ql.select_base_metrics(wide, 3, ["rows"])))
