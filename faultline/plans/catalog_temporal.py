"""Queries that join faults with telemetry in time, and the case-control studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.timefn import shift
from faultline.operators import correlation as cor
from faultline.operators import evaluation as evl
from faultline.operators import temporal_joins as tj
from faultline.operators import timeseries as tsr
from faultline.operators.incidents import log_incidents
from faultline.operators.interval_aggregates import multiplicity, rank_range
from faultline.operators import risk
from faultline.plans.catalog_series import KEY, LI_SQL, LOGS, anomalous_log_windows
from faultline.plans.registry import query, rnd, rounded
from faultline.session import materialize
from faultline.sources import datasets as ds
from faultline.sources.datasets import with_views

MIN = "date_diff('microsecond', {a}, {b}) / 60000000.0"


def minutes(a: str, b: str) -> str:
    return MIN.format(a=a, b=b)


def points(spark, d):
    return ds.telemetry(spark, d).select("point_id", "service", "metric", "ts", "value")


@query(
    "c07_next_event",
    with_views(
        f"SELECT point_id, coalesce(fault_id, -1) AS next_fault_id, round({minutes('t.ts', 'f.fault_start')}, 8) AS minutes_to_next FROM telemetry t ASOF LEFT JOIN faults f ON t.service = f.service AND t.ts < f.fault_start",
        "telemetry",
        "faults",
    ),
)
def _(spark, d):
    out = tj.next_event(points(spark, d), ds.faults(spark, d), KEY, "ts", "fault_start", "fault_id")
    return rounded(out.select("point_id", F.coalesce("next_fault_id", F.lit(-1)).alias("next_fault_id"), "minutes_to_next"), 8)


@query(
    "c08_active_event",
    with_views(
        """SELECT point_id, CASE WHEN EXISTS (SELECT 1 FROM faults f WHERE f.service = t.service AND f.fault_start <= t.ts AND t.ts < f.fault_end) THEN 1 ELSE 0 END AS active_half_open,
 CASE WHEN EXISTS (SELECT 1 FROM faults f WHERE f.service = t.service AND f.fault_start <= t.ts AND t.ts <= f.fault_end) THEN 1 ELSE 0 END AS active_closed, CASE WHEN l.fault_end > t.ts THEN 1 ELSE 0 END AS active_latest_start
 FROM telemetry t ASOF LEFT JOIN faults l ON t.service = l.service AND t.ts >= l.fault_start""",
        "telemetry",
        "faults",
    ),
)
def _(spark, d):
    f, out = ds.faults(spark, d), points(spark, d)
    for closed, mode, name in ((False, "containment", "active_half_open"), (True, "containment", "active_closed"), (False, "latest_start", "active_latest_start")):
        out = tj.active_event(out, f, KEY, "ts", "fault_start", "fault_end", "fault_id", closed, mode).withColumnRenamed("active", name)
    return out.select("point_id", "active_half_open", "active_closed", "active_latest_start")


NEAR_SQL = """SELECT t.point_id, t.service, t.ts, b.fault_id AS bi, b.fault_start AS bt, a.fault_id AS ai, a.fault_start AS at_ FROM telemetry t ASOF LEFT JOIN faults b ON t.service = b.service AND t.ts >= b.fault_start ASOF LEFT JOIN faults a ON t.service = a.service AND t.ts < a.fault_start"""
NEAR2_SQL = f"SELECT point_id, CASE WHEN bm IS NULL OR am < bm THEN ai ELSE bi END AS fid, least(am, bm) AS dist FROM (SELECT *, {minutes('bt', 'ts')} AS bm, {minutes('ts', 'at_')} AS am FROM near)"


@query("c09_nearest", with_views("SELECT point_id, CASE WHEN dist <= 2 THEN fid ELSE -1 END AS nearest_fault_id, round(CASE WHEN dist <= 2 THEN dist END, 8) AS nearest_minutes FROM n2", "telemetry", "faults", near=NEAR_SQL, n2=NEAR2_SQL))
def _(spark, d):
    out = tj.nearest_event(points(spark, d), ds.faults(spark, d), KEY, "ts", "fault_start", "fault_id", 2)
    return rounded(out.select("point_id", F.coalesce("nearest_fault_id", F.lit(-1)).alias("nearest_fault_id"), "nearest_minutes"), 8)


@query("c12_exclude_near", with_views("SELECT point_id FROM n2 WHERE NOT coalesce(dist <= 15, false)", "telemetry", "faults", near=NEAR_SQL, n2=NEAR2_SQL))
def _(spark, d):
    return tj.exclude_near(points(spark, d), ds.faults(spark, d), KEY, "ts", "fault_start", "fault_id", 15).select("point_id")


@query("c06_mark_in_interval", with_views("SELECT point_id, coalesce(max_fault, -1) AS current_fault_id, max_fault IS NOT NULL AS inside FROM (SELECT t.point_id, arg_max(f.fault_id, {'a': f.fault_start, 'b': f.fault_id}) AS max_fault FROM telemetry t LEFT JOIN faults f ON t.service = f.service AND t.ts BETWEEN f.fault_start AND f.fault_end GROUP BY t.point_id)", "telemetry", "faults"))
def _(spark, d):
    out = tj.mark_in_interval(points(spark, d), ds.faults(spark, d), KEY, "ts", "fault_start", "fault_end", "fault_id")
    return out.select("point_id", F.coalesce("current_fault_id", F.lit(-1)).alias("current_fault_id"), "inside")


@query("c05_time_grid", with_views("SELECT service, unnest(generate_series(time_bucket(INTERVAL '5 minutes', lo), time_bucket(INTERVAL '5 minutes', hi), INTERVAL '5 minutes')) AS ts FROM (SELECT service, min(ts) AS lo, max(ts) AS hi FROM telemetry GROUP BY service)", "telemetry"))
def _(spark, d):
    return tj.time_grid(ds.telemetry(spark, d), KEY, "ts", 5)


GRID_SQL = "SELECT service, unnest(generate_series(time_bucket(INTERVAL '5 minutes', lo), time_bucket(INTERVAL '5 minutes', hi), INTERVAL '5 minutes')) AS ts FROM (SELECT service, min(ts) AS lo, max(ts) AS hi FROM telemetry GROUP BY service)"


@query(
    "e25_horizon_labels",
    with_views(
        "SELECT service, ts, " + ", ".join(f"CASE WHEN m <= {h} THEN 1 ELSE 0 END AS incident_next_{h}m" for h in (5, 10, 15, 30))
        + f", coalesce(incident_now, 0) AS incident_now FROM (SELECT g.service, g.ts, {minutes('g.ts', 'f.fault_start')} AS m FROM grid g ASOF LEFT JOIN faults f ON g.service = f.service AND g.ts < f.fault_start) LEFT JOIN (SELECT DISTINCT service, time_bucket(INTERVAL '5 minutes', fault_start) AS ts, 1 AS incident_now FROM faults) USING (service, ts)",
        "telemetry",
        "faults",
        grid=GRID_SQL,
    ),
)
def _(spark, d):
    grid = tj.time_grid(ds.telemetry(spark, d), KEY, "ts", 5)
    out = tj.horizon_labels(grid, ds.faults(spark, d), KEY, "ts", "fault_start", "fault_id", [5, 10, 15, 30])
    return out.select("service", "ts", *[f"incident_next_{h}m" for h in (5, 10, 15, 30)], "incident_now")


@query("c21_dedup_slots", with_views("SELECT fault_id, service, grid_time FROM (SELECT *, time_bucket(INTERVAL '5 minutes', fault_start) AS grid_time, row_number() OVER (PARTITION BY service, time_bucket(INTERVAL '5 minutes', fault_start) ORDER BY fault_start, fault_id) AS rn FROM faults) WHERE rn = 1", "faults"))
def _(spark, d):
    return tj.dedup_slots(ds.faults(spark, d), KEY, "fault_start", "fault_id").select("fault_id", "service", "grid_time")


@query("b22_align_faults", with_views("SELECT fault_id, fault_start + INTERVAL '1 hour' AS fault_start, fault_end + INTERVAL '1 hour' AS fault_end FROM faults WHERE NOT duration_suspicious", "faults"))
def _(spark, d):
    f = ds.faults(spark, d).filter(~F.col("duration_suspicious"))
    return f.select("fault_id", shift(F.col("fault_start"), hours=1).alias("fault_start"), shift(F.col("fault_end"), hours=1).alias("fault_end"))


@query("b26_clip_to_range", with_views("SELECT fault_id FROM faults WHERE fault_start BETWEEN (SELECT min(ts) FROM telemetry WHERE metric = 'docker_cpu_total') AND (SELECT max(ts) FROM telemetry WHERE metric = 'docker_cpu_total')", "telemetry", "faults"))
def _(spark, d):
    cpu = ds.telemetry(spark, d).filter("metric = 'docker_cpu_total'")
    return tj.clip_to_range(ds.faults(spark, d), cpu, "fault_start", "ts").select("fault_id")


ZP_SQL = "SELECT t.*, coalesce(0.6745 * (value - m) / nullif(md, 0), 0) AS z FROM telemetry t JOIN (SELECT service, metric, quantile_cont(value, 0.5) AS m, mad(value) AS md FROM telemetry GROUP BY 1, 2) USING (service, metric)"
PHASE_SQL = """SELECT f.fault_id, f.service, p.metric, ph.phase, p.ts, p.point_id, p.value, p.z FROM faults f JOIN zp p ON p.service = f.service CROSS JOIN (VALUES ('pre_10m'), ('pre_5m'), ('pre_2m'), ('during'), ('post_5m')) ph(phase)
 WHERE CASE ph.phase WHEN 'pre_10m' THEN p.ts >= fault_start - INTERVAL '10 minutes' AND p.ts < fault_start WHEN 'pre_5m' THEN p.ts >= fault_start - INTERVAL '5 minutes' AND p.ts < fault_start WHEN 'pre_2m' THEN p.ts >= fault_start - INTERVAL '2 minutes' AND p.ts < fault_start
 WHEN 'during' THEN p.ts BETWEEN fault_start AND fault_end ELSE p.ts > fault_end AND p.ts <= fault_end + INTERVAL '5 minutes' END"""
PHASE_STATS_SQL = """SELECT fault_id, service, metric, phase, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std, min(value) AS "min", max(value) AS "max", arg_max(value, {'t': ts, 'p': point_id}) AS "last",
 CAST(sum(CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END) AS BIGINT) AS anomaly_count, avg(CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END) AS anomaly_rate, max(abs(z)) AS max_abs_z FROM ph GROUP BY 1, 2, 3, 4"""


def zscored(spark, d):
    return tsr.series_robust_z(points(spark, d), ["service", "metric"], "value", "z")


def phase_table(spark, d, make, statistics):
    f = make(ds.faults(spark, d)).select("fault_id", "service", "phase", "phase_start", "phase_end")
    return statistics(materialize(zscored(spark, d)), f, KEY, ["service", "metric"], "ts", "point_id", ["fault_id", "service", "phase"])


def phases(f):
    return tj.fault_phases(f, "fault_start", "fault_end")


@query("c10_d23_fault_windows", with_views(f'SELECT fault_id, service, metric, phase, n, {rnd("mean, median, std")}, "min", "max", "last", anomaly_count, {rnd("anomaly_rate, max_abs_z")} FROM ps', "telemetry", "faults", zp=ZP_SQL, ph=PHASE_SQL, ps=PHASE_STATS_SQL))
def _(spark, d):
    return rounded(phase_table(spark, d, phases, cor.phase_statistics))


@query("d23_change_to_during", with_views("SELECT fault_id, service, metric, " + ", ".join(f"round((dm - {p}) / abs(nullif({p}, 0)) * 100, 6) + 0.0 AS change_{p}_to_during_pct" for p in ("pre_10m", "pre_5m", "pre_2m")) + " FROM (SELECT fault_id, service, metric, max(mean) FILTER (WHERE phase = 'during') AS dm, " + ", ".join(f"max(mean) FILTER (WHERE phase = '{p}') AS {p}" for p in ("pre_10m", "pre_5m", "pre_2m")) + " FROM ps GROUP BY 1, 2, 3)", "telemetry", "faults", zp=ZP_SQL, ph=PHASE_SQL, ps=PHASE_STATS_SQL))
def _(spark, d):
    s = phase_table(spark, d, phases, cor.phase_statistics)
    return rounded(cor.change_to_during(s, ["fault_id", "service", "metric"]))


BAND_SQL = "SELECT f.fault_id, p.service, p.metric, 't-' || a || '_t-' || b AS phase, p.value, p.z FROM faults f JOIN zp p ON p.service = f.service CROSS JOIN (VALUES (15, 10), (10, 5), (5, 0)) v(a, b) WHERE p.ts >= fault_start - to_minutes(a) AND p.ts < fault_start - to_minutes(b)"


def bands(f):
    return tj.prefault_bands(f, "fault_start")


@query("c11_d24_prefault_bands", with_views(f"SELECT fault_id, metric, phase, n, {rnd('mean, median, mad, anomaly_rate')} FROM (SELECT fault_id, metric, phase, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, mad(value) AS mad, avg(CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END) AS anomaly_rate FROM bd GROUP BY 1, 2, 3)", "telemetry", "faults", zp=ZP_SQL, bd=BAND_SQL))
def _(spark, d):
    return rounded(phase_table(spark, d, bands, cor.band_statistics).drop("service"))


@query("c11_band_coverage", with_views("SELECT fault_id, " + ", ".join(f"coalesce(bool_or(phase = 't-{a}_t-{b}'), false) AS has_{a}_{b}" for a, b in ((15, 10), (10, 5), (5, 0))) + " FROM faults LEFT JOIN bd USING (fault_id) GROUP BY fault_id", "telemetry", "faults", zp=ZP_SQL, bd=BAND_SQL))
def _(spark, d):
    f = bands(ds.faults(spark, d)).select("fault_id", "service", "phase", "phase_start", "phase_end")
    counted = rank_range(points(spark, d), f, KEY, "ts", "point_id", "phase_start", "phase_end")
    has = lambda a, b: F.max((F.col("phase") == f"t-{a}_t-{b}") & (F.col("points") > 0)).alias(f"has_{a}_{b}")
    return counted.groupBy("fault_id").agg(*[has(a, b) for a, b in ((15, 10), (10, 5), (5, 0))])


HOURS = range(-8, 9)


@query(
    "c16_offset_coverage",
    with_views(
        f"""SELECT CAST(o AS INTEGER) AS offset_hours, count(*) AS faults, count(*) FILTER (WHERE hits > 0) AS covered_faults, CAST(sum(hits) AS BIGINT) AS points, round(sum(greatest(0, epoch_us(least(fe, hi)) - epoch_us(greatest(fs, lo))) / 60000000.0), 6) AS overlap_minutes FROM (
 SELECT o, m.fault_id, any_value(fs) AS fs, any_value(fe) AS fe, any_value(r.lo) AS lo, any_value(r.hi) AS hi, count(t.point_id) AS hits FROM mv m JOIN (SELECT service, min(ts) AS lo, max(ts) AS hi FROM telemetry GROUP BY 1) r ON r.service = m.service LEFT JOIN telemetry t ON t.service = m.service AND t.ts BETWEEN m.fs AND m.fe GROUP BY o, m.fault_id) GROUP BY o""",
        "telemetry",
        "faults",
        mv="SELECT *, fault_start + to_hours(o) AS fs, fault_end + to_hours(o) AS fe FROM (SELECT *, unnest(generate_series(-8, 8)) AS o FROM faults)",
    ),
)
def _(spark, d):
    return rounded(tj.offset_coverage(points(spark, d), ds.faults(spark, d), KEY, "fault_id", "fault_start", "fault_end", "ts", HOURS))


# --- case-control -----------------------------------------------------------------------
FEATURE_SQL = "SELECT service, time_bucket(INTERVAL '5 minutes', ts) AS ts, avg(value) AS value, max(value) AS peak, count(*) AS n FROM telemetry GROUP BY 1, 2"
CASE_SQL = """SELECT fault_id, horizon_minutes, f.service, case_time, value, peak, n FROM (SELECT fault_id, service, unnest([15, 10, 5]) AS horizon_minutes, grid_time FROM (SELECT *, time_bucket(INTERVAL '5 minutes', fault_start) AS grid_time, row_number() OVER (PARTITION BY service, time_bucket(INTERVAL '5 minutes', fault_start) ORDER BY fault_start, fault_id) AS rn FROM faults) WHERE rn = 1) f
 CROSS JOIN LATERAL (SELECT f.grid_time - to_minutes(f.horizon_minutes) AS case_time) JOIN ft ON ft.service = f.service AND ft.ts = case_time"""


def features(spark, d):
    return ds.telemetry(spark, d).groupBy("service", F.window("ts", "5 minutes")["start"].alias("ts")).agg(
        F.avg("value").alias("value"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n")
    )


def cases(spark, d):
    slots = tj.dedup_slots(ds.faults(spark, d), KEY, "fault_start", "fault_id").select("fault_id", "service", "grid_time")
    return tj.case_rows(slots, features(spark, d), KEY, "grid_time", "ts", [15, 10, 5])


@query("c13_case_rows", with_views(f"SELECT fault_id, horizon_minutes, service, case_time, {rnd('value, peak')}, n FROM cs", "telemetry", "faults", ft=FEATURE_SQL, cs=CASE_SQL))
def _(spark, d):
    return rounded(cases(spark, d).drop("grid_time"))


POOL_SQL = """SELECT point_id, service, ts, value FROM telemetry t WHERE NOT EXISTS (SELECT 1 FROM faults f WHERE f.service = t.service AND f.fault_start BETWEEN t.ts - INTERVAL '15 minutes' AND t.ts + INTERVAL '15 minutes')"""
CONTROL_SQL = """SELECT c.fault_id, c.horizon_minutes, c.service, c.case_time, p.point_id AS control_id, p.ts AS control_time, abs(epoch_us(p.ts) - epoch_us(c.case_time)) / 60000000.0 AS dist, hour(p.ts) = hour(c.case_time) AS same,
 count(*) FILTER (WHERE hour(p.ts) = hour(c.case_time)) OVER (PARTITION BY c.fault_id, c.horizon_minutes) AS k FROM cs c JOIN pool p ON p.service = c.service"""
MATCH_SQL = "SELECT *, row_number() OVER (PARTITION BY fault_id, horizon_minutes ORDER BY dist, control_time, control_id) AS control_rank FROM ctl WHERE k < 5 OR same"


def control_pool(spark, d):
    return tj.exclude_near(points(spark, d), ds.faults(spark, d), KEY, "ts", "fault_start", "fault_id", 15)


@query("c14_matched_controls", with_views("SELECT fault_id, horizon_minutes, control_rank, control_id, control_time, round(dist, 8) AS distance_minutes, k >= 5 AS same_hour FROM mt WHERE control_rank <= 5", "telemetry", "faults", ft=FEATURE_SQL, cs=CASE_SQL, pool=POOL_SQL, ctl=CONTROL_SQL, mt=MATCH_SQL))
def _(spark, d):
    out = tj.matched_controls(materialize(cases(spark, d)), materialize(control_pool(spark, d).select("point_id", "service", "ts")), KEY, ["fault_id", "horizon_minutes"], "case_time", "ts", "point_id")
    return rounded(out.select("fault_id", "horizon_minutes", "control_rank", "control_id", "control_time", "distance_minutes", "same_hour"), 8)


DAILY_SQL = {
    "clr": "SELECT t.* FROM telemetry t ASOF LEFT JOIN (SELECT service, fault_start - INTERVAL '15 minutes' AS a, fault_end + INTERVAL '15 minutes' AS b FROM faults) f ON f.service = t.service AND t.ts >= f.a WHERE f.b IS NULL OR t.ts > f.b",
    "cand": """SELECT f.fault_id, p.point_id AS control_id, p.ts AS control_time, least(abs(mp - mf), 1440 - abs(mp - mf)) AS minute_distance FROM (SELECT *, hour(fault_start) * 60 + minute(fault_start) AS mf FROM faults) f JOIN (SELECT *, hour(ts) * 60 + minute(ts) AS mp FROM clr) p ON p.service = f.service
 JOIN (SELECT service, min(ts) AS lo FROM telemetry GROUP BY 1) r ON r.service = f.service WHERE f.fault_start - r.lo >= INTERVAL '60 minutes' AND least(abs(mp - mf), 1440 - abs(mp - mf)) <= 30 AND abs(epoch_us(p.ts) - epoch_us(f.fault_start)) >= 3600000000""",
    "dy": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fault_id, CAST(control_time AS DATE) ORDER BY minute_distance, control_time, control_id) AS dn FROM cand) WHERE dn = 1",
}


@query("c15_daily_controls", with_views("SELECT fault_id, CAST(rn AS INTEGER) AS control_rank, CAST(minute_distance AS INTEGER) AS minute_distance, control_time, control_id FROM (SELECT *, row_number() OVER (PARTITION BY fault_id ORDER BY minute_distance, control_time, control_id) AS rn FROM dy) WHERE rn <= 3", "telemetry", "faults", **DAILY_SQL))
def _(spark, d):
    return tj.daily_controls(ds.faults(spark, d), points(spark, d), KEY, "fault_id", "fault_start", "fault_end", "ts", "point_id")


STUDY_SQL = {
    "ft": FEATURE_SQL,
    "cs": CASE_SQL,
    "pl": "SELECT f.* FROM ft f WHERE NOT EXISTS (SELECT 1 FROM faults x WHERE x.service = f.service AND x.fault_start BETWEEN f.ts - INTERVAL '15 minutes' AND f.ts + INTERVAL '15 minutes')",
    "lg": """SELECT horizon_minutes, u.feature, u.v, 1 AS y FROM cs CROSS JOIN LATERAL (VALUES ('value', cs.value), ('peak', cs.peak), ('n', CAST(cs.n AS DOUBLE))) u(feature, v)
 UNION ALL SELECT h, u.feature, u.v, 0 FROM pl CROSS JOIN (VALUES (15), (10), (5)) hh(h) CROSS JOIN LATERAL (VALUES ('value', pl.value), ('peak', pl.peak), ('n', CAST(pl.n AS DOUBLE))) u(feature, v)""",
    "rk": "SELECT *, rank() OVER (PARTITION BY horizon_minutes, feature ORDER BY v) + (count(*) OVER (PARTITION BY horizon_minutes, feature, v) - 1) / 2.0 AS r FROM lg",
    "au": """SELECT horizon_minutes, feature, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS a, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, count(DISTINCT v) AS nv,
 quantile_cont(v, 0.5) FILTER (WHERE y = 1) AS m1, quantile_cont(v, 0.5) FILTER (WHERE y = 0) AS m0, quantile_cont(v, 0.25) FILTER (WHERE y = 0) AS q1, quantile_cont(v, 0.75) FILTER (WHERE y = 0) AS q3 FROM rk GROUP BY 1, 2""",
    "rs": "SELECT horizon_minutes, feature, CASE WHEN n1 >= 10 AND n0 >= 10 AND nv >= 2 THEN greatest(a, 1 - a) END AS auc, CASE WHEN n1 >= 10 AND n0 >= 10 THEN (m1 - m0) / nullif(q3 - q1, 0) END AS effect FROM au",
}


def study(spark, d):
    """Long case-control table: every horizon's cases against the rows far from faults."""
    entry = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
    feats = F.explode(F.array(entry("value"), entry("peak"), entry("n"))).alias("e")
    case = cases(spark, d).select("horizon_minutes", feats, F.lit(1).alias("y"))
    pool = tj.exclude_near(features(spark, d), ds.faults(spark, d), KEY, "ts", "fault_start", "fault_id", 15)
    horizon = F.explode(F.array(F.lit(15), F.lit(10), F.lit(5))).alias("horizon_minutes")
    control = pool.select("*", horizon).select("horizon_minutes", feats, F.lit(0).alias("y"))
    return case.unionByName(control).select("horizon_minutes", "e.*", "y")


def study_results(spark, d):
    long = materialize(study(spark, d))
    keys = ["horizon_minutes", "feature"]
    a = evl.auc(long, keys, "y", "v", 10).select(*keys, F.col("discriminative_auc").alias("auc"))
    return a.join(evl.robust_effect(long, keys, "y", "v").select(*keys, "effect"), keys)


@query("m05_m10_case_control_auc", with_views(f"SELECT horizon_minutes, feature, {rnd('auc, effect')} FROM rs", "telemetry", "faults", **STUDY_SQL))
def _(spark, d):
    return rounded(study_results(spark, d))


SCORE_SQL = """SELECT feature, wa, persistence, strong_horizons, CASE WHEN up + dn >= 2 THEN greatest(up, dn) / (up + dn) ELSE 0.0 END AS consistency FROM (SELECT feature, CASE WHEN count(auc) > 0 THEN {wa} END AS wa, count(*) FILTER (WHERE auc >= 0.6) AS persistence, count(*) FILTER (WHERE auc >= 0.7) AS strong_horizons,
 count(*) FILTER (WHERE effect > 0) AS up, count(*) FILTER (WHERE effect < 0) AS dn FROM (SELECT *, CASE horizon_minutes WHEN 15 THEN 0.2 WHEN 10 THEN 0.3 ELSE 0.5 END AS w FROM rs) GROUP BY feature)"""
RANK_BODY = """SELECT feature, round(wa, 6) AS weighted_auc, CAST(persistence AS INTEGER) AS persistence, CAST(strong_horizons AS INTEGER) AS strong_horizons, round(consistency, 6) + 0.0 AS effect_consistency, round(sc, 6) AS signal_score, row_number() OVER (ORDER BY round(sc, 9) DESC, wa DESC, persistence DESC, feature) AS "rank"
 FROM (SELECT *, 0.6 * coalesce(greatest(0.0, (wa - 0.5) * 2), 0) + 0.25 * persistence / 3.0 + 0.15 * consistency AS sc FROM sr)"""


@query("m12_rank_signals", with_views(RANK_BODY, "telemetry", "faults", **STUDY_SQL, sr=SCORE_SQL.format(wa="sum(auc * w)")))
def _(spark, d):
    r = evl.rank_signals(materialize(study_results(spark, d)))
    return rounded(r.select("feature", "weighted_auc", "persistence", "strong_horizons", "effect_consistency", "signal_score", "rank"))


@query("m12_rank_signals_renormalized", with_views(RANK_BODY, "telemetry", "faults", **STUDY_SQL, sr=SCORE_SQL.format(wa="sum(auc * w) / sum(CASE WHEN auc IS NOT NULL THEN w END)")))
def _(spark, d):
    r = evl.rank_signals(materialize(study_results(spark, d)), renormalize=True)
    return rounded(r.select("feature", "weighted_auc", "persistence", "strong_horizons", "effect_consistency", "signal_score", "rank"))


PRE_SQL = {
    "b1": "SELECT metric, phase AS band, value, abs(z) > 3 AS an, 1 AS y FROM bd",
    "b0": "SELECT metric, band, value, abs(z) > 3 AS an, 0 AS y FROM zp CROSS JOIN (VALUES ('t-15_t-10'), ('t-10_t-5'), ('t-5_t-0')) v(band) WHERE NOT EXISTS (SELECT 1 FROM faults f WHERE f.service = zp.service AND f.fault_start BETWEEN zp.ts - INTERVAL '15 minutes' AND zp.ts + INTERVAL '15 minutes')",
    "pa": "SELECT * FROM b1 UNION ALL SELECT * FROM b0",
    "pr": "SELECT *, rank() OVER (PARTITION BY band, metric ORDER BY value) + (count(*) OVER (PARTITION BY band, metric, value) - 1) / 2.0 AS r FROM pa",
}
SIDE = {"case": 1, "control": 0}


@query(
    "m11_m15_prefault_summary",
    with_views(
        "SELECT band, metric, "
        + ", ".join(f"count(*) FILTER (WHERE y = {y}) AS {s}_n, round(avg(value) FILTER (WHERE y = {y}), 6) AS {s}_mean, round(quantile_cont(value, 0.5) FILTER (WHERE y = {y}), 6) AS {s}_median, round(mad(value) FILTER (WHERE y = {y}), 6) AS {s}_mad, round(avg(CAST(an AS INTEGER)) FILTER (WHERE y = {y}), 6) AS {s}_anomaly_rate" for s, y in SIDE.items())
        + ", round(quantile_cont(value, 0.5) FILTER (WHERE y = 1) - quantile_cont(value, 0.5) FILTER (WHERE y = 0), 6) + 0.0 AS median_difference, round(2 * (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) - 1, 6) + 0.0 AS cliffs_delta FROM pr GROUP BY band, metric",
        "telemetry",
        "faults",
        zp=ZP_SQL,
        bd=BAND_SQL,
        **PRE_SQL,
    ),
)
def _(spark, d):
    z = materialize(zscored(spark, d))
    names = ["t-15_t-10", "t-10_t-5", "t-5_t-0"]
    by_band = F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`"))])).alias("band", "times")
    cols = ["metric", "value", (F.abs("z") > 3).alias("an")]
    case = multiplicity(z, bands(ds.faults(spark, d)), KEY, "ts", "phase", names, "phase_start", "phase_end").select(*cols, by_band).filter("times > 0").withColumn("y", F.lit(1))
    far = tj.exclude_near(z, ds.faults(spark, d), KEY, "ts", "fault_start", "fault_id", 15)
    control = far.select(*cols, F.explode(F.array(*[F.lit(n) for n in names])).alias("band"), F.lit(1).cast("long").alias("times"), F.lit(0).alias("y"))
    return rounded(evl.prefault_summary(materialize(case.unionByName(control)), ["band", "metric"], "y", "value", "an", "times"))


# --- balanced risk engine ---------------------------------------------------------------
AW1 = "SELECT service, window_start, max(window_end) AS window_end, CAST(sum(total_logs) AS BIGINT) AS total_logs, max(error_rate) AS error_rate, max(error_rate_delta) AS error_rate_delta, max(volume_delta) AS volume_delta, max(unique_sources) AS unique_sources, max(unique_hosts) AS unique_hosts, CAST(sum(semantic_anomaly_count) AS BIGINT) AS semantic_anomaly_count, max(semantic_anomaly_rate) AS semantic_anomaly_rate, max(aiops_anomaly_score) AS aiops_anomaly_score, max(is_aiops_anomaly) AS is_aiops_anomaly FROM awl GROUP BY 1, 2"
MM = lambda c: f"(CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END)"
O3 = "(PARTITION BY service ORDER BY window_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
V31 = {
    **{k: v for k, v in LOGS.items() if k != "aw"},
    "awl": LOGS["aw"],
    "aw": AW1,
    "v0": "SELECT *, semantic_anomaly_rate - coalesce(lag(semantic_anomaly_rate) OVER (PARTITION BY service ORDER BY window_start), 0) AS semantic_delta FROM aw",
    "v1": f"SELECT *, greatest(0, least(1, aiops_anomaly_score)) AS sa, greatest(0, least(1, error_rate)) AS se, {MM('error_rate_delta')} AS sei, {MM('total_logs')} AS st, {MM('volume_delta')} AS sti, greatest(0, least(1, semantic_anomaly_rate)) AS ss, {MM('semantic_delta')} AS ssi, 0.6 * {MM('unique_sources')} + 0.4 * {MM('unique_hosts')} AS sm FROM v0",
    "v2": f"SELECT *, avg(sa) OVER {O3} AS ap, sum(CASE WHEN sa >= 0.65 THEN 1 ELSE 0 END) OVER {O3} AS pw, CAST(sa >= 0.5 AS INTEGER) + CAST(se >= 0.5 AS INTEGER) + CAST(st >= 0.5 AS INTEGER) + CAST(ss >= 0.5 AS INTEGER) + CAST(sm >= 0.5 AS INTEGER) AS cf FROM v1",
    "v3": """SELECT *, round(1e-9 + greatest(0, least(100, 100 * (0.25 * sa + 0.15 * ap + 0.15 * ss + 0.15 * se + 0.10 * st + 0.05 * sei + 0.05 * sti + 0.05 * ssi + 0.05 * sm) * CASE WHEN total_logs <= 1 THEN 0.35 WHEN total_logs <= 2 THEN 0.5 WHEN total_logs < 5 THEN 0.7 WHEN total_logs < 10 THEN 0.9 ELSE 1.0 END
 + CASE WHEN pw >= 3 THEN 8 WHEN pw >= 2 THEN 5 ELSE 0 END + CASE WHEN cf >= 4 THEN 8 WHEN cf >= 3 THEN 6 WHEN cf >= 2 THEN 3 ELSE 0 END + CASE WHEN total_logs >= 5 AND (sa >= 0.65 OR se >= 0.7 OR ss >= 0.7) THEN 5 ELSE 0 END)), 2) AS risk_score FROM v2""",
    "li": LI_SQL["ep"].replace("SELECT *, sum", "SELECT service, window_start, window_end, sum"),
    "inc": "SELECT service, min(window_start) AS incident_start, max(window_end) AS incident_end, row_number() OVER (ORDER BY min(window_start), service) AS num FROM li GROUP BY service, g",
    "v4": """SELECT v3.*, EXISTS (SELECT 1 FROM inc i WHERE i.service = v3.service AND v3.window_start BETWEEN i.incident_start AND i.incident_end) AS incident_now, n.num AS next_num, n.incident_start AS next_start FROM v3 ASOF LEFT JOIN inc n ON n.service = v3.service AND v3.window_start < n.incident_start""",
    "v5": """SELECT *, NOT incident_now AND coalesce(next_start - window_start <= INTERVAL '180 minutes', false) AS future_incident, (risk_score >= 45 AND cf >= 2) OR (risk_score >= 48 AND pw >= 2) OR (risk_score >= 52 AND (sa >= 0.65 OR (total_logs >= 5 AND (se >= 0.7 OR ss >= 0.7)))) OR (risk_score >= 55 AND total_logs >= 5) AS logic FROM v4""",
    "v6": "SELECT *, NOT incident_now AND future_incident AND risk_score >= 40 AND logic AS early_warning, NOT incident_now AND NOT future_incident AND risk_score >= 40 AND logic AS false_positive_warning FROM v5",
}


def v31_sql(body: str, **extra: str) -> str:
    return with_views(body, "log_lines", **V31, **extra)


def v31_windows(spark, d):
    """One row per (service, window): a window can hold the end of a block and the start
    of the next one."""
    w = anomalous_log_windows(spark, d)
    top = ["window_end", "error_rate", "error_rate_delta", "volume_delta", "unique_sources", "unique_hosts", "semantic_anomaly_rate", "aiops_anomaly_score", "is_aiops_anomaly"]
    merged = w.groupBy("service", "window_start").agg(*[F.max(c).alias(c) for c in top], *[F.sum(c).alias(c) for c in ("total_logs", "semantic_anomaly_count")])
    return materialize(merged)


def v31_warnings(spark, d):
    w = v31_windows(spark, d)
    incidents = materialize(log_incidents(w, KEY, 60).withColumn("number", F.regexp_extract("incident_id", r"(\d+)$", 1).cast("long")))
    scored = materialize(risk.risk_score_v31(w, KEY))
    plain = incidents.select("service", "incident_start", "incident_end", F.col("number").alias("incident_id"))
    found = risk.future_incidents(scored, plain, KEY, 180)
    return materialize(risk.warning_flags(found)), plain


@query(
    "f10_risk_score_v31",
    v31_sql(
        """SELECT service, window_start, risk_score, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 coalesce(nullif(concat_ws(' | ', CASE WHEN sa >= 0.65 THEN 'STRONG_AIOPS_ANOMALY' END, CASE WHEN se >= 0.7 THEN 'HIGH_ERROR_RATE' END, CASE WHEN sei >= 0.7 THEN 'RAPID_ERROR_RATE_INCREASE' END, CASE WHEN ss >= 0.7 THEN 'HIGH_SEMANTIC_ANOMALY' END, CASE WHEN ssi >= 0.7 THEN 'RAPID_SEMANTIC_INCREASE' END, CASE WHEN st >= 0.7 THEN 'HIGH_TRAFFIC_VOLUME' END,
 CASE WHEN sti >= 0.7 THEN 'RAPID_TRAFFIC_INCREASE' END, CASE WHEN sm >= 0.7 THEN 'MULTI_SERVICE_ACTIVITY' END, CASE WHEN pw >= 2 THEN 'ANOMALY_PERSISTENCE' END, CASE WHEN cf >= 2 THEN 'MULTI_SIGNAL_CONFIRMATION' END, CASE WHEN total_logs < 5 THEN 'LOW_EVENT_VOLUME' END), ''), 'LOW_CONFIDENCE_OPERATIONAL_SIGNAL') AS risk_reason FROM v3"""
    ),
)
def _(spark, d):
    return risk.risk_score_v31(v31_windows(spark, d), KEY).select("service", "window_start", "risk_score", "risk_level", "risk_reason")


@query("f11_warning_flags", v31_sql("SELECT service, window_start, incident_now, future_incident, early_warning, early_warning AND risk_score >= 60 AS high_risk_warning, false_positive_warning FROM v6"))
def _(spark, d):
    w, _ = v31_warnings(spark, d)
    return w.select("service", "window_start", "incident_now", "future_incident", "early_warning", "high_risk_warning", "false_positive_warning")


EVAL_SQL = "SELECT i.num AS incident_id, i.incident_start, max(date_diff('microsecond', v.window_start, i.incident_start) / 60000000.0) AS lead, arg_max(v.risk_score, -epoch_us(v.window_start)) AS score FROM inc i LEFT JOIN v6 v ON v.early_warning AND v.next_num = i.num GROUP BY 1, 2"


@query("m13_incident_warnings", v31_sql("SELECT incident_id, incident_start, lead IS NOT NULL AS preceded_by_warning, round(lead, 6) AS lead_time_minutes, round(score, 6) AS warning_risk_score FROM el", el=EVAL_SQL))
def _(spark, d):
    w, incidents = v31_warnings(spark, d)
    e = risk.incident_warnings(w, incidents, KEY, ["incident_id"])
    return rounded(e.select("incident_id", "incident_start", "preceded_by_warning", "lead_time_minutes", "warning_risk_score"))


VERSION_SQL = """SELECT '{v}' AS version, incidents, preceded, round(preceded * 100.0 / incidents, 6) AS incident_coverage, round(c5 * 100.0 / incidents, 6) AS coverage_5m_pct, round(c10 * 100.0 / incidents, 6) AS coverage_10m_pct, round(c15 * 100.0 / incidents, 6) AS coverage_15m_pct, ew AS early_warning_windows, fw AS false_positive_windows,
 round(coalesce(ew * 100.0 / nullif(ew + fw, 0), 0), 6) AS warning_precision, round(coalesce(ml, 0), 6) AS mean_lead_time, round(coalesce(md, 0), 6) AS median_lead_time FROM (SELECT count(*) AS incidents, count(lead) AS preceded, count(*) FILTER (WHERE lead >= 5) AS c5, count(*) FILTER (WHERE lead >= 10) AS c10, count(*) FILTER (WHERE lead >= 15) AS c15, avg(lead) AS ml, quantile_cont(lead, 0.5) AS md FROM {e}),
 (SELECT count(*) FILTER (WHERE {w}) AS ew, count(*) FILTER (WHERE false_positive_warning) AS fw FROM v6)"""


@query(
    "m14_version_comparison",
    v31_sql(
        VERSION_SQL.format(v="v3.1", e="el", w="early_warning") + " UNION ALL " + VERSION_SQL.format(v="v3.1-high", e="eh", w="early_warning AND risk_score >= 60"),
        el=EVAL_SQL,
        eh=EVAL_SQL.replace("v.early_warning", "v.early_warning AND v.risk_score >= 60"),
    ),
)
def _(spark, d):
    w, incidents = v31_warnings(spark, d)
    strict = w.withColumn("early_warning", F.col("high_risk_warning"))
    tables = [risk.evaluate_warnings(materialize(risk.incident_warnings(x, incidents, KEY, ["incident_id"])), x, v) for v, x in (("v3.1", w), ("v3.1-high", strict))]
    return rounded(risk.compare_versions(tables))
