"""Validation, declarative checks, profiling, cross-tabs and label conflicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.timefn import floor_to
from faultline.operators.events import failure_mask
from faultline.operators.incidents import top_k, top_k_by
from faultline.operators.quantiles import quantiles_by
from faultline.operators.skew import join_on
from faultline.session import materialize


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def validate_table(df: DataFrame, required: list[str], not_null: list[str], unique: list[str]) -> DataFrame:
    """Row count, null counts and duplicate counts of a table in one pass."""
    require_columns(df, required)
    checks = [F.count(F.lit(1)).alias("rows")]
    checks += [F.count_if(F.col(c).isNull()).alias(c + "_nulls") for c in not_null]
    out = df.agg(*checks, *[F.count_distinct(c).alias("_d_" + c) for c in unique], *[F.count(c).alias("_n_" + c) for c in unique])
    dupes = {c + "_duplicates": F.col("_n_" + c) - F.col("_d_" + c) for c in unique}
    return out.withColumns({**dupes, "is_empty": F.col("rows") == 0}).drop(*["_d_" + c for c in unique], *["_n_" + c for c in unique])


def run_checks(df: DataFrame, rules: list[tuple[str, str, list[str] | None]]) -> DataFrame:
    """Failing rows per rule; a rule is (column, 'not_null' or 'accepted_values', values)."""

    def failing(column: str, kind: str, values: list[str] | None) -> Column:
        c = F.col(column)
        return c.isNull() if kind == "not_null" else c.isNotNull() & ~c.isin(values)

    counts = df.agg(*[F.count_if(failing(*r)).alias(f"_{i}") for i, r in enumerate(rules)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("rule"), F.col(f"_{i}").alias("failing_rows")) for i, (c, k, _) in enumerate(rules)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("passed", F.col("failing_rows") == 0)


def check_labels(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Labels missing from the data and labels that were not expected."""
    spark = df.sparkSession
    found = df.select(F.col(column).alias("label")).filter(F.col("label").isNotNull()).distinct()
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in expected])).alias("label"))
    tag = lambda d, name: d.select("label", F.lit(name).alias("problem"))
    return tag(wanted.exceptAll(found), "missing").unionByName(tag(found.exceptAll(wanted), "unexpected"))


def coerce_timestamp(df: DataFrame, column: str) -> DataFrame:
    """Text to timestamp; rows whose text is not a time drop."""
    return df.withColumn(column, F.try_to_timestamp(column)).filter(F.col(column).isNotNull())


def auto_timestamp(df: DataFrame, column: str, ratio: float = 0.95) -> DataFrame:
    """Epoch milliseconds when more than ``ratio`` of the values are numbers, else text."""
    number = F.col(column).try_cast("double")
    numeric = df.agg(F.coalesce(F.avg(number.isNotNull().cast("int")) > ratio, F.lit(False))).scalar()
    parsed = F.when(numeric, F.timestamp_millis(number.cast("long"))).otherwise(F.try_to_timestamp(F.col(column)))
    return df.withColumn(column, parsed)


def reject_bad_series(df: DataFrame, keys: list[str], ts: str, value: str, min_ts: float = 0.8, min_value: float = 0.5) -> DataFrame:
    """Series with enough parseable times and values."""
    good = df.groupBy(*keys).agg(
        F.avg(F.col(ts).isNotNull().cast("int")).alias("_t"), F.avg(F.col(value).isNotNull().cast("int")).alias("_v")
    ).filter((F.col("_t") >= min_ts) & (F.col("_v") >= min_value))
    return join_on(df, good, keys, "left_semi")


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to number; unparseable, infinite and missing values become 0."""
    parsed = {c: F.col(c).try_cast("double") for c in columns}
    finite = {c: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for c, v in parsed.items()}
    return df.withColumns({c: F.coalesce(v, F.lit(0.0)) for c, v in finite.items()})


def fill_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def drop_leakage(df: DataFrame, target: str, known: list[str] = ()) -> DataFrame:
    """Remove columns derived from the target: other horizons, times to the next event and
    the given names. The target itself stays."""
    # Name parts of target-derived columns.
    parts = ("incident_next_", "minutes_to_next", "next_fault", "next_incident", "incident_now", "future_")
    leaking = [c for c in df.columns if c != target and (c in known or c.startswith(parts))]
    return df.drop(*leaking)


def impute_median(df: DataFrame, keys: list[str], columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """Exact median of the group (or of the training rows), then 0."""
    source = df if fit_on is None else df.filter(fit_on)
    medians = quantiles_by(source, keys, {"_m_" + c: (c, 0.5) for c in columns})
    if keys:
        joined = join_on(df, medians, keys, "left")
    else:
        row = medians.select(F.struct("*").alias("m")).scalar()
        joined = df.withColumns({"_m_" + c: row["_m_" + c] for c in columns})
    return joined.withColumns({c: F.coalesce(c, "_m_" + c, F.lit(0.0)) for c in columns}).drop(*["_m_" + c for c in columns])


# --- profiling ---------------------------------------------------------------------------


def profile_columns(df: DataFrame) -> DataFrame:
    """A row for each column: type, missing, distinct values, and for numbers min, mean, max, std and quartiles.

    Two passes: one aggregate, and (column, value) counts, which combine before they move and give the distinct values; distincts in one aggregate would
    repeat every row for each column."""
    cells = []
    for f in df.schema.fields:
        numeric = isinstance(f.dataType, T.NumericType)
        number = F.col(f.name).cast("double") if numeric else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).cast("string").alias("value"), number.alias("x")))
    counts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("column_name", "value", "x").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts)
    n, x = F.col("n"), F.col("x")
    rows = F.sum(F.when(x.isNotNull(), n))
    mean = F.sum(x * n) / rows
    found = quantiles_by(
        counts, ["column_name"], {f"q{int(q * 100)}": ("x", q) for q in (0.25, 0.5, 0.75)},
        [F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("missing"), F.count("value").alias("unique_values"), F.min("x").alias("min"), mean.alias("mean"), F.max("x").alias("max"), rows.alias("_rows")], "n",
    )
    apart = join_on(counts, found.select("column_name", "mean"), ["column_name"])
    spread = apart.groupBy("column_name").agg(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))).alias("_apart"))
    out = join_on(found, spread, ["column_name"], "left").withColumn("std", F.sqrt(F.col("_apart") / F.nullif(F.col("_rows") - 1, F.lit(0))))
    kinds = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, data_type string")
    out = kinds.join(out, "column_name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("missing", "unique_values")})
    return out.select("column_name", "data_type", "missing", "unique_values", "min", "mean", "max", "std", "q25", "q50", "q75")


def top_values(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """The k most frequent values of every column with their share; null is a value."""
    total = df.agg(F.count(F.lit(1))).scalar()
    entry = lambda c: F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value"))
    counts = df.select(F.explode(F.array(*[entry(c) for c in columns])).alias("e")).groupBy("e.column_name", "e.value").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_k_by(counts, ["column_name"], [F.col("n").desc(), F.col("value")], k)
    return ranked.withColumn("percent", F.col("n") / total * 100)


def profile_events(df: DataFrame) -> DataFrame:
    """HTTP classes, latency limits, empty messages and duplicates in one row."""
    code, ms = F.col("status_code"), F.col("duration_ms")
    classes = {f"http_{c}xx": F.count_if((code >= c * 100) & (code < c * 100 + 100)) for c in (2, 3, 4, 5)}
    slow = {f"slower_{m}ms": F.count_if(ms > m) for m in (100, 500, 1000)}
    failing = failure_mask(F.col("event_type"), code)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct(*df.columns))).alias("duplicates"),
        *[c.alias(n) for n, c in {**classes, **slow}.items()],
        F.count_if(failing).alias("failure_rows"),
        (F.count_if(failing) / F.count(F.lit(1)) * 100).alias("failure_percent"),
    )


def profile_time(df: DataFrame, ts: str) -> DataFrame:
    """Row counts by hour, day of week, date and month."""
    entry = lambda n, c: F.struct(F.lit(n).alias("unit"), c.cast("string").alias("value"))
    t = F.col(ts)
    parts = F.array(entry("hour", F.hour(t)), entry("day_of_week", F.weekday(t)), entry("date", F.to_date(t)), entry("month", F.date_format(t, "yyyy-MM")))
    return df.select(F.explode(parts).alias("e")).groupBy("e.unit", "e.value").agg(F.count(F.lit(1)).alias("n"))


def profile_text(df: DataFrame, column: str) -> DataFrame:
    """Length statistics of a text column."""
    sized = df.select(F.col(column).alias("t"), F.length(column).alias("size"))
    return quantiles_by(
        sized, [], {"median_length": ("size", 0.5)},
        [
            F.count_if(F.coalesce(F.trim("t"), F.lit("")) == "").alias("empty"),
            F.min("size").alias("min_length"),
            F.avg("size").alias("mean_length"),
            F.max("size").alias("max_length"),
        ],
    )


def hourly_failures(df: DataFrame, ts: str, worst: int | None = None) -> DataFrame:
    """Failure rate per hour; the ``worst`` hours when asked for."""
    hours = df.groupBy(floor_to(F.col(ts), "1 hour").alias("hour_start")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("failure_signal").alias("failures")
    )
    hours = hours.withColumn("failure_rate", F.col("failures") / F.col("events"))
    return hours if worst is None else top_k(hours, [F.col("failure_rate").desc(), F.col("events").desc(), F.col("hour_start")], worst)


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") / df.agg(F.count(F.lit(1))).scalar() * 100)


def crosstab(df: DataFrame, a: str, b: str, columns: list[str] | None = None) -> DataFrame:
    """Counts of a x b and their share of the row, in percent."""
    counted = df.groupBy(a).pivot(b, columns).count().na.fill(0)
    names = [c for c in counted.columns if c != a]
    total = sum((F.col(f"`{c}`") for c in names), F.lit(0))
    return counted.withColumns({"row_total": total, **{c + "_pct": F.col(f"`{c}`") / total * 100 for c in names}})


def duplicate_conflicts(df: DataFrame, text: Column, label: str) -> DataFrame:
    """Texts that occur more than once, with their labels. A group keeps one row per label,
    so a text that makes up a third of the table stays one small row."""
    per_label = df.filter(text != "").groupBy(text.alias("text"), F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    groups = per_label.groupBy("text").agg(
        F.sum("_n").alias("copies"),
        F.count(F.lit(1)).alias("label_count"),
        F.array_join(F.array_sort(F.collect_set("_label")), ", ").alias("labels"),
    )
    return groups.filter(F.col("copies") > 1).withColumn("conflicting", F.col("label_count") > 1)


def duplicate_count(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*columns))).alias("duplicates"))


def text_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct texts of both sets, shared texts, share of the smaller set, subset flags."""
    left, right = a.select(column).distinct(), b.select(column).distinct()
    sides = left.select(column, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(column, F.lit(0).alias("a"), F.lit(1).alias("b")))
    merged = sides.groupBy(column).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = merged.agg(F.sum("a").alias("texts_a"), F.sum("b").alias("texts_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"))
    return out.withColumns(
        {
            "overlap_percent": F.try_divide(F.col("shared") * 100.0, F.least("texts_a", "texts_b")),
            "a_within_b": F.col("shared") == F.col("texts_a"),
            "b_within_a": F.col("shared") == F.col("texts_b"),
        }
    )


def stable_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows whose ids have the smallest MD5: repeatable and independent of row order. A bound on the hash, from the row
    count, leaves little more than n rows to be ordered."""
    key, total = F.md5(F.col(id_col).cast("string")), df.count()
    few, share = df, (n + 10 * math.sqrt(n) + 50) / max(total, 1)
    if share < 1:
        below = df.filter(F.substring(key, 1, 8) <= f"{int(share * (1 << 32)):08x}")
        few = below if below.count() >= n else df
    return few.orderBy(key, id_col).limit(n)


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None) -> DataFrame:
    values = values or [c for c in df.columns if c not in ids]
    return df.unpivot(ids, values, "metric", "value")


def recent_metrics(df: DataFrame, ts: str, at: Column, minutes: int, ids: list[str], values: list[str]) -> DataFrame:
    """Rows of the last ``minutes`` up to a time, in long form."""
    near = df.filter((F.col(ts) <= at) & (F.col(ts) >= at - F.make_dt_interval(mins=F.lit(minutes))))
    return melt(near.select(*ids, *values), ids, values)


# Columns that are never features.
NO_METRICS = [
    "timestamp", "incident_now", "incident_next_5m", "incident_next_10m", "incident_next_15m", "incident_next_30m",
    "minutes_to_next_fault", "next_fault_timestamp", "fault_timestamp",
]


def select_base_metrics(df: DataFrame, limit: int = 115, exclude: list[str] = ()) -> list[str]:
    """Numeric columns for modelling: those with "_mean" anywhere in their name first, in any case of letters, then the others."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (*NO_METRICS, *exclude)]
    means = [c for c in numeric if "_mean" in c.lower()]
    return (means + [c for c in numeric if c not in means])[:limit]
