"""Lags, rolling statistics and detectors over keyed series.

Every operator takes a ``Timeline`` and returns one, so a chain of them shares one
partitioning: one shuffle for the chain, hot series cut in slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.quantiles import quantiles_by
from faultline.operators.skew import SLICE, Timeline, join_on

# Frame lengths and thresholds of the detectors.
ROLLING, MINIMUM, ROBUST_Z_LIMIT, MAD_LIMIT, EWMA_SPAN, EWMA_LIMIT = 15, 5, 3.5, 3.5, 20, 3.0
MAD_TO_SIGMA, SIGMA_TO_MAD = 1.4826, 0.6745
EWMA_BLOCK = 256


def frame(w, n: int, past_only: bool = False):
    """The last n rows, with or without the current one."""
    return w.rowsBetween(-n, -1) if past_only else w.rowsBetween(-(n - 1), Window.currentRow)


def lags(columns: list[str], steps: int, fill: float | None = None):
    def stage(w):
        shifted = {f"{c}_lag_{n}": F.lag(c, n).over(w) for c in columns for n in range(1, steps + 1)}
        return shifted if fill is None else {n: F.coalesce(c, F.lit(fill)) for n, c in shifted.items()}

    return stage


def lead(column: str, output: str):
    return lambda w: {output: F.lead(column, 1).over(w)}


def deltas(column: str, steps: list[int]):
    """Differences over the given steps and the second difference."""

    def stage(w):
        c = F.col(column)
        out = {f"{column}_delta_{n}": c - F.lag(c, n).over(w) for n in steps}
        out[f"{column}_delta2"] = c - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)
        return out

    return stage


def pct_change(column: str, output: str, mode: str = "null", step: int = 1):
    """Relative change to the value ``step`` rows ago.

    null: in percent, null after a zero; clipped: eps-guarded and clipped to +/-10;
    ratio: current / previous - 1.
    """

    def stage(w):
        c, previous = F.col(column), F.lag(column, step).over(w)
        if mode == "null":
            change = F.try_divide(c - previous, F.abs(previous)) * 100
        elif mode == "clipped":
            change = F.when(
                c.isNotNull() & previous.isNotNull(),
                F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (c - previous) / (F.abs(previous) + 1e-6))),
            )
        else:
            change = F.try_divide(c, previous) - 1
        return {output: change}

    return stage


def rolling(column: str, n: int, aggregates: list[str], minimum: int = 1, past_only: bool = False, prefix: str | None = None):
    """Rolling statistics, null until ``minimum`` non-null values are in the frame."""
    functions = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "sum": F.sum,
        "median": lambda c: F.percentile(c, F.lit(0.5)),
        "q25": lambda c: F.percentile(c, F.lit(0.25)),
        "q75": lambda c: F.percentile(c, F.lit(0.75)),
    }

    def stage(w):
        over = frame(w, n, past_only)
        enough = F.count(column).over(over) >= minimum
        return {f"{column if prefix is None else prefix}_{a}": F.when(enough, functions[a](column).over(over)) for a in aggregates}

    return stage


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    low, high = F.try_element_at(s, ((n + 1) / 2).cast("int")), F.try_element_at(s, (n / 2 + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def rolling_mad(column: str, n: int, minimum: int, output: str, past_only: bool = False):
    """Median absolute deviation from the frame's own median. Frames are a few rows."""

    def stage(w):
        values = F.collect_list(F.col(column).cast("double")).over(frame(w, n, past_only))
        return {"_frame": values}

    def second(_w):
        centre = _median(F.col("_frame"))
        mad = _median(F.transform("_frame", lambda x: F.abs(x - F.col("_centre"))))
        return {output: F.when(F.size("_frame") >= minimum, mad)}

    return [stage, lambda _w: {"_centre": _median(F.col("_frame"))}, second]


def robust_z(value: Column, median: Column, mad: Column, on_zero_mad: str = "zero", scale: str = "inverse") -> Column:
    """Robust z-score; ``scale`` is 0.6745 * d / mad ('inverse') or d / (1.4826 * mad)."""
    guarded = mad + 1e-9 if on_zero_mad == "eps" else F.nullif(mad, F.lit(0.0))
    deviation = value - median
    z = F.lit(SIGMA_TO_MAD) * deviation / guarded if scale == "inverse" else deviation / (F.lit(MAD_TO_SIGMA) * guarded)
    return F.coalesce(z, F.lit(0.0)) if on_zero_mad == "zero" else z


def ewma(line: Timeline, column: str, output: str, span: int = EWMA_SPAN, rows: int = EWMA_BLOCK) -> Timeline:
    """Exponentially weighted mean without bias adjustment, exact for any number of nulls and slices.

    Inside a slice the recursion is solved in blocks of ``rows`` known values: a scaled running sum in the block plus the decayed
    result of the block before (older ones weigh less than double precision resolves). What a slice starts with is the mean at the end
    of the slice before, found by one fold over the slices of a key; the first one starts with the first known value.
    """
    alpha = 2.0 / (span + 1)
    q, place = F.lit(1 - alpha), F.col("_place")
    w = line.window()
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    block = Window.partitionBy(*line.keys, SLICE, "_block").orderBy(*line.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("_local") + F.pow(q, place + 1) * F.coalesce(F.col("_carry"), F.lit(0.0))
    df = line.df.withColumn("_known", F.count(column).over(so_far))
    df = df.withColumns({"_place": F.pmod(F.col("_known") - 1, F.lit(rows)).cast("double"), "_block": F.floor((F.col("_known") - 1) / rows), "_share": F.coalesce(F.col(column) * F.lit(alpha), F.lit(0.0))})
    df = df.withColumn("_local", F.pow(q, place) * F.sum(F.col("_share") * F.pow(q, -place)).over(block))
    for source, target in (("_local", "_two"), ("_two", "_inside")):
        df = df.withColumn("_end", F.when(F.lead("_block").over(w) > F.col("_block"), F.col(source)))
        df = df.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).withColumn(target, total)
    df = df.withColumn("_inside", F.when(F.col("_known") > 0, F.col("_inside")).otherwise(F.lit(0.0)))
    if line.sliced:
        at = F.struct(*line.order)
        ends = df.groupBy(*line.keys, SLICE).agg(F.max_by("_inside", at).alias("inside"), F.max("_known").alias("n"), F.min_by(column, F.when(F.col(column).isNotNull(), at)).alias("first"))
        slices = ends.groupBy(*line.keys).agg(F.array_sort(F.collect_list(F.struct(SLICE, "inside", "n", "first"))).alias("_all"))  # rows of a key / row limit

        def step(done: Column, s: Column) -> Column:
            start = F.coalesce(done["mean"], s["first"])
            after = F.when(s["n"] > 0, s["inside"] + F.pow(q, s["n"]) * start).otherwise(done["mean"])
            return F.struct(F.concat(done["starts"], F.array(F.struct(s[SLICE].alias(SLICE), done["mean"].alias("_start")))).alias("starts"), after.alias("mean"))

        none = F.struct(F.array().cast(f"array<struct<{SLICE}:int,_start:double>>").alias("starts"), F.lit(None).cast("double").alias("mean"))
        starts = slices.select(*line.keys, F.explode(F.aggregate("_all", none, step)["starts"]).alias("_s")).select(*line.keys, "_s.*")
        df = join_on(df, starts, [*line.keys, SLICE], "left")
    else:
        df = df.withColumn("_start", F.lit(None).cast("double"))
    start = F.coalesce("_start", F.first(column, ignorenulls=True).over(so_far).cast("double"))
    df = df.withColumn("_start", start).withColumn(output, F.when(F.col("_start").isNotNull(), F.col("_inside") + F.pow(q, F.col("_known")) * F.col("_start")))
    return line.columns_of(df.drop("_known", "_place", "_block", "_share", "_local", "_end", "_carry", "_two", "_inside", "_start"))


def detectors(line: Timeline, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Robust z, rolling MAD and EWMA detectors with scores and 0/1 predictions."""
    median, mad, deviation = F.col("_median"), F.col("_mad"), F.col("median_deviation")
    line = ewma(line, value, "ewma").frames(
        rolling(value, ROLLING, ["median", "q25", "q75", "std"], MINIMUM, prefix=""),
        *rolling_mad(value, ROLLING, MINIMUM, "_mad"),
        lambda w: {"ewma_residual": F.col(value) - F.col("ewma"), "_before": F.lag(value).over(w)},
        rolling("ewma_residual", ROLLING, ["std"], MINIMUM, prefix="_residual"),
        before=ROLLING,
    )
    df = line.columns({"median_deviation": F.col(value) - median}).result("_frame", "_centre")
    keys = keys if keys is not None else line.keys
    spread = quantiles_by(df, keys, {"_series_std": ("_residual_std", 0.5)})
    df = join_on(df, spread, keys, "left")
    std = F.coalesce(F.nullif("_residual_std", F.lit(0.0)), F.col("_series_std"))
    df = df.withColumns(
        {
            "robust_z_score": F.abs(robust_z(F.col(value), median, mad)),
            "rolling_mad_score": F.coalesce(F.abs(deviation) / (F.nullif(mad, F.lit(0.0)) + 1e-9), F.lit(0.0)),
            "ewma_score": F.abs(F.coalesce(F.try_divide(F.col("ewma_residual"), std), F.lit(0.0))),
            "iqr": F.col("_q75") - F.col("_q25"),
            "rolling_std": F.coalesce("_std", F.lit(0.0)),
            "relative_change": F.coalesce(F.try_divide(F.col(value) - F.col("_before"), F.abs("_before")), F.lit(0.0)),
        }
    )
    limits = {"robust_z": ROBUST_Z_LIMIT, "rolling_mad": MAD_LIMIT, "ewma": EWMA_LIMIT}
    df = df.withColumns({n + "_prediction": (F.col(n + "_score") >= limit).cast("int") for n, limit in limits.items()})
    return df.drop("_median", "_mad", "_q25", "_q75", "_std", "_before", "_residual_std", "_series_std")


def past_robust_z(column: str, output: str, n: int = 12, minimum: int = 3):
    """Stages that score the current value against the previous n rows only."""
    return [
        rolling(column, n, ["median"], minimum, past_only=True, prefix="_past"),
        *rolling_mad(column, n, minimum, "_past_mad", past_only=True),
        lambda _w: {output: robust_z(F.col(column), F.col("_past_median"), F.col("_past_mad"), "null", "sigma")},
    ]


def votes(df: DataFrame, predictions: list[str], scores: list[str], minimum: int = 1) -> DataFrame:
    """Number of detectors that fired, the largest score and the combined flag."""
    total = sum((F.coalesce(p, F.lit(0)) for p in predictions), F.lit(0))
    top = F.greatest(*[F.col(s) for s in scores]) if len(scores) > 1 else F.col(scores[0])
    return df.withColumns(
        {
            "metric_anomaly_votes": total,
            "metric_anomaly": (total >= minimum).cast("int"),
            "metric_anomaly_score": F.coalesce(top, F.lit(0.0)),
        }
    )


def robust_scale(df: DataFrame, keys: list[str], column: str, output: str, fit_on: Column | None = None, limit: float = 20.0) -> DataFrame:
    """(x - median) / IQR per series, clipped; fitted on all rows or on those of ``fit_on``."""
    source = df if fit_on is None else df.filter(fit_on)
    fitted = quantiles_by(source, keys, {"_q1": (column, 0.25), "_q2": (column, 0.5), "_q3": (column, 0.75)})
    scaled = (F.col(column) - F.col("_q2")) / F.nullif(F.col("_q3") - F.col("_q1"), F.lit(0.0))
    bounded = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce(scaled, F.lit(0.0))))
    return join_on(df, fitted, keys, "left").withColumn(output, bounded).drop("_q1", "_q2", "_q3")


def series_robust_z(df: DataFrame, keys: list[str], column: str, output: str, on_zero_mad: str = "zero", scale: str = "inverse") -> DataFrame:
    """Robust z-score against the whole series: two exact median passes."""
    centred = join_on(df, quantiles_by(df, keys, {"_median": (column, 0.5)}), keys, "left")
    centred = centred.withColumn("_deviation", F.abs(F.col(column) - F.col("_median")))
    full = join_on(centred, quantiles_by(centred, keys, {"_mad": ("_deviation", 0.5)}), keys, "left")
    z = robust_z(F.col(column), F.col("_median"), F.col("_mad"), on_zero_mad, scale)
    return full.withColumn(output, z).drop("_median", "_deviation", "_mad")


def time_split(df: DataFrame, keys: list[str], order: list[str], shares: dict[str, float], output: str = "split") -> DataFrame:
    """Chronological split. ``shares`` are cumulative, such as {'train': .7, 'test': 1}."""
    numbered = Timeline(df, keys, order).running({"_at": ("sum", F.lit(1))}).result()
    sized = join_on(numbered, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")), keys, "left") if keys else (
        numbered.withColumn("_all", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    )
    split = F.lit(None).cast("string")
    for name, share in reversed(list(shares.items())):
        last = F.floor(F.col("_all") * F.lit(share) + 1e-9)
        split = F.when(F.col("_at") <= last, name).otherwise(split)
    return sized.withColumn(output, split).drop("_at", "_all")


def fill_gaps(line: Timeline, columns: list[str]) -> Timeline:
    """Forward fill, then backward fill, then 0."""
    line = line.running({"_f_" + c: ("last", F.col(c)) for c in columns})
    line = line.running({"_b_" + c: ("last", F.col(c)) for c in columns}, reverse=True)
    filled = {c: F.coalesce("_f_" + c, "_b_" + c, F.lit(0.0)) for c in columns}
    return line._with(line.columns(filled).df.drop(*["_f_" + c for c in columns], *["_b_" + c for c in columns]))


def sequences(line: Timeline, features: list[str], length: int, label: str) -> DataFrame:
    """Sliding sequences of ``length`` feature rows with the label of the last row."""

    def stage(w):
        row = F.array(*[F.col(c).cast("double") for c in features])
        return {"sequence": F.collect_list(row).over(frame(w, length)), "target": F.col(label)}

    return line.frames(stage, before=length - 1).result().filter(F.size("sequence") == length)


def temporal_matrix(df: DataFrame, keys: list[str], ts: str, value: str, serving: bool = False) -> DataFrame:
    """Twelve features per (series, time) in long form: base, 3 lags, 3 deltas, 3 relative
    changes, rolling mean and std of 3. Training uses past rows only; ``serving`` includes
    the current row and leaves the change unclipped."""
    stages = [lags([value], 3)]
    stages.append(lambda w: {f"delta_{n}": F.col(value) - F.col(f"{value}_lag_{n}") for n in (1, 2, 3)})
    for n in (1, 2, 3):
        stages.append(pct_change(value, f"pct_change_{n}", "ratio" if serving else "clipped", n))
    stages.append(rolling(value, 3, ["mean"], 1, not serving, "rolling"))
    stages.append(rolling(value, 3, ["std"], 2, not serving, "rolling"))
    return Timeline(df, keys, [ts]).frames(*stages, before=3).result()
