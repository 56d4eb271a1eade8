"""Exact, linearly interpolated quantiles per group at any group size.

``percentile`` keeps the distinct values of a group in the memory of one task. That is
right for groups below the row limit. Larger groups are solved by rank selection: the
values are pre-aggregated, cut into equi-depth ranges, the ranges counted, and only the
ranges that hold a wanted rank are ordered.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.skew import heavy_groups, join_on, range_bucket

Wanted = dict[str, tuple[str, float]]


def quantiles_by(df: DataFrame, keys: Iterable[str], wanted: Wanted, aggregates: Iterable[Column] = (), weight: str | None = None) -> DataFrame:
    """groupBy(keys) with ``aggregates`` and the exact quantiles ``{alias: (column, q)}``. ``weight``: a whole number of times that a row counts in the quantiles."""
    keys, aggregates = list(keys), list(aggregates)
    exact = [F.percentile(c, F.lit(q), F.lit(1) if weight is None else F.col(weight)).alias(n) for n, (c, q) in wanted.items()]
    heavy = heavy_groups(df, keys)
    if heavy is None:
        return df.groupBy(*keys).agg(*aggregates, *exact)
    selected = _rank_select(join_on(df, heavy, keys, "left_semi") if keys else df, keys, wanted, weight)
    if keys:
        light = join_on(df, heavy, keys, "left_anti").groupBy(*keys).agg(*exact)
        selected = selected.unionByName(light)
    if not aggregates:
        return selected
    return join_on(df.groupBy(*keys).agg(*aggregates), selected, keys, "left") if keys else _one_row(
        df.agg(*aggregates), selected
    )


def _one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def _rank_select(df: DataFrame, keys: list[str], wanted: Wanted, weight: str | None = None) -> DataFrame:
    columns = sorted({c for c, _ in wanted.values()})
    parts = [
        df.filter(F.col(c).isNotNull())
        .select(*keys, F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_weight"))
        for c in columns
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    group = [*keys, "_column"]
    values = stacked.groupBy(*group, "_value").agg(F.sum("_weight").alias("_n"))
    values = range_bucket(values, "_value", values.count(), "_range")
    ranges = values.groupBy(*group, "_range").agg(F.sum("_n").alias("_in_range"))
    in_order = Window.partitionBy(*group).orderBy("_range")
    ranges = ranges.select(
        *group,
        "_range",
        "_in_range",
        F.coalesce(F.sum("_in_range").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_in_range").over(Window.partitionBy(*group)).alias("_total"),
    )
    asks = F.array(
        *[
            F.struct(F.lit(n).alias("alias"), F.lit(c).alias("column"), F.lit(float(q)).alias("q"))
            for n, (c, q) in wanted.items()
        ]
    )
    ranks = (
        ranges.withColumn("_ask", F.explode(F.filter(asks, lambda a: a["column"] == F.col("_column"))))
        .withColumn("_at", F.col("_ask.q") * (F.col("_total") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in_range")))
        .select(*group, "_range", "_before", F.col("_ask.alias").alias("_alias"), "_at", "_rank")
    )
    hit = ranks.select(*group, "_range", "_before").distinct()
    inside = Window.partitionBy(*group, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ordered = join_on(values, hit, [*group, "_range"]).withColumn("_last", F.col("_before") + F.sum("_n").over(inside) - 1)
    found = join_on(ranks.drop("_before"), ordered.select(*group, "_range", "_value", "_last", "_n"), [*group, "_range"]).filter(
        (F.col("_rank") <= F.col("_last")) & (F.col("_rank") > F.col("_last") - F.col("_n"))
    )
    low, high = F.min("_value"), F.max("_value")
    interpolated = found.groupBy(*keys, "_alias").agg(
        (low + (F.first("_at") - F.floor(F.first("_at"))) * (high - low)).alias("_quantile")
    )
    return interpolated.groupBy(*keys).pivot("_alias", list(wanted)).agg(F.first("_quantile"))
