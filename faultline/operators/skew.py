"""Ordered work on keyed rows that stays parallel when one key is very hot.

A window partitioned by a key puts the whole key in one task. Here the keys are
measured first. Keys below the row limit keep the plain one-shuffle window. The rows
of larger keys are cut into slices of their whole order, and what a slice needs
from its neighbours is added explicitly:

* row frames (lag, rolling statistics): the few edge rows of the adjacent slices;
* running values (cumulative sum, last known value): one carried value per slice.

Both forms give exactly the result of the unsliced window.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import materialize, max_group_rows

SLICE, HEAVY, HALO, POSITION = "_slice", "_heavy", "_halo", "_position"
MAX_SLICES = 10_000


def same_keys(left: DataFrame, right: DataFrame, keys: Iterable[str], prefix: str = "_r_") -> Column:
    """Null-safe equality of ``keys`` in left and of the renamed keys in right."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys], F.lit(True))


def join_on(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Join that also matches null keys and keeps one copy of the keys."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    joined = left.join(renamed, same_keys(left, renamed, keys), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*["_r_" + k for k in keys])


def heavy_groups(df: DataFrame, keys: Iterable[str]) -> DataFrame | None:
    """Groups with more rows than the limit, or None. Reads the key columns only; the
    result has at most (rows / limit) rows."""
    limit = max_group_rows(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    return None if sizes.isEmpty() else sizes


def as_position(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double")


def range_bucket(df: DataFrame, position: str, rows: int, output: str, sample: DataFrame | None = None) -> DataFrame:
    """Add ``output``: the index of an equi-depth range of ``position``. Only the range
    bounds (at most MAX_SLICES doubles) reach the driver."""
    per_slice = max_group_rows(df.sparkSession)
    slices = min(max(2, math.ceil(rows / per_slice)), MAX_SLICES)
    probabilities = [i / slices for i in range(1, slices)]
    source = df if sample is None else sample
    bounds = source.approxQuantile(position, probabilities, 1.0 / (4 * slices))
    inner = sorted({b for b in bounds if math.isfinite(b)})
    if not inner:
        return df.withColumn(output, F.lit(0))
    cutter = Bucketizer(
        splits=[-math.inf, *inner, math.inf], inputCol=position, outputCol=output, handleInvalid="keep"
    )
    return cutter.transform(df).withColumn(output, F.col(output).cast("int"))


class Timeline:
    """Rows of each key in a total order; ``order`` names the ordering columns, the first
    one a timestamp or number, the last ones tie-breakers."""

    def __init__(self, df: DataFrame, keys: Iterable[str], order: Iterable[str]):
        self.keys, self.order = list(keys), list(order)
        heavy = heavy_groups(df, self.keys)
        self.sliced = heavy is not None
        self.df = df.withColumn(SLICE, F.lit(0)) if heavy is None else self._cut(df, heavy)

    def _cut(self, df: DataFrame, heavy: DataFrame) -> DataFrame:
        if self.keys:
            flagged = join_on(df, heavy.select(*self.keys, F.lit(True).alias(HEAVY)), self.keys, "left")
            flagged = flagged.withColumn(HEAVY, F.coalesce(HEAVY, F.lit(False)))
        else:
            flagged = df.withColumn(HEAVY, F.lit(True))
        total = heavy.agg(F.sum("_rows")).first()[0]
        slices = max(2, math.ceil(total / max_group_rows(df.sparkSession)))
        # Ranges of the whole order: rows that share a timestamp are cut as well. Written, as bounds are drawn anew by each reader.
        cut = flagged.filter(HEAVY).repartitionByRange(slices, *self.keys, *self._sorted(False)).withColumn(SLICE, F.spark_partition_id())
        return materialize(cut).unionByName(flagged.filter(~F.col(HEAVY)).withColumn(SLICE, F.lit(0)))

    def _with(self, df: DataFrame) -> Timeline:
        other = copy.copy(self)
        other.df = df
        return other

    def _sorted(self, reverse: bool) -> list[Column]:
        return [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in self.order]

    def window(self, reverse: bool = False):
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self._sorted(reverse))

    def columns(self, columns: dict[str, Column]) -> Timeline:
        return self._with(self.df.withColumns(columns))

    def columns_of(self, df: DataFrame) -> Timeline:
        """The same line over ``df``, its rows with more columns."""
        return self._with(df)

    def frames(self, *stages: Callable, before: int = 0, after: int = 0) -> Timeline:
        """Columns over row frames that reach at most ``before`` rows back and ``after``
        rows ahead in total. Each stage maps the window to {name: Column}."""
        df = self.df
        if self.sliced:
            df = df.withColumn(HALO, F.lit(False))
            for rows, back in ((before, True), (after, False)):
                if rows:
                    df = df.unionByName(self._edges(rows, back).withColumn(HALO, F.lit(True)))
        window = self.window()
        for stage in stages:
            df = df.withColumns(stage(window))
        if self.sliced:
            df = df.filter(~F.col(HALO)).drop(HALO)
        return self._with(df)

    def _edges(self, rows: int, back: bool) -> DataFrame:
        """The ``rows`` rows next to every slice, labelled with that slice. Only the edge
        rows of each slice are numbered, so the key-wide window stays small."""
        heavy = self.df.filter(HEAVY)
        edge = (
            heavy.withColumn("_n", F.row_number().over(self.window(reverse=back)))
            .filter(F.col("_n") <= rows)
            .drop("_n")
        )
        across = Window.partitionBy(*self.keys).orderBy(*self._sorted(reverse=not back))
        edge = edge.withColumn("_p", F.row_number().over(across))
        wanted = (
            edge.groupBy(*self.keys, SLICE)
            .agg(F.min("_p").alias("_first"))
            .filter(F.col("_first") > 1)
            .select(
                *self.keys,
                F.col(SLICE).alias("_target"),
                F.explode(F.sequence(F.greatest(F.col("_first") - rows, F.lit(1)), F.col("_first") - 1)).alias("_p"),
            )
        )
        found = join_on(edge, wanted, [*self.keys, "_p"])
        return found.withColumn(SLICE, F.col("_target")).drop("_target", "_p")

    def running(self, columns: dict[str, tuple[str, Column]], reverse: bool = False, exclusive: bool = False) -> Timeline:
        """Unbounded running aggregates: {name: (kind, value)} with kind sum, max, min or
        last (last known non-null value). ``reverse`` runs from the end backwards, which
        gives next-known values without a quadratic following frame."""
        frame = self.window(reverse).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        functions = {
            "sum": lambda c: F.sum(c),
            "max": lambda c: F.max(c),
            "min": lambda c: F.min(c),
            "last": lambda c: F.last(c, ignorenulls=True),
        }
        local = {n: functions[k](v).over(frame) for n, (k, v) in columns.items()}
        if not self.sliced:
            local = {n: F.coalesce(c, F.lit(0)) if columns[n][0] == "sum" else c for n, c in local.items()}
            return self._with(self.df.withColumns(local))
        at = F.struct(*self.order)
        pick = F.min_by if reverse else F.max_by
        per_slice = {
            n: pick(v, F.when(v.isNotNull(), at)) if k == "last" else functions[k](v)
            for n, (k, v) in columns.items()
        }
        totals = self.df.filter(HEAVY).groupBy(*self.keys, SLICE).agg(*[c.alias(n) for n, c in per_slice.items()])
        slice_order = F.col(SLICE).desc() if reverse else F.col(SLICE).asc()
        earlier = Window.partitionBy(*self.keys).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *self.keys, SLICE, *[functions[k](F.col(n)).over(earlier).alias("_carry_" + n) for n, (k, _) in columns.items()]
        )
        joined = join_on(self.df.withColumns(local), carry, [*self.keys, SLICE], "left")
        merge = {
            "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
            "max": lambda a, b: F.greatest(a, b),
            "min": lambda a, b: F.least(a, b),
            "last": lambda a, b: F.coalesce(a, b),
        }
        merged = {n: merge[k](F.col(n), F.col("_carry_" + n)) for n, (k, _) in columns.items()}
        return self._with(joined.withColumns(merged).drop(*["_carry_" + n for n in columns]))

    def result(self, *drop: str) -> DataFrame:
        return self.df.drop(SLICE, HEAVY, *drop)


def range_numbered(df: DataFrame, order: list[str | Column], output: str, parts: int | None = None) -> DataFrame:
    """Adds ``output``: 0, 1, 2 ... in the given total order. The rows are dealt into ranges of the whole order (``parts`` of them, else as many
    as shuffles have), sorted and written once with their place, and moved by the rows of the ranges before, of which there is one count for each range."""
    ranged = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()))  # the partition from bit 33 on, below it the row
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    offsets = counts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    numbered = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(output, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")
