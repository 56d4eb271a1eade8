"""What intervals see of a time line, without a row for every pair of a point and an interval.

* Windows of time, each dealt to a task with the window after it, hold an interval as a whole: its ends are looked up among the window's points, and all its
  statistics come from an index over them (``range_index.py``). A point moves twice, an interval once.
* What windows cannot hold (an interval longer than one, a window with very many points, an id with several intervals) takes the way of numbers:
  ``rank_range`` numbers points along time and looks the ends up among those numbers; ``interval_statistics`` covers ranges by at most 6 blocks a level of
  sizes 1, 4, 16 ..., whose sums are added, and finds order statistics by digits of the value's rank. Short ranges are read as they are.
* ``winners``: overlapping intervals become disjoint segments, each with the interval that counts in it.
* ``multiplicity``: in how many intervals of a kind each point lies.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.timefn import micros
from faultline.operators.quantiles import quantiles_by
from faultline.operators.range_index import RangeIndex
from faultline.operators.skew import SLICE, Timeline, join_on
from faultline.session import materialize, max_group_rows, ship_package

AT, KIND, TIE, POINT, ASK = "_at", "_kind", "_tie", "_point", "_ask"
BASE = 4
#: Ranges with at most so many points are read point by point.
SHORT = 256
DIGIT = 4
#: A window of time holds at most this part of the rows that a group may have.
WINDOW_PART = 16
FROM, TO, WINDOW, NEAR = "_from_us", "_to_us", "_window", "_near"


def _window_of(column: str, width: int) -> Column:
    return F.expr(f"(`{column}` - pmod(`{column}`, {width}L)) div {width}L")


def _windows(points: DataFrame, intervals: DataFrame, keys: list[str]) -> tuple[int, DataFrame]:
    """The width of the windows in micros, and ``intervals`` with ``_near``: whether two windows with few points hold the interval."""
    limit = max(1, max_group_rows(points.sparkSession) // WINDOW_PART)
    longest = intervals.agg(F.max(F.col(TO) - F.col(FROM))).first()[0] or 0
    width = max(int(longest) + 1, 1_000_000)
    cells = lambda: points.groupBy(*keys, _window_of(AT, width).alias(WINDOW)).agg(F.count(F.lit(1)).alias("_points"))
    most = cells().agg(F.max("_points")).first()[0] or 1
    if most > limit:
        width = max(1, width // -(-most // limit))
    else:  # wider windows make fewer groups of at most an eighth of the limit
        width *= max(1, limit // 8 // most)
    starts = intervals.withColumn(WINDOW, _window_of(FROM, width))
    near = _window_of(TO, width) <= F.col(WINDOW) + 1
    crowded = cells().filter(F.col("_points") > limit).select(*keys, F.explode(F.array(F.col(WINDOW), F.col(WINDOW) - 1)).alias(WINDOW)).distinct() if most > limit else None
    if crowded is not None:
        starts = join_on(starts, crowded.withColumn("_crowded", F.lit(True)), [*keys, WINDOW], "left")
        near = near & F.col("_crowded").isNull()
    return width, starts.withColumn(NEAR, near).drop("_crowded")


def _in_windows(points: DataFrame, intervals: DataFrame, keys: list[str], width: int, compute, schema: T.StructType) -> DataFrame:
    """``compute(points, intervals)`` for each window with its points and those of the next one, and the intervals that start in it."""
    own = _window_of(AT, width)
    dealt = points.withColumn(WINDOW, F.explode(F.array(own, own - 1)))
    by = [*keys, WINDOW]
    return intervals.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(lambda left, right: compute(right, left), schema)


def _ends(intervals: pa.Table, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.searchsorted(times, intervals.column(FROM).to_numpy(), side="left")
    return first, np.maximum(first, np.searchsorted(times, intervals.column(TO).to_numpy(), side="right"))


def _counted(columns: list[str]):
    def compute(points: pa.Table, intervals: pa.Table) -> pa.Table:
        intervals = intervals.group_by([*columns, FROM, TO]).aggregate([])
        first, after = _ends(intervals, np.sort(points.column(AT).to_numpy()))
        return intervals.select(columns).append_column("points", pa.array(after - first, pa.int64()))

    return compute


def _plain_statistics(values: np.ndarray, first: np.ndarray, after: np.ndarray, spread: bool) -> tuple:
    """The statistics of ranges that hold NaN or infinite values, one by one; NaN is the greatest value, as in Spark."""
    out = []
    with np.errstate(all="ignore"):
        for a, b in zip(first, after):
            v = np.sort(values[a:b])
            middle = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
            m = middle(v) if len(v) else np.nan
            out.append((v.mean() if len(v) else 0, v.var() * len(v) if len(v) else 0, v[0] if len(v) else 0, v[-1] if len(v) else 0, m, middle(np.sort(np.abs(v - m))) if spread and len(v) else 0))
    return tuple(np.array(c) for c in zip(*out))


def _window_statistics(by: list[str], tie: str, columns: list[str], spread: bool, schema: T.StructType):
    """All statistics of the intervals of a window in each line of it; ``by`` tells the lines of a key apart."""
    names = schema.fieldNames()

    def of_line(points: pa.Table, intervals: pa.Table) -> tuple[np.ndarray, dict]:
        first, after = _ends(intervals, points.column(AT).to_numpy())
        asked = np.flatnonzero(after > first)
        first, after = first[asked], after[asked]
        inside = lambda known: (known[first], known[after])
        seen = points.column("value").is_valid().to_numpy()
        low, high = inside(np.concatenate([[0], np.cumsum(seen)]))
        values = points.column("value").drop_null().to_numpy()
        n = high - low
        some = n > 0
        found = {c: np.zeros(len(n)) for c in ("mean", "_apart", "min", "max", "median", "mad")}
        if some.any():
            a, b = low[some], high[some]
            if np.isfinite(values).all():
                index = RangeIndex(values)
                _, mean, apart, least, most = index.moments(a, b)
                middle = index.median(a, b)
                parts = mean, apart, least, most, middle, index.mad(a, b, middle) if spread else 0
            else:
                parts = _plain_statistics(values, a, b, spread)
            for c, x in zip(found, parts):
                found[c][some] = x
        known = points.column("z").is_valid().to_numpy()
        z = np.abs(points.column("z").drop_null().to_numpy())
        z_low, z_high = inside(np.concatenate([[0], np.cumsum(known)]))
        strong = np.zeros(len(known), np.int64)
        strong[known] = ~(z <= 3)  # NaN is greater
        s_low, s_high = inside(np.concatenate([[0], np.cumsum(strong)]))
        top = RangeIndex.greatest(z, z_low, z_high)
        column = lambda x, good: pa.array(x, pa.float64(), mask=~good)
        with np.errstate(all="ignore"):
            std = np.sqrt(found["_apart"] / (n - 1))
        return asked, {
            "n": pa.array(n, pa.int64()), "mean": column(found["mean"], some), "median": column(found["median"], some), "std": column(std, n > 1),
            "min": column(found["min"], some), "max": column(found["max"], some), "last": points.column("value").take(pa.array(after - 1)).combine_chunks(),
            "anomaly_count": pa.array(s_high - s_low, pa.int64()), "anomaly_rate": pa.array((s_high - s_low) / (after - first)), "max_abs_z": column(top, z_high > z_low), "mad": column(found["mad"], some),
        }

    def compute(points: pa.Table, intervals: pa.Table) -> pa.Table:
        kinds = pa.schema([(f.name, intervals.schema.field(f.name).type if f.name in columns else points.schema.field(f.name).type if f.name in by else pa.int64() if f.dataType == T.LongType() else pa.float64()) for f in schema.fields])
        if not (points.num_rows and intervals.num_rows):
            return kinds.empty_table()
        points = points.sort_by([(AT, "ascending"), (tie, "ascending")])
        lines = points.group_by(by).aggregate([]).to_pylist() if by else [{}]
        out = []
        for line in lines:
            mask = None
            for c, v in line.items():
                same = pc.is_null(points.column(c)) if v is None else pc.fill_null(pc.equal(points.column(c), v), False)
                mask = same if mask is None else pc.and_(mask, same)
            asked, found = of_line(points if mask is None else points.filter(mask), intervals)
            found |= {c: intervals.column(c).take(pa.array(asked)) for c in columns} | {c: pa.repeat(pa.scalar(v, points.schema.field(c).type), len(asked)) for c, v in line.items()}
            out.append(pa.table([found[c] for c in names], schema=kinds))
        return pa.concat_tables(out)

    return compute


def _numbered_line(points: DataFrame, intervals: DataFrame, series: list[str], ts: str, tie: str, start: Column, end: Column, columns: list[str]) -> DataFrame:
    """Points and both ends of the intervals in one time line, with the number of points up to each row."""
    seen = points.select(*series, micros(F.col(ts)).alias(AT), F.lit(1).alias(KIND), F.col(tie).alias(TIE), F.struct(*points.columns).alias(POINT))
    ends = F.explode(F.array(F.struct(micros(start).alias("at"), F.lit(0).alias("kind")), F.struct(micros(end).alias("at"), F.lit(2).alias("kind")))).alias("_end")
    asked = intervals.select(*series, F.struct(*columns).alias(ASK), ends).select(
        *series, F.col("_end.at").alias(AT), F.col("_end.kind").alias(KIND), F.lit(None).cast(points.schema[tie].dataType).alias(TIE), ASK
    )
    line = Timeline(seen.unionByName(asked, allowMissingColumns=True), series, [AT, KIND, TIE])
    return line.running({"_n": ("sum", (F.col(KIND) == 1).cast("long"))}).result()


def _ranges(line: DataFrame, series: list[str]) -> DataFrame:
    """(first, after): the numbers, from 0, of the points inside an interval are first <= n < after."""
    asked = line.filter(F.col(ASK).isNotNull())
    both = asked.groupBy(*series, ASK).agg(F.max(F.when(F.col(KIND) == 0, F.col("_n"))).alias("first"), F.max(F.when(F.col(KIND) == 2, F.col("_n"))).alias("after"))
    return both.select(*series, F.col(ASK), "first", F.greatest("first", "after").alias("after"))


def rank_range(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, tie: str, start: str, end: str) -> DataFrame:
    """``intervals`` (distinct rows) with ``points``, the number of points of their key inside, ends included: two look-ups for each interval."""
    ship_package(points.sparkSession)
    columns = intervals.columns
    timed = intervals.withColumns({FROM: micros(F.col(start)), TO: micros(F.col(end))})
    seen = points.select(*keys, micros(F.col(ts)).alias(AT)).filter(F.col(AT).isNotNull())
    width, dealt = _windows(seen, timed, keys)
    far = dealt.filter(~F.coalesce(F.col(NEAR) & (F.col(TO) >= F.col(FROM)), F.lit(False))).select(*columns)
    near = dealt.filter(F.col(NEAR) & (F.col(TO) >= F.col(FROM))).drop(NEAR)
    schema = T.StructType([*intervals.schema.fields, T.StructField("points", T.LongType())])
    out = _in_windows(seen, near, keys, width, _counted(columns), schema)
    return out if far.isEmpty() else out.unionByName(_numbered_range(points, far, keys, ts, tie, start, end))


def _numbered_range(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, tie: str, start: str, end: str) -> DataFrame:
    line = _numbered_line(points.select(*dict.fromkeys([*keys, ts, tie])), intervals, keys, ts, tie, F.col(start), F.col(end), intervals.columns)
    return _ranges(line, keys).select(f"{ASK}.*", (F.col("after") - F.col("first")).alias("points"))


def _statistics(value: Column, z: Column, centre: Column) -> list[Column]:
    strong = F.coalesce(F.abs(z) > 3, F.lit(False)).cast("long")
    moved = value - centre
    return [
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("n"), F.sum(moved).alias("s1"), F.sum(moved * moved).alias("s2"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.sum(strong).alias("strong"), F.max(F.abs(z)).alias("max_abs_z"),
    ]


def _merged() -> list[Column]:
    add = [F.sum(c).alias(c) for c in ("rows", "n", "s1", "s2")]
    return [*add, F.min("min").alias("min"), F.max("max").alias("max"), F.sum("strong").alias("strong"), F.max("max_abs_z").alias("max_abs_z")]


def _cover(levels: int) -> Column:
    """Blocks (level, block) that make up the range first <= n < after: whatever the blocks of the next level leave over, on both sides."""
    between = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<long>"))
    low = [F.expr(f"(first + {BASE**i - 1}) div {BASE**i}") for i in range(levels + 1)]
    high = [F.expr(f"after div {BASE**i}") for i in range(levels + 1)]
    parts = []
    for i in range(levels):
        inner = F.lit(False) if i + 1 == levels else low[i + 1] < high[i + 1]
        whole = between(low[i], high[i])
        sides = F.concat(between(low[i], BASE * low[i + 1]), between(BASE * high[i + 1], high[i]))
        parts.append(_named(F.when(inner, sides).otherwise(whole), i))
    return F.concat(*parts)


def _named(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))


def _levels_for(longest: int) -> int:
    """Enough levels that a range has at most 2 * BASE blocks of the highest one."""
    levels = 1
    while BASE**levels < longest:
        levels += 1
    return levels


def _long_quantiles(numbered: DataFrame, ranges: DataFrame, series: list[str], ask: list[str]) -> DataFrame:
    """Median of the values in each range, found digit by digit of the value's place in its series. A round looks up, for
    each range, how many of its points lie under each of the 16 next digits: one pass over the points, no pairs."""
    line = Timeline(numbered.filter(F.col("value").isNotNull()).select(*series, "rank", "value"), series, ["value", "rank"])
    placed = materialize(line.running({"_place": ("sum", F.lit(1).cast("long"))}).result().withColumn("_place", F.col("_place") - 1))
    largest = placed.agg(F.max("_place")).first()[0] or 0
    rounds = max(1, -(-int(largest).bit_length() // DIGIT))
    middles = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    asked = materialize(ranges.select(*series, *ask, "first", "after", F.explode(middles).alias("_left"), F.lit(0).cast("long").alias("_node")).withColumn("_k", F.col("_left")))
    for at in range(rounds - 1, -1, -1):
        probe = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2**DIGIT - 1)), lambda d: d.cast("long"))).alias("_digit")
        spread = asked.select(*series, *ask, "_k", "first", "after", "_node", probe)
        ends = F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(-1).alias("sign")), F.struct(F.col("after").alias("rank"), F.lit(1).alias("sign")))).alias("_end")
        spread = spread.select(*series, F.struct(*ask, "_k", "_digit").alias(ASK), (F.col("_node") * 2**DIGIT + F.col("_digit")).alias("_node"), ends)
        spread = spread.select(*series, "_node", F.col("_end.rank").alias("rank"), F.lit(0).alias(KIND), ASK, F.col("_end.sign").alias("_sign"))
        here = placed.select(*series, F.shiftright("_place", at * DIGIT).alias("_node"), "rank", F.lit(1).alias(KIND))
        counted = Timeline(here.unionByName(spread, allowMissingColumns=True), [*series, "_node"], ["rank", KIND]).running({"_n": ("sum", F.col(KIND).cast("long"))}).result()
        inside = counted.filter(F.col(ASK).isNotNull()).select(*series, f"{ASK}.*", "_n", "_sign").groupBy(*series, *ask, "_k", "_digit").agg(F.sum(F.col("_n") * F.col("_sign")).alias("_in"))
        up_to = Window.partitionBy(*series, *ask, "_k").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        found = join_on(inside.withColumn("_to", F.sum("_in").over(up_to)), asked, [*series, *ask, "_k"])
        chosen = found.filter((F.col("_to") > F.col("_left")) & (F.col("_to") - F.col("_in") <= F.col("_left")))
        asked = materialize(chosen.select(*series, *ask, "_k", "first", "after", (F.col("_left") - F.col("_to") + F.col("_in")).alias("_left"), (F.col("_node") * 2**DIGIT + F.col("_digit")).alias("_node")))
    values = join_on(asked, placed.select(*series, F.col("_place").alias("_node"), F.col("value")), [*series, "_node"])
    return values.groupBy(*series, *ask).agg(((F.min("value") + F.max("value")) / 2).alias("median"))


def _middle(ordered: Column) -> Column:
    """Median of a sorted array; null if it is empty."""
    size = F.size(ordered)
    return (F.get(ordered, F.floor((size - 1) / 2).cast("int")) + F.get(ordered, F.floor(size / 2).cast("int"))) / 2


def _short_statistics(numbered: DataFrame, ranges: DataFrame, by: list[str], asked: list[str], group: list[str]) -> DataFrame:
    """All statistics from the points of each range of the lines ``by``; a range has few, so its values fit one row."""
    listed = ranges.select(*by, *asked, F.explode(F.sequence("first", F.col("after") - 1)).alias("rank"))
    seen = join_on(listed, numbered, [*by, "rank"])
    strong = F.coalesce(F.abs(F.col("z")) > 3, F.lit(False))
    found = seen.groupBy(*group).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", "rank").alias("last"),
        F.count_if(strong).alias("anomaly_count"), F.avg(strong.cast("int")).alias("anomaly_rate"), F.max(F.abs(F.col("z"))).alias("max_abs_z"), F.sort_array(F.collect_list("value")).alias("_values"),
    )
    found = found.withColumn("median", _middle(F.col("_values")))
    apart = F.sort_array(F.transform("_values", lambda v: F.abs(v - F.col("median"))))
    return found.withColumn("mad", _middle(apart)).drop("_values")


def _long_statistics(numbered: DataFrame, ranges: DataFrame, series: list[str], asked: list[str], group: list[str], longest: int, spread: bool) -> DataFrame:
    """The same from blocks, and the median by digits."""
    levels = _levels_for(longest)
    centred = join_on(numbered, numbered.groupBy(*series).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("centre")), series)
    level = materialize(centred.groupBy(*series, F.col("rank").alias("block"), "centre").agg(*_statistics(F.col("value"), F.col("z"), F.col("centre"))))
    blocks = level.withColumn("level", F.lit(0))
    for i in range(1, levels):
        level = materialize(level.withColumn("block", F.expr(f"block div {BASE}")).groupBy(*series, "block", "centre").agg(*_merged()))
        blocks = blocks.unionByName(level.withColumn("level", F.lit(i)))
    covered = ranges.select(*group, F.explode(_cover(levels)).alias("_b")).select(*group, "_b.*")
    sums = materialize(join_on(covered, blocks, [*series, "level", "block"]).groupBy(*group).agg(F.first("centre").alias("centre"), *_merged()))
    last = join_on(ranges.select(*group, (F.col("after") - 1).alias("rank")), numbered.select(*series, "rank", F.col("value").alias("last")), [*series, "rank"]).drop("rank")
    medians = materialize(_long_quantiles(numbered, join_on(ranges, sums.select(*group, "n"), group).filter("n > 0"), series, asked))
    out = join_on(join_on(sums, last, group, "left"), medians, group, "left")
    n = F.col("n")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)))
    out = out.select(
        *group, "n", (F.col("centre") + F.col("s1") / F.nullif(n, F.lit(0))).alias("mean"), F.sqrt(variance).alias("std"), "min", "max", "last",
        F.col("strong").alias("anomaly_count"), (F.col("strong") / F.col("rows")).alias("anomaly_rate"), "max_abs_z", "median",
    )
    if not spread:
        return out.withColumn("mad", F.lit(None).cast("double"))
    every = join_on(ranges.select(*group, F.explode(F.sequence("first", F.col("after") - 1)).alias("rank")), numbered, [*series, "rank"])
    apart = join_on(every, medians, group).withColumn("_d", F.abs(F.col("value") - F.col("median")))
    return join_on(out, quantiles_by(apart, group, {"mad": ("_d", 0.5)}), group, "left")


def interval_statistics(points: DataFrame, intervals: DataFrame, keys: list[str], series: list[str], ts: str, tie: str, ids: list[str], start: str, end: str, spread: bool = False, short: int = SHORT) -> DataFrame:
    """Statistics of ``value`` and ``z`` for each interval (``ids``) and each series of its key that has a point in it, ends included: n, mean, median, std, min,
    max, last, anomaly_count and anomaly_rate (|z| > 3), max_abs_z, and with ``spread`` the MAD.

    Windows of time hold almost all intervals. Of the rest, a range of at most ``short`` points is read point by point. A longer one is covered by blocks, and
    its median searched by digits; its MAD is taken over its points, as the distances of each range have an order of their own."""
    ship_package(points.sparkSession)
    points = points.select(*dict.fromkeys([*series, ts, tie, "value", "z"]))
    asked = [c for c in ids if c not in series]
    group = [*series, *asked]
    intervals = intervals.select(*dict.fromkeys([*keys, *asked]), F.col(start).alias("_start"), F.col(end).alias("_end"))
    timed = intervals.withColumns({FROM: micros(F.col("_start")), TO: micros(F.col("_end"))}).filter(F.col(TO) >= F.col(FROM))
    several = (F.min(FROM) < F.max(FROM)) | (F.min(TO) < F.max(TO))
    named = timed.groupBy(*keys, *asked).agg(F.min(FROM).alias(FROM), F.max(TO).alias(TO), several.alias("_several"))
    seen = points.select(*series, micros(F.col(ts)).alias(AT), tie, F.col("value").cast("double").alias("value"), F.col("z").cast("double").alias("z")).filter(F.col(AT).isNotNull())
    width, dealt = _windows(seen, named, keys)
    dealt = materialize(dealt.withColumn(NEAR, F.col(NEAR) & ~F.col("_several")).drop("_several"))
    double, kinds = T.DoubleType(), {"n": T.LongType(), "anomaly_count": T.LongType()}
    columns = ["n", "mean", "median", "std", "min", "max", "last", "anomaly_count", "anomaly_rate", "max_abs_z", *(["mad"] if spread else [])]
    schema = T.StructType([*[(points if c in series else intervals).schema[c] for c in group], *[T.StructField(c, kinds.get(c, double)) for c in columns]])
    by = [c for c in series if c not in keys]
    out = _in_windows(seen, dealt.filter(NEAR).drop(NEAR), keys, width, _window_statistics(by, tie, [c for c in group if c not in by], spread, schema), schema)
    far = dealt.filter(~F.col(NEAR)).select(*keys, *asked)
    if far.isEmpty():
        return out
    rest = materialize(join_on(timed.drop(FROM, TO), far, [*keys, *asked], "left_semi"))
    return out.unionByName(_numbered_statistics(points, rest, keys, series, ts, tie, asked, spread, short))


def _numbered_statistics(points: DataFrame, intervals: DataFrame, keys: list[str], series: list[str], ts: str, tie: str, asked: list[str], spread: bool, short: int) -> DataFrame:
    """The statistics of intervals that windows cannot hold."""
    group = [*series, *asked]
    numbered, ranges = _looked_up(points, intervals, keys, series, ts, tie)
    length = F.col("after") - F.col("first")
    out = _short_statistics(numbered, ranges.filter(length <= short), keys, asked, group)
    if (ranges.agg(F.max(length)).first()[0] or 0) > short:
        # Many points of a key: now each of its series is a line of its own.
        lines = join_on(ranges.filter(length > short).drop("first", "after"), points.select(*series).distinct(), keys)
        numbered, ranges = _looked_up(points, lines, series, series, ts, tie)
        out = out.unionByName(_short_statistics(numbered, ranges.filter(length <= short), series, asked, group))
        longest = ranges.agg(F.max(length)).first()[0] or 0
        if longest > short:
            out = out.unionByName(_long_statistics(numbered, ranges.filter(length > short), series, asked, group, longest, spread))
    columns = ["n", "mean", "median", "std", "min", "max", "last", "anomaly_count", "anomaly_rate", "max_abs_z"]
    return out.select(*group, *columns, *(["mad"] if spread else []))


def _looked_up(points: DataFrame, intervals: DataFrame, by: list[str], series: list[str], ts: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """Points with their ``rank`` in the lines ``by``, and the intervals that have any, with first and after."""
    columns = [c for c in intervals.columns if c not in by]
    line = materialize(_numbered_line(points, intervals, by, ts, tie, F.col("_start"), F.col("_end"), columns))
    rest = [c for c in series if c not in by]
    numbered = line.filter(F.col(POINT).isNotNull()).select(*by, *[F.col(f"{POINT}.{c}").alias(c) for c in rest], (F.col("_n") - 1).alias("rank"), f"{POINT}.value", f"{POINT}.z")
    found = _ranges(line, by).filter(F.col("after") > F.col("first")).select(*by, f"{ASK}.*", "first", "after")
    return numbered, materialize(found)


def _stack(rows: Iterable[tuple], held: list[tuple], begin: int | None, until: int | None) -> tuple[list[tuple], list[tuple]]:
    """Segments (from, to, id) of rows (start, end, id) in order of start and id, and what is open at the end. Of the open intervals the latest one
    counts; one that ends no later than a later one never counts again. ``held``: open ones from before, latest last; ``until``: last time to fill."""
    out: list[tuple] = []
    stack = list(held)
    at = begin

    def fill(to: int | None) -> None:
        nonlocal at
        while stack and (to is None or at <= to):
            _, end, ident = stack[-1]
            if end < at:
                stack.pop()
                continue
            last = end if to is None else min(end, to)
            out.append((at, last, ident))
            at = last + 1

    for row in rows:
        if at is None:
            at = row[0]
        fill(row[0] - 1)
        at = row[0]
        while stack and stack[-1][1] <= row[1]:
            stack.pop()
        stack.append(row)
    if at is not None:
        fill(until)
    return out, stack


def winners(intervals: DataFrame, keys: list[str], start: str, end: str, id_col: str) -> DataFrame:
    """Disjoint segments (keys, from, to in micros, ``id_col``): at each time the interval that started last, of those the one with the greatest id. Closed ends;
    at most two segments for each interval.

    A key is one sorted run; a hot one is cut into slices, each of which starts with the intervals of earlier slices that are still open and that no later one
    outlasts. Rows without a key's time or that end before they start are left out."""
    ship_package(intervals.sparkSession)
    plain = intervals.select(*keys, micros(F.col(start)).alias(AT), micros(F.col(end)).alias("_until"), F.col(id_col).alias(TIE)).filter(F.col("_until") >= F.col(AT))
    line = Timeline(plain, keys, [AT, TIE])
    rows = materialize(line.df.select(*keys, SLICE, AT, "_until", TIE).withColumn("_held", F.lit(False)))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [*keys, TIE]}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    bounds = rows.groupBy(*keys, SLICE).agg(F.min(AT).alias("_begin"))
    following = Window.partitionBy(*keys).orderBy(SLICE)
    bounds = materialize(bounds.withColumn("_stop", F.lead("_begin").over(following) - 1))
    if line.sliced:

        def open_ends(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values([AT, TIE])
            _, left = _stack(zip(part[AT], part["_until"], part[TIE]), [], None, int(part[AT].iat[-1]))
            out = part.iloc[: len(left)].copy()
            out[AT], out["_until"], out[TIE] = ([x[i] for x in left] for i in range(3))
            return out

        opened = rows.groupBy(*keys, SLICE).applyInPandas(open_ends, rows.schema)
        later = bounds.select(*keys, F.col(SLICE).alias("_later"), "_begin")
        carried = join_on(opened, later, keys).filter((F.col("_later") > F.col(SLICE)) & (F.col("_until") >= F.col("_begin")))
        rows = rows.unionByName(carried.select(*keys, F.col("_later").alias(SLICE), AT, "_until", TIE, F.lit(True).alias("_held")))
    rows = join_on(rows, bounds, [*keys, SLICE])

    def segments(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([AT, TIE])
        own, held = part[~part["_held"]], part[part["_held"]]
        stack: list[tuple] = []
        for row in zip(held[AT], held["_until"], held[TIE]):
            while stack and stack[-1][1] <= row[1]:
                stack.pop()
            stack.append(row)
        stop = part["_stop"].iat[0]
        found, _ = _stack(zip(own[AT], own["_until"], own[TIE]), stack, int(part["_begin"].iat[0]), None if pd.isna(stop) else int(stop))
        out = pd.DataFrame(found, columns=["from", "to", id_col])
        for k in keys:
            out[k] = part[k].iat[0]
        return out[[*keys, "from", "to", id_col]]

    return rows.groupBy(*keys, SLICE).applyInPandas(segments, f"{named}, from long, to long, `{id_col}` {kinds[TIE]}")


def multiplicity(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, kind: str, kinds: list[str], start: str, end: str) -> DataFrame:
    """``points`` with a column for each of ``kinds``: the number of intervals of that kind, ends included, that the point lies in. Starts add one and ends
    take one away along the time line, so overlapping intervals never repeat a point."""
    line = points.select(*keys, micros(F.col(ts)).alias(AT), F.lit(1).alias(KIND), F.struct(*points.columns).alias(POINT))
    ends = F.explode(F.array(F.struct(micros(F.col(start)).alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(micros(F.col(end)).alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("step"))))
    steps = intervals.filter(F.col(end) >= F.col(start)).select(*keys, F.col(kind).alias(ASK), ends.alias("_e")).select(*keys, ASK, F.col("_e.at").alias(AT), F.col("_e.kind").alias(KIND), F.col("_e.step").alias("_step"))
    both = Timeline(line.unionByName(steps, allowMissingColumns=True), keys, [AT, KIND])
    counts = {k: ("sum", F.when(F.col(ASK) == k, F.col("_step")).otherwise(0).cast("long")) for k in kinds}
    return both.running(counts).result().filter(F.col(POINT).isNotNull()).select(f"{POINT}.*", *[F.col(f"`{k}`") for k in kinds])
