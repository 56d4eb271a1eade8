"""As-of, nearest and interval joins over keyed time lines.

As-of joins union both sides into one time line and carry the last known event along it:
one shuffle, no pairs. Intervals are answered by look-ups of their ends (see interval_aggregates.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.timefn import micros, minute_of_day, minutes_between
from faultline.operators.interval_aggregates import rank_range, winners
from faultline.operators.skew import Timeline, join_on

KIND, AT, TIE = "_kind", "_at", "_tie"


def _merge(points: DataFrame, events: DataFrame, keys: list[str], ts: str, event_ts: str, event: Column, tie: str, events_first: bool) -> DataFrame:
    p = points.select(
        *keys, F.col(ts).alias(AT), F.lit(1 if events_first else 0).alias(KIND), F.lit(None).cast(events.schema[tie].dataType).alias(TIE),
        F.struct(*points.columns).alias("_point"),
    )
    e = events.select(
        *keys, F.col(event_ts).alias(AT), F.lit(0 if events_first else 1).alias(KIND), F.col(tie).alias(TIE),
        event.alias("_event"),
    )
    return p.unionByName(e, allowMissingColumns=True)


def carry_event(points: DataFrame, events: DataFrame, keys: list[str], ts: str, event_ts: str, event: Column, output: str, forward: bool, inclusive: bool, tie: str) -> DataFrame:
    """Each point with the nearest later (``forward``) or earlier event as a struct."""
    events_first = inclusive != forward
    merged = _merge(points, events, keys, ts, event_ts, event, tie, events_first)
    line = Timeline(merged, keys, [AT, KIND, TIE]).running({output: ("last", F.col("_event"))}, reverse=forward)
    return line.result().filter(F.col("_point").isNotNull()).select("_point.*", output)


def next_event(points: DataFrame, events: DataFrame, keys: list[str], ts: str, start: str, id_col: str, inclusive: bool = False) -> DataFrame:
    """Next event strictly after the point, its id, start and minutes to it."""
    found = carry_event(points, events, keys, ts, start, F.struct(id_col, start), "_next", True, inclusive, id_col)
    return found.withColumns(
        {
            "next_" + id_col: F.col("_next")[id_col],
            "next_" + start: F.col("_next")[start],
            "minutes_to_next": minutes_between(F.col(ts), F.col("_next")[start]),
        }
    ).drop("_next")


def active_event(points: DataFrame, events: DataFrame, keys: list[str], ts: str, start: str, end: str, id_col: str, closed: bool = False, mode: str = "containment") -> DataFrame:
    """1 when the point lies in an event. ``containment`` looks at every event started so
    far through the running maximum of the ends; ``latest_start`` only at the last one."""
    if mode == "latest_start":
        found = carry_event(points, events, keys, ts, start, F.struct(id_col, end), "_last", False, True, id_col)
        last_end = F.col("_last")[end]
    else:
        merged = _merge(points, events, keys, ts, start, F.col(end), id_col, True)
        line = Timeline(merged, keys, [AT, KIND, TIE]).running({"_last": ("max", F.col("_event"))})
        found = line.result().filter(F.col("_point").isNotNull()).select("_point.*", "_last")
        last_end = F.col("_last")
    inside = last_end >= F.col(ts) if closed else last_end > F.col(ts)
    return found.withColumn("active", F.coalesce(inside, F.lit(False)).cast("int")).drop("_last")


def nearest_event(points: DataFrame, events: DataFrame, keys: list[str], ts: str, event_ts: str, id_col: str, tolerance_minutes: float) -> DataFrame:
    """Nearest event within the tolerance; at equal distance the earlier one."""
    what = F.struct(id_col, event_ts)
    found = carry_event(points, events, keys, ts, event_ts, what, "_before", False, True, id_col)
    found = carry_event(found, events, keys, ts, event_ts, what, "_after", True, False, id_col)
    back = minutes_between(F.col("_before")[event_ts], F.col(ts))
    ahead = minutes_between(F.col(ts), F.col("_after")[event_ts])
    pick_after = F.coalesce(ahead < back, back.isNull())
    distance = F.when(pick_after, ahead).otherwise(back)
    ident = F.when(pick_after, F.col("_after")[id_col]).otherwise(F.col("_before")[id_col])
    close = distance <= tolerance_minutes
    return found.withColumns(
        {"nearest_" + id_col: F.when(close, ident), "nearest_minutes": F.when(close, distance)}
    ).drop("_before", "_after")


def exclude_near(points: DataFrame, events: DataFrame, keys: list[str], ts: str, event_ts: str, id_col: str, minutes: float) -> DataFrame:
    """Points farther than ``minutes`` from every event of their key (limits excluded)."""
    found = nearest_event(points, events, keys, ts, event_ts, id_col, minutes)
    return found.filter(F.col("nearest_minutes").isNull()).drop("nearest_" + id_col, "nearest_minutes")


def mark_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, start: str, end: str, id_col: str) -> DataFrame:
    """Points with the id of the interval they lie in (ends included); of several overlapping intervals the one that starts last wins. The
    intervals are first made into disjoint segments, then each point looks at the last segment that began: no pairs."""
    segments = winners(intervals, keys, start, end, id_col).withColumnsRenamed({"from": "_from", "to": "_to"})
    timed = points.withColumn("_micros", micros(F.col(ts)))
    merged = timed.select(*keys, F.col("_micros").alias(AT), F.lit(1).alias(KIND), F.struct(*points.columns, "_micros").alias("_point"))
    merged = merged.unionByName(segments.select(*keys, F.col("_from").alias(AT), F.lit(0).alias(KIND), F.struct("_to", id_col).alias("_event")), allowMissingColumns=True)
    line = Timeline(merged, keys, [AT, KIND]).running({"_last": ("last", F.col("_event"))}).result().filter(F.col("_point").isNotNull())
    found = F.when(F.col("_last._to") >= F.col("_point._micros"), F.col("_last")[id_col])
    return line.select("_point.*", found.alias("current_" + id_col)).drop("_micros").withColumn("inside", F.col("current_" + id_col).isNotNull())


def horizon_labels(grid: DataFrame, events: DataFrame, keys: list[str], ts: str, start: str, id_col: str, horizons: list[int], slot_minutes: int = 5) -> DataFrame:
    """next-in-h-minutes labels (0 < delta <= h) and whether an event falls in the slot."""
    found = next_event(grid, events, keys, ts, start, id_col)
    delta = F.col("minutes_to_next")
    labels = {f"incident_next_{h}m": F.coalesce(delta <= h, F.lit(False)).cast("int") for h in horizons}
    found = found.withColumns(labels)
    slots = events.select(
        *keys, F.window(start, f"{slot_minutes} minutes")["start"].alias("_slot"), F.lit(1).alias("incident_now")
    ).distinct()
    out = found.withColumn("_slot", F.window(ts, f"{slot_minutes} minutes")["start"])
    out = join_on(out, slots, [*keys, "_slot"], "left").drop("_slot")
    return out.withColumn("incident_now", F.coalesce("incident_now", F.lit(0)))


def time_grid(df: DataFrame, keys: list[str], ts: str, minutes: int) -> DataFrame:
    """Every grid point between the first and last time of each key."""
    step = F.lit(minutes * 60_000_000)
    ends = df.groupBy(*keys).agg(F.min(micros(F.col(ts))).alias("_lo"), F.max(micros(F.col(ts))).alias("_hi"))
    first, last = F.floor(F.col("_lo") / step), F.floor(F.col("_hi") / step)
    kind = df.schema[ts].dataType
    points = ends.select(*keys, F.explode(F.sequence(first, last)).alias("_slot"))
    return points.select(*keys, F.timestamp_micros(F.col("_slot") * step).cast(kind).alias(ts))


def dedup_slots(events: DataFrame, keys: list[str], ts: str, id_col: str, minutes: int = 5) -> DataFrame:
    """First event of each key and time slot. An aggregate, so hot slots combine map-side."""
    slotted = events.withColumn("grid_time", F.window(ts, f"{minutes} minutes")["start"])
    first = slotted.groupBy(*keys, "grid_time").agg(F.min_by(F.struct(*events.columns), F.struct(ts, id_col)).alias("_row"))
    return first.select("_row.*", "grid_time")


def case_rows(events: DataFrame, features: DataFrame, keys: list[str], grid_time: str, ts: str, horizons: list[int]) -> DataFrame:
    """One row per event and horizon with the features at that many minutes before it."""
    ask = events.withColumn("horizon_minutes", F.explode(F.array(*[F.lit(h) for h in horizons])))
    ask = ask.withColumn("case_time", F.col(grid_time) - F.make_dt_interval(mins=F.col("horizon_minutes")))
    return ask.join(features.withColumnRenamed(ts, "case_time"), [*keys, "case_time"])


def _nearest_k(cases: DataFrame, pool: DataFrame, keys: list[str], case_id: list[str], case_ts: str, ts: str, pool_id: str, k: int) -> DataFrame:
    """The k pool rows nearest in time of each case. The pool is numbered along time, a
    case looks up the k numbers on either side: 2k equi-join rows per case, no pairs."""
    merged = _merge(
        cases.select(*dict.fromkeys([*keys, *case_id, case_ts])), pool, keys, case_ts, ts, F.struct(F.col(pool_id).alias("id"), F.col(ts).alias("at")), pool_id, True
    )
    line = Timeline(merged, keys, [AT, KIND, TIE]).running({"_number": ("sum", F.col("_event").isNotNull().cast("long"))}).result()
    numbered = line.filter(F.col("_event").isNotNull()).select(*keys, "_number", "_event")
    wanted = line.filter(F.col("_point").isNotNull()).select(
        *keys, F.col("_point").alias("_case"), F.explode(F.sequence(F.col("_number") - (k - 1), F.col("_number") + k)).alias("_number")
    )
    pairs = join_on(wanted, numbered, [*keys, "_number"]).select(
        "_case.*", F.col("_event.id").alias("control_id"), F.col("_event.at").alias("control_time")
    )
    distance = F.abs(minutes_between(F.col(case_ts), F.col("control_time")))
    nearest = Window.partitionBy(*case_id).orderBy("distance_minutes", "control_time", "control_id")
    return (
        pairs.withColumn("distance_minutes", distance)
        .withColumn("control_rank", F.row_number().over(nearest))
        .filter(F.col("control_rank") <= k)
    )


def matched_controls(cases: DataFrame, pool: DataFrame, keys: list[str], case_id: list[str], case_ts: str, ts: str, pool_id: str, k: int = 5) -> DataFrame:
    """k controls per case: the nearest in time within the same hour of day when at least
    k such rows exist, else the nearest of all."""
    hourly_cases = cases.withColumn("_hour", F.hour(case_ts))
    hourly_pool = pool.withColumn("_hour", F.hour(ts))
    sizes = hourly_pool.groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("_same_hour"))
    sized = join_on(hourly_cases, sizes, [*keys, "_hour"], "left")
    enough = F.coalesce(F.col("_same_hour") >= k, F.lit(False))
    same = _nearest_k(sized.filter(enough), hourly_pool, [*keys, "_hour"], case_id, case_ts, ts, pool_id, k)
    other = _nearest_k(sized.filter(~enough), pool, keys, case_id, case_ts, ts, pool_id, k)
    return same.drop("_hour").withColumn("same_hour", F.lit(True)).unionByName(other.withColumn("same_hour", F.lit(False)))


def daily_controls(faults: DataFrame, points: DataFrame, keys: list[str], fault_id: str, start: str, end: str, ts: str, point_id: str, k: int = 3) -> DataFrame:
    """k control rows per fault on distinct dates at about the same minute of the day
    (circular distance <= 30), at least 60 minutes away and outside every fault widened
    by 15 minutes. Faults in the first hour of their series are left out.

    Points are indexed by (key, minute of day), keeping the first row of each date and the
    first 2k + 2 dates. The cut is exact: a fault takes k rows, at most k - 1 dates are
    used by other minutes, and the 60-minute rule removes at most two dates, because a row
    within 30 minutes of the day is either within 31 minutes or hours away.
    """
    widened = faults.select(
        *keys, fault_id, (F.col(start) - F.make_dt_interval(mins=F.lit(15))).alias("_from"), (F.col(end) + F.make_dt_interval(mins=F.lit(15))).alias("_to")
    )
    clear = active_event(points, widened, keys, ts, "_from", "_to", fault_id, closed=True, mode="latest_start").filter("active = 0")
    daily = (
        clear.withColumns({"_minute": minute_of_day(F.col(ts)), "_date": F.to_date(ts)})
        .groupBy(*keys, "_minute", "_date")
        .agg(F.min(F.struct(F.col(ts).alias("at"), F.col(point_id).alias("id"))).alias("_first"))
    )
    dates = Window.partitionBy(*keys, "_minute").orderBy("_first")
    index = daily.withColumn("_n", F.row_number().over(dates)).filter(F.col("_n") <= 2 * k + 2).drop("_n")
    begin = points.groupBy(*keys).agg(F.min(ts).alias("_begin"))
    asked = join_on(faults.select(*keys, fault_id, start), begin, keys).filter(
        minutes_between(F.col("_begin"), F.col(start)) >= 60
    )
    around = F.transform(F.sequence(F.lit(-30), F.lit(30)), lambda d: F.struct(d.alias("d"), F.pmod(minute_of_day(F.col(start)) + d, F.lit(1440)).alias("m")))
    asked = asked.withColumn("_near", F.explode(around)).select(
        *keys, fault_id, start, F.abs("_near.d").alias("minute_distance"), F.col("_near.m").alias("_minute")
    )
    pairs = asked.join(index, [*keys, "_minute"]).withColumns({"control_time": F.col("_first.at"), "control_id": F.col("_first.id")})
    pairs = pairs.filter(F.abs(minutes_between(F.col(start), F.col("control_time"))) >= 60)
    order = F.struct("minute_distance", "control_time", "control_id")
    per_date = pairs.groupBy(fault_id, "_date").agg(F.min(order).alias("_best"))
    chosen = Window.partitionBy(fault_id).orderBy("_best")
    return (
        per_date.withColumn("control_rank", F.row_number().over(chosen))
        .filter(F.col("control_rank") <= k)
        .select(fault_id, "control_rank", "_best.*")
    )


def fault_phases(faults: DataFrame, start: str, end: str) -> DataFrame:
    """The five study phases of every fault as intervals: 10, 5 and 2 minutes before
    [s - m, s), during [s, e] and 5 minutes after (e, e + 5m]. Times are in micros; the
    open sides are moved by one microsecond."""
    s, e, minute = micros(F.col(start)), micros(F.col(end)), F.lit(60_000_000)
    row = lambda name, a, b: F.struct(F.lit(name).alias("phase"), a.alias("from"), b.alias("to"))
    phases = F.array(
        row("pre_10m", s - 10 * minute, s - 1),
        row("pre_5m", s - 5 * minute, s - 1),
        row("pre_2m", s - 2 * minute, s - 1),
        row("during", s, e),
        row("post_5m", e + 1, e + 5 * minute),
    )
    return _explode_phases(faults, phases)


def prefault_bands(faults: DataFrame, start: str, edges: list[tuple[int, int]] = ((15, 10), (10, 5), (5, 0))) -> DataFrame:
    """Bands [T - a, T - b) before every fault."""
    s, minute = micros(F.col(start)), 60_000_000
    bands = F.array(
        *[
            F.struct(F.lit(f"t-{a}_t-{b}").alias("phase"), (s - a * minute).alias("from"), (s - b * minute - 1).alias("to"))
            for a, b in edges
        ]
    )
    return _explode_phases(faults, bands)


def _explode_phases(faults: DataFrame, phases: Column) -> DataFrame:
    out = faults.withColumn("_phase", F.explode(phases))
    return out.withColumns(
        {
            "phase": F.col("_phase.phase"),
            "phase_start": F.timestamp_micros("_phase.from").cast("timestamp_ntz"),
            "phase_end": F.timestamp_micros("_phase.to").cast("timestamp_ntz"),
        }
    ).drop("_phase")


def offset_coverage(points: DataFrame, faults: DataFrame, keys: list[str], fault_id: str, start: str, end: str, ts: str, hours: range) -> DataFrame:
    """For every clock offset: how many shifted faults have a metric point inside, how
    many points fall in them and the minutes of overlap with the telemetry's range. The points inside are the difference of two running
    counts at the fault's ends, so no point is repeated for an offset."""
    span = points.groupBy(*keys).agg(F.min(micros(F.col(ts))).alias("_lo"), F.max(micros(F.col(ts))).alias("_hi"))
    moved = faults.select(*dict.fromkeys([*keys, fault_id, start, end])).withColumn("offset_hours", F.explode(F.array(*[F.lit(h) for h in hours])))
    shift = F.make_dt_interval(hours=F.col("offset_hours"))
    moved = moved.withColumns({"_from": F.col(start) + shift, "_to": F.col(end) + shift})
    sized = join_on(rank_range(points, moved, keys, ts, ts, "_from", "_to"), span, keys, "left")
    shared = F.greatest(F.lit(0), F.least(micros(F.col("_to")), F.col("_hi")) - F.greatest(micros(F.col("_from")), F.col("_lo")))
    return sized.groupBy("offset_hours").agg(
        F.count(F.lit(1)).alias("faults"),
        F.count_if(F.col("points") > 0).alias("covered_faults"),
        F.sum("points").alias("points"),
        F.sum(F.coalesce(shared, F.lit(0)) / 60_000_000.0).alias("overlap_minutes"),
    )


def clip_to_range(events: DataFrame, features: DataFrame, event_ts: str, ts: str) -> DataFrame:
    """Events inside the time range of the features; fails when none is left."""
    ends = features.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(F.struct("lo", "hi").alias("r")).scalar()
    kept = events.filter(F.col(event_ts).between(ends["lo"], ends["hi"]))
    if kept.isEmpty():
        raise ValueError("no event lies in the time range of the features")
    return kept
