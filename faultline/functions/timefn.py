"""Time expressions shared by the operators. All of them keep the type of the input
timestamp, with or without a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(earlier: Column, later: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def minutes_between(earlier: Column, later: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(60_000_000.0)


def floor_to(ts: Column, size: str) -> Column:
    """Start of the tumbling window of ``size`` (such as '5 minutes') that holds ts."""
    return F.window(ts, size)["start"]


def shift(ts: Column, **parts: Column | int) -> Column:
    return ts + F.make_dt_interval(**{k: v if isinstance(v, Column) else F.lit(v) for k, v in parts.items()})


def calendar(ts: Column) -> dict[str, Column]:
    """Hour, minute, day numbers (Monday is 0), weekend flag, day name and hour cycle."""
    angle = F.hour(ts) * F.lit(2 * 3.141592653589793 / 24)
    return {
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "day_of_week": F.weekday(ts),
        "day_of_month": F.dayofmonth(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "day_name": F.date_format(ts, "EEEE"),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    }


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def circular_minutes(a: Column, b: Column) -> Column:
    """Distance of two minutes of the day around midnight."""
    d = F.abs(a - b)
    return F.least(d, F.lit(1440) - d)
