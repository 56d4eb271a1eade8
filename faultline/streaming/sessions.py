"""Incident sessions of a stream as state with timers: open sessions are reported too."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: This state store keeps lists and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "begin long, end long, windows long, closed boolean"


def merged(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (begin, end, windows) of which none is within ``gap`` of the next."""
    out: list[tuple[int, int, int]] = []
    for begin, end, n in sorted(sessions):
        if out and begin - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((begin, end, n))
    return out


class Sessions(StatefulProcessor):
    """State of a key: its open sessions in micros. Rows of a batch are merged into them and all open ones are reported; a session closes, with its last
    report, when the watermark passes its end by the gap."""

    def __init__(self, keys: list[str], gap: int):
        self.keys, self.gap = keys, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "begin long, end long, windows long")

    def _report(self, key: tuple, sessions: list[tuple[int, int, int]], closed: bool) -> pd.DataFrame:
        out = pd.DataFrame(sessions, columns=["begin", "end", "windows"])
        out["closed"] = closed
        for name, value in zip(self.keys, key):
            out[name] = value
        return out[[*self.keys, "begin", "end", "windows", "closed"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(t), int(t), 1) for part in rows for t in part["micros"]]
        sessions = merged([*(tuple(s) for s in self.open.get()), *fresh], self.gap)
        self.open.put(sessions)
        for _, end, _ in sessions:
            self.handle.registerTimer((end + self.gap) // 1000 + 1)
        yield self._report(key, sessions, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = [tuple(s) for s in self.open.get()]
        over = [s for s in sessions if s[1] + self.gap < now]
        if over:
            left = [s for s in sessions if s not in over]
            self.open.put(left) if left else self.open.clear()
            yield self._report(key, over, True)

    def close(self) -> None:
        pass


def session_rows(stream: DataFrame, keys: list[str], gap_minutes: int, delay: str, ts: str) -> DataFrame:
    """A row for every session that a batch opened, changed or closed."""
    # The process that prepares the state has none of the shipped packages: this module goes with the processor.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).select(*keys, ts, F.unix_micros(ts).alias("micros"))
    shape = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys) + ", " + OUTPUT
    return timed.groupBy(*keys).transformWithStateInPandas(Sessions(keys, gap_minutes * 60_000_000), shape, "update", "eventTime")


def incidents_of(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Closed sessions, and those of each key's last report that are still open."""
    ended = reports.filter("closed")
    last = reports.filter("NOT closed").groupBy(*keys).agg(F.max("batch").alias("_last"))
    running = reports.filter("NOT closed").join(last, keys).filter(F.col("batch") == F.col("_last")).drop("_last")
    running = running.join(ended.select(*keys, "begin"), [*keys, "begin"], "left_anti")
    rows = ended.unionByName(running)
    times = {"incident_start": F.timestamp_micros("begin"), "incident_end": F.timestamp_micros("end")}
    return rows.withColumns(times).select(*keys, "incident_start", "incident_end", "windows", "closed")
