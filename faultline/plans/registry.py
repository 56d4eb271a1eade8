"""Named queries over the given tables and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, so both engines agree despite the order of sums."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles})


def rnd(columns: str, digits: int = 6) -> str:
    """'a, b' as SQL that rounds each column under its own name."""
    return ", ".join(f'round({c.strip()}, {digits}) + 0.0 AS {c.strip()}' for c in columns.split(","))


def big(columns: str) -> str:
    return ", ".join(f"CAST({c.strip()} AS BIGINT) AS {c.strip()}" for c in columns.split(","))
