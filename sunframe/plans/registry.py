"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures
from ..operators.series import SeriesOrder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BY_DEVICE = SeriesOrder(("device_id",), "event_ts", ("reading_id",))
SERIES = "PARTITION BY device_id ORDER BY event_ts, reading_id"


def round6(x: Column) -> Column:
    """What ``F.round(x, 6)`` gives, without its decimal arithmetic wherever ``x`` is not close to a tie or large."""
    millionths = x * 1e6
    whole = F.rint(millionths)
    sure = (F.abs(x) < 1e5) & (F.abs(millionths - whole) < 0.499)
    return F.when(sure, whole / 1e6 + 0.0).otherwise(F.round(x, 6))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, instants as wall-clock time: comparable between engines."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = round6(c)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            c = F.transform(c, round6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, views: str = "", extra: str = ""):
    """Register a query; ``sql`` runs after a WITH list of the named views plus ``extra`` parts."""
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            parts = [p for p in (fixtures.ctes(*views.split()) if views else "", extra.strip()) if p]
            ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql.strip()
        return fn

    return add


def r(expression: str, name: str) -> str:
    """A rounded column of the SQL twin."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"
