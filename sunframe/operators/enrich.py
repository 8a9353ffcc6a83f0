"""Weather onto readings, by place and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import SeriesOrder, neighbours


def weather_enrich(df: DataFrame, weather: DataFrame, place: list[str], ts: str, hour: str,
                   columns: list[str]) -> DataFrame:
    """Readings with the weather of their clock hour and place; readings without any stay."""
    keyed = df.withColumn("_hour", F.date_trunc("hour", ts))
    side = weather.select(*place, F.date_trunc("hour", hour).alias("_hour"), *columns)
    return keyed.join(side, [*place, "_hour"], "left").drop("_hour")


def weather_as_of(df: DataFrame, weather: DataFrame, order: SeriesOrder, hour: str, columns: list[str]) -> DataFrame:
    """Readings with the latest weather at or before them, whatever the hour.

    Both tables are merged into one series per place, so no pair is ever built.
    """
    readings = df.withColumn("_side", F.lit(1))
    reports = weather.select(*order.keys, F.col(hour).alias(order.ts), *columns, F.lit(0).alias("_side"))
    merged = readings.unionByName(reports, allowMissingColumns=True)
    lined = SeriesOrder(order.keys, order.ts, ("_side", *order.tiebreak), order.block_rows, order.grain, order.long, order.tasks)
    near = neighbours(merged, lined, columns)
    filled = near.withColumns({c: F.col(f"{c}_prev.value") for c in columns})
    return filled.where(F.col("_side") == 1).drop(
        "_side", "_sf_row", *[f"{c}_prev" for c in columns], *[f"{c}_next" for c in columns])
