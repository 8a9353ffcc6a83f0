"""Forecast, irradiance and device payloads in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import fill_both
from ..operators.series import SeriesOrder

FORECAST = ("hourly STRUCT<time: ARRAY<STRING>, temperature_2m: ARRAY<DOUBLE>, "
            "relative_humidity_2m: ARRAY<DOUBLE>, cloud_cover: ARRAY<DOUBLE>, "
            "wind_speed_10m: ARRAY<DOUBLE>, direct_radiation: ARRAY<DOUBLE>>")
IRRADIANCE = "properties STRUCT<parameter: STRUCT<ALLSKY_SFC_SW_DWN: MAP<STRING, DOUBLE>>>"
PAYLOAD = ("device_id STRING, readings ARRAY<STRUCT<measurement_type: STRING, value: DOUBLE, unit: STRING, "
           "metadata: STRUCT<voltage: DOUBLE, current: DOUBLE, temperature: DOUBLE, irradiance: DOUBLE>>>")
_NAMES = {"temperature_2m": "temperature", "relative_humidity_2m": "humidity", "cloud_cover": "cloud_cover",
          "wind_speed_10m": "wind_speed", "direct_radiation": "irradiance"}


def parse_forecast_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """Parallel hourly arrays to rows; missing radiation is 0, other gaps take their neighbours."""
    parsed = df.select(key, F.from_json(text, FORECAST)["hourly"].alias("h"))
    empty = F.array().cast("array<double>")  # a missing array must not take the other ones with it
    arrays = [F.col("h.time").alias("time")] + [F.coalesce(F.col(f"h.{a}"), empty).alias(a) for a in _NAMES]
    rows = parsed.select(key, F.col("h.direct_radiation").isNull().alias("_dark"),
                         F.inline(F.arrays_zip(*arrays)))
    named = rows.select(
        key, F.col("time").cast("timestamp_ntz").alias("event_ts"),
        *[F.col(a).alias(n) for a, n in _NAMES.items() if n != "irradiance"],
        F.when(F.col("_dark"), 0.0).otherwise(F.col("direct_radiation")).alias("irradiance"))
    return fill_both(named, SeriesOrder((key,), "event_ts"), list(_NAMES.values()))


def parse_irradiance_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """Date-keyed irradiance to rows."""
    by_date = F.from_json(text, IRRADIANCE)["properties"]["parameter"]["ALLSKY_SFC_SW_DWN"]
    return df.select(key, F.explode(by_date).alias("date", "irradiance_w_m2"))


def build_payload(df: DataFrame, device: str, time_key: list[str], value: str, extras: dict[str, str]) -> DataFrame:
    """One device message per row of readings: ``payload`` as JSON text."""
    metadata = F.struct(*[F.col(c).cast("double").alias(n) for n, c in extras.items()])
    reading = F.struct(F.lit("solar_generation").alias("measurement_type"), F.col(value).alias("value"),
                       F.lit("kW").alias("unit"), metadata.alias("metadata"))
    body = F.struct(F.col(device).cast("string").alias("device_id"), F.array(reading).alias("readings"))
    return df.select(*time_key, F.to_json(body).alias("payload"))


def flatten_payload(df: DataFrame, payload: str, keep: list[str] | None = None) -> DataFrame:
    """One row per reading of every message."""
    parsed = df.select(*(keep or []), F.from_json(payload, PAYLOAD).alias("m"))
    return parsed.select(*(keep or []), F.col("m.device_id").alias("device_id"), F.explode("m.readings").alias("r")).select(
        *(keep or []), "device_id", "r.measurement_type", "r.value", "r.unit", "r.metadata.*")


READING = ("timestamp TIMESTAMP_NTZ, power_kw DOUBLE, power_w DOUBLE, voltage DOUBLE, current DOUBLE, "
           "irradiance DOUBLE, panel_temperature DOUBLE, ambient_temperature DOUBLE, "
           "solar_elevation DOUBLE, status STRING")


def read_readings(spark: SparkSession, path: str, schema: str = READING) -> DataFrame:
    """Readings from JSON arrays or CSV files, by file ending."""
    if path.endswith(".csv") or path.endswith("/csv"):
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_readings(df: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "csv":
        df.write.option("header", True).csv(path)
    else:
        df.write.json(path)


def as_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))
