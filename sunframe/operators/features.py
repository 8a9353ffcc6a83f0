"""Features for the models: calendar, weather, system, lag and rolling columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import solar
from .series import SeriesOrder, number_rows, windowed

LAGS = (1, 24, 168)
CONSUMPTION_LAGS = (1, 24, 168, 720)
ROLLING = (6, 24, 168)


def _turn(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def time_features(df: DataFrame, ts: str) -> DataFrame:
    """Cyclic hour, weekday and month, day of year and four calendar flags."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    out = {}
    for name, value, period in (("hour", hour, 24), ("day_of_week", weekday, 7),
                                ("month", F.month(ts), 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = _turn(value, period)
    out["day_of_year"] = (F.dayofyear(ts) - 1) / 365
    out["is_weekend"] = _flag(weekday >= 5)
    out["is_daytime"] = _flag(hour.between(6, 18))
    out["is_peak_solar"] = _flag(hour.between(10, 15))
    out["is_peak_consumption"] = _flag(hour.between(18, 22))
    return df.withColumns(out)


def sky_flags(df: DataFrame, description: str = "description") -> DataFrame:
    """Clear, cloudy and rainy flags from free text."""
    text = F.lower(description)
    return df.withColumns({
        "is_clear": _flag(text.rlike("clear|sunny")),
        "is_cloudy": _flag(text.rlike("cloud")),
        "is_rainy": _flag(text.rlike("rain|drizzle")),
    })


def weather_features(df: DataFrame) -> DataFrame:
    """Clear-sky index, irradiance proxy, heat index, wind chill and sky flags, as inputs allow."""
    have, out = set(df.columns), {}
    if "cloud_cover" in have:
        clear = 1 - F.col("cloud_cover") / 100 * 0.75
        out["clear_sky_index"] = clear
        out["estimated_irradiance"] = clear * solar.PEAK_IRRADIANCE
    if {"temperature", "humidity"} <= have:
        t = F.col("temperature")
        vapour = F.exp(t * 17.67 / (t + 243.5)) * 6.112
        out["heat_index"] = t + F.col("humidity") / 100 * vapour * (5 / 9) - 10
    if {"temperature", "wind_speed"} <= have:
        t, wind = F.col("temperature"), F.pow(F.col("wind_speed") * 3.6, F.lit(0.16))
        out["wind_chill"] = 13.12 + t * 0.6215 - wind * 11.37 + t * wind * 0.3965
    df = df.withColumns(out) if out else df
    return sky_flags(df) if "description" in have else df


def system_features(df: DataFrame, specs: dict[str, Column | float | int | str]) -> DataFrame:
    """Degradation, theoretical maximum and ``system_*`` columns from constants or registry columns."""
    as_col = {k: v if isinstance(v, Column) else F.lit(v) for k, v in specs.items()}
    out = {}
    if "panel_age_years" in as_col:
        out["panel_degradation_factor"] = 1 - as_col["panel_age_years"] * 0.007
        if "panel_capacity_kw" in as_col:
            out["theoretical_max_power"] = as_col["panel_capacity_kw"] * out["panel_degradation_factor"]
    out.update({f"system_{k}": v for k, v in as_col.items() if k not in df.columns})
    return df.withColumns(out)


def interaction_features(df: DataFrame) -> DataFrame:
    have, out = set(df.columns), {}
    if {"temperature", "hour_sin"} <= have:
        out["temp_hour_interaction"] = F.col("temperature") * F.col("hour_sin")
    if {"irradiance", "system_panel_efficiency"} <= have:
        out["expected_generation_interaction"] = F.col("irradiance") * F.col("system_panel_efficiency")
    if "temperature" in have:
        out["temperature_squared"] = F.col("temperature") * F.col("temperature")
    return df.withColumns(out) if out else df


def lag_columns(w: WindowSpec, columns: list[str], lags: tuple[int, ...]) -> dict[str, Column]:
    return {f"{c}_lag_{n}h": F.lag(c, n).over(w) for c in columns for n in lags}


def rolling_columns(w: WindowSpec, columns: list[str], sizes: tuple[int, ...]) -> dict[str, Column]:
    out = {}
    for c in columns:
        for n in sizes:
            frame = w.rowsBetween(-(n - 1), 0)
            for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)):
                out[f"{c}_rolling_{name}_{n}h"] = f(c).over(frame)
    return out


def lag_features(df: DataFrame, order: SeriesOrder, columns: list[str],
                 lags: tuple[int, ...] = LAGS) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    return windowed(df, order, lambda w: lag_columns(w, columns, lags), max(lags))


def rolling_features(df: DataFrame, order: SeriesOrder, columns: list[str],
                     sizes: tuple[int, ...] = ROLLING) -> DataFrame:
    """Mean, sample deviation, maximum and minimum over the last n rows."""
    columns = [c for c in columns if c in df.columns]
    return windowed(df, order, lambda w: rolling_columns(w, columns, sizes), max(sizes) - 1)


def sequences(df: DataFrame, order: SeriesOrder, features: list[str], target: str,
              lookback: int, horizon: int = 1) -> DataFrame:
    """Training samples: ``window`` holds the last ``lookback`` rows, ``label`` the next values."""
    def build(w: WindowSpec) -> dict[str, Column]:
        cells = F.array(*[F.col(c).cast("double") for c in features])
        ahead = w.rowsBetween(1, horizon)
        return {
            "window": F.collect_list(cells).over(w.rowsBetween(-(lookback - 1), 0)),
            "label": F.collect_list(F.col(target).cast("double")).over(ahead),
            "_seen": F.count(F.lit(1)).over(w.rowsBetween(-(lookback - 1), 0)),
            "_ahead": F.count(F.lit(1)).over(ahead),
        }

    made = windowed(df, order, build, lookback - 1, horizon)
    return made.where((F.col("_seen") == lookback) & (F.col("_ahead") == horizon)).drop("_seen", "_ahead")


def electrical_features(df: DataFrame, power: str = "power_kw", voltage: str = "voltage") -> DataFrame:
    """Watts, current and producing status of a reading."""
    watts = F.col(power) * 1000
    return df.withColumns({
        "power_w": watts,
        "current": F.when((F.col(power) > 0) & (F.col(voltage) > 0), watts / F.col(voltage)).otherwise(0.0),
        "status": F.when(F.col(power) > solar.PRODUCING_ABOVE_KW, "producing").otherwise("idle"),
    })


def solar_position(df: DataFrame, ts: str, latitude: str) -> DataFrame:
    """Declination, hour angle, elevation, azimuth and clear-sky irradiance."""
    when, lat = F.col(ts), F.col(latitude)
    height = solar.elevation_deg(when, lat)
    return df.withColumns({
        "declination": solar.declination_deg(when), "hour_angle": solar.hour_angle_deg(when),
        "elevation": height, "azimuth": solar.azimuth_deg(when),
        "clear_irradiance": solar.clear_irradiance(height),
    })


def assemble_features(df: DataFrame, wanted: list[str], order: SeriesOrder | None = None,
                      start: str = "2023-01-01 00:00:00", timestamp: str = "timestamp") -> DataFrame:
    """The wanted columns that exist; ``order`` adds a regular hourly clock per series."""
    kept = [c for c in wanted if c in df.columns]
    if order is None:
        return df.select(*kept)
    order = order.resolve(df)
    if order.long:
        numbered = number_rows(df, order, "_n")
    else:
        w = Window.partitionBy(*order.keys).orderBy(order.ts, *order.tiebreak)
        numbered = df.withColumn("_n", F.row_number().over(w))
    begin = F.lit(start).cast("timestamp_ntz")
    clock = begin + F.make_dt_interval(hours=(F.col("_n") - 1).cast("int"))
    return numbered.withColumn(timestamp, clock).select(*order.keys, *kept, timestamp)
