"""Sun position, irradiance and power formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PEAK_IRRADIANCE = 1000.0
SYSTEM_EFFICIENCY = 0.85
DAYLIGHT_START_HOUR = 6
MAX_DECLINATION_DEG = 23.45
PRODUCING_ABOVE_KW = 0.01


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    """Value within bounds; ``greatest`` and ``least`` alone would turn a missing one into a bound."""
    as_col = [x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high)]
    return F.when(value.isNotNull(), F.least(as_col[1], F.greatest(as_col[0], value)))


def not_negative(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def daylight_factor(ts: Column) -> Column:
    """Half sine from 6 to 18 o'clock, zero at night."""
    return not_negative(F.sin((F.hour(ts) - DAYLIGHT_START_HOUR) * (math.pi / 12)))


def solar_potential(ts: Column, cloud_cover: Column) -> Column:
    """Expected irradiance in W/m2 from hour, cloud cover and season."""
    clouds = 1 - cloud_cover / 100 * 0.9
    season = 0.7 + F.abs(F.sin(F.dayofyear(ts) * (2 * math.pi) / 365)) * 0.3
    return not_negative(daylight_factor(ts) * clouds * season * PEAK_IRRADIANCE)


def power_from_ghi(ghi: Column, capacity_kw: float | Column) -> Column:
    cap = capacity_kw if isinstance(capacity_kw, Column) else F.lit(float(capacity_kw))
    return clip(ghi / PEAK_IRRADIANCE * cap * SYSTEM_EFFICIENCY, 0.0, cap)


def declination_deg(ts: Column) -> Column:
    return F.sin(F.radians((F.dayofyear(ts) + 284) * (360 / 365))) * MAX_DECLINATION_DEG


def hour_angle_deg(ts: Column) -> Column:
    return (F.hour(ts) + F.minute(ts) / 60 - 12) * 15


def elevation_deg(ts: Column, lat: Column) -> Column:
    lat_r, dec, turn = F.radians(lat), F.radians(declination_deg(ts)), F.radians(hour_angle_deg(ts))
    height = F.sin(lat_r) * F.sin(dec) + F.cos(lat_r) * F.cos(dec) * F.cos(turn)
    return not_negative(F.degrees(F.asin(height)))


def azimuth_deg(ts: Column) -> Column:
    return hour_angle_deg(ts) + 180


def clear_irradiance(elevation: Column) -> Column:
    return F.sin(F.radians(elevation)) * PEAK_IRRADIANCE


def weather_adjusted(forecast: Column, cloud_cover: Column, temperature: Column) -> Column:
    """Forecast after cloud loss (80% at full cover) and heat loss (0.4% per degree over 25)."""
    heat = 1 - F.greatest(F.lit(0.0), temperature - 25) * 0.004
    return not_negative(forecast * (1 - cloud_cover / 100 * 0.8) * heat)


# Share of the prediction on either side of it.
BAND_PRESETS = {"post": 0.15, "get": 0.2, "normal90": 0.2 * 1.645}


def band(prediction: Column, preset: str) -> tuple[Column, Column]:
    share = BAND_PRESETS[preset]
    return not_negative(prediction * (1 - share)), prediction * (1 + share)
