"""Business rules: prices, energy totals, alerts, risk texts and training labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solar

# Fixed values.
MIN_PRICE, MAX_PRICE = 4.0, 12.0
TRADING_HOURS = list(range(9, 17))
RISK_NAMES = ("low", "medium", "high")
MIN_TREND_DAYS = 30


def supply_demand_ratio(supply: Column, demand: Column) -> Column:
    return supply / (demand + 0.1)


def trading_hours(df: DataFrame, supply: str = "supply", demand: str = "demand") -> DataFrame:
    """Ratio, price multiplier and the flag of balanced hours."""
    ratio = supply_demand_ratio(F.col(supply), F.col(demand))
    return df.withColumn("supply_demand_ratio", ratio).withColumns({
        "price_multiplier": F.when(ratio < 0.5, 1.5).when(ratio > 2, 0.7).otherwise(1.0),
        "is_optimal": ratio.between(0.8, 1.2).cast("int"),
    })


def price_quote(df: DataFrame, supply: str, demand: str, tariff: str, model_price: str | None = None) -> DataFrame:
    """Recommended price with its range; without a model price the tariff stands in."""
    price = F.coalesce(F.col(model_price), F.col(tariff)) if model_price else F.col(tariff)
    return df.withColumns({
        "recommended_price": price,
        "price_min": F.when(price.isNotNull(), F.greatest(F.lit(MIN_PRICE), price * 0.9)),
        "price_max": F.when(price.isNotNull(), F.least(F.lit(MAX_PRICE), price * 1.1)),
        "supply_demand_ratio": supply_demand_ratio(F.col(supply), F.col(demand)),
        "optimal_trading_hours": F.array(*[F.lit(h) for h in TRADING_HOURS]),
    })


def energy_summary(df: DataFrame, keys: list[str | Column], power: str, interval_hours: float) -> DataFrame:
    """Energy, peak, mean and producing hours per group."""
    p = F.col(power)
    return df.groupBy(*keys).agg(
        F.count("*").alias("readings"), (F.sum(p) * interval_hours).alias("energy_kwh"),
        F.max(p).alias("peak_kw"), F.avg(p).alias("mean_kw"),
        (F.count_if(p > solar.PRODUCING_ABOVE_KW) * interval_hours).alias("producing_hours"))


def _severity(share: Column, names: tuple[str, str, str]) -> Column:
    return F.when(share > 10, names[0]).when(share > 5, names[1]).otherwise(names[2])


def voltage_anomaly(df: DataFrame, keys: list[str | Column], voltage: str = "voltage",
                    low: float = 200, high: float = 260) -> DataFrame:
    """Share of readings outside the voltage band and what it means."""
    bad = (F.col(voltage) < low) | (F.col(voltage) > high)
    out = df.groupBy(*keys).agg(F.count_if(bad).alias("out_of_range"), F.count("*").alias("readings"))
    share = F.col("out_of_range") / F.col("readings") * 100
    return out.withColumns({
        "percentage": share,
        "severity": _severity(share, ("high", "medium", "low")),
        "status": _severity(share, ("CRITICAL: Frequent voltage anomalies",
                                    "WARNING: Some voltage anomalies detected",
                                    "OK: Voltage within acceptable range")),
    })


def anomaly_severity(flagged: DataFrame, keys: list[str | Column], flag: str = "is_anomaly") -> DataFrame:
    """Anomalies per device with severity, types and action."""
    out = flagged.groupBy(*keys).agg(F.sum(F.col(flag).cast("long")).alias("anomalies_detected"))
    n = F.col("anomalies_detected")
    return out.withColumn("severity", _severity(n, ("high", "medium", "low"))).withColumns({
        "anomaly_types": F.when(n > 0, F.array(F.lit("voltage_fluctuation"), F.lit("efficiency_drop"))
                                ).otherwise(F.array().cast("array<string>")),
        "recommended_action": F.when(F.col("severity") == "low", "Continue monitoring"
                                     ).otherwise("Schedule maintenance check"),
    })


def risk_report(df: DataFrame, risk_class: str, probability: str) -> DataFrame:
    """Score, category, expected return and text; an unscored row counts as medium at 0.5."""
    k = F.coalesce(F.col(risk_class).cast("long"), F.lit(1))
    name = F.lit("unknown")
    for i, label in enumerate(RISK_NAMES):
        name = F.when(k == i, label).otherwise(name)
    roi = F.greatest(F.lit(5.0), 15 - k * 50 * 0.1)
    return df.withColumns({
        "risk_score": k * 50, "risk_category": name,
        "risk_probability": F.coalesce(F.col(probability), F.lit(0.5)),
        "expected_roi_percentage": roi,
        "recommendation": F.format_string("Risk level: %s. Expected ROI: %.1f%%", name, roi),
    })


def risk_label(credit_score: Column, roi_estimate: Column) -> Column:
    """0, 1 or 2 by credit and return; intervals are closed above."""
    score = (800 - credit_score) / 200 * 0.6 + (0.2 - roi_estimate) / 0.2 * 0.4
    return F.when(score <= 0.2, 0).when(score <= 0.6, 1).otherwise(2)


def failure_label(vibration: Column, temperature: Column, age_months: Column) -> Column:
    raw = vibration * 0.4 + (temperature - 30) / 15 * 0.3 + age_months / 60 * 0.3
    return (raw > 0.7).cast("int")


def price_label(ratio: Column, hour: Column) -> Column:
    """Target price from balance and time of day, without noise."""
    price = 6.5 + (1 - ratio) * 2 + F.sin(hour / 24 * (2 * math.pi)) * 1.5
    return solar.clip(price, MIN_PRICE, MAX_PRICE)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class."""
    counted = df.groupBy(label).agg(F.count("*").alias("rows"))
    return counted.withColumn("share", F.col("rows") / counted.agg(F.sum("rows")).scalar())


def prediction_stats(df: DataFrame, prediction: str, by: list[str] | None = None) -> DataFrame:
    p = F.col(prediction)
    return df.groupBy(*(by or [])).agg(
        F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"),
        F.stddev_pop(p).alias("std"), F.count(p).alias("rows"),
        F.count_if(p > solar.PRODUCING_ABOVE_KW).alias("non_zero"))


def degradation_trend(daily: DataFrame, keys: list[str], day: str, efficiency: str,
                      threshold: float = 0.02) -> DataFrame:
    """Least-squares slope of daily efficiency per device, scaled to a year.

    ``daily`` has one row per device and day, so a device's rows are bounded by the calendar.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(day)
    numbered = daily.withColumn("_x", (F.row_number().over(w) - 1).cast("double"))
    fit = numbered.groupBy(*keys).agg(
        F.count("*").alias("days_analyzed"), F.max_by(efficiency, "_x").alias("_latest"),
        F.regr_slope(F.col(efficiency), F.col("_x")).alias("_slope"))
    enough = F.col("days_analyzed") >= MIN_TREND_DAYS
    yearly = F.when(F.col("_latest") > 0, F.col("_slope") * 365 / F.col("_latest")).otherwise(0.0)
    return fit.select(
        *keys, "days_analyzed", F.when(enough, "success").otherwise("insufficient_data").alias("status"),
        F.when(enough, F.col("_latest")).alias("current_efficiency"),
        F.when(enough, F.col("_slope")).alias("daily_degradation"),
        F.when(enough, yearly).alias("annual_degradation_rate"),
        F.when(enough, yearly < -threshold).alias("is_degrading"))
