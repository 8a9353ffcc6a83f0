"""Forecast tables: seasonal regression per series, direct horizon models and fallbacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solar
from ..session import materialize
from . import models
from .features import sequences
from .series import SeriesOrder

# Fixed values: (period in hours, number of waves).
SEASONS = ((24.0, 3), (168.0, 2), (8766.0, 2))
MIN_HISTORY = 48
Z_95 = 1.959963984540054
TREND_START = "2020-01-01"


def _basis(ts: Column) -> list[Column]:
    """Constant, trend in years and sine and cosine waves of day, week and year."""
    hours = (F.unix_micros(ts.cast("timestamp")) / 3.6e9) - F.unix_micros(F.lit(TREND_START).cast("timestamp")) / 3.6e9
    columns = [F.lit(1.0), hours / 8766.0]
    for period, waves in SEASONS:
        for k in range(1, waves + 1):
            angle = hours * (2 * math.pi * k / period)
            columns += [F.sin(angle), F.cos(angle)]
    return columns


def fit_seasonal(df: DataFrame, keys: list[str], ts: str, value: str, ridge: float = 1.0) -> DataFrame:
    """Ridge regression per series: (keys, rows, last_ts, coefficients, sigma).

    The cross products are plain sums, combined map-side, so the length of a series does not
    matter; only one row per series is solved in Python.
    """
    known = df.where(F.col(value).isNotNull())
    basis = _basis(F.col(ts))
    p = len(basis)
    y = F.col(value).cast("double")
    named = known.select(*keys, ts, y.alias("_y"), *[b.alias(f"_x{i}") for i, b in enumerate(basis)])
    cross = [(i, j) for i in range(p) for j in range(i, p)]
    sums = named.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.max(ts).alias("last_ts"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"),
        *[F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"_xy{i}") for i in range(p)],
        *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_xx{i}_{j}") for i, j in cross])
    long_enough = sums.where(F.col("rows") > MIN_HISTORY)

    @F.pandas_udf("coefficients array<double>, sigma double")
    def solve(rows: pd.Series, yy: pd.Series, xy: pd.Series, xx: pd.Series) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"coefficients": [], "sigma": []})
        penalty = np.eye(p) * ridge
        penalty[0, 0] = 1e-9
        i, j = np.triu_indices(p)
        gram = np.zeros((len(rows), p, p))
        gram[:, i, j] = gram[:, j, i] = np.stack(xx.to_list())
        a = np.stack(xy.to_list()).astype(float)
        beta = np.linalg.solve(gram + penalty, a[:, :, None])[:, :, 0]
        fitted = np.einsum("np,npq,nq->n", beta, gram, beta)
        rest = np.maximum(yy.to_numpy(float) - 2 * (beta * a).sum(axis=1) + fitted, 0.0)
        sigma = np.sqrt(rest / np.maximum(rows.to_numpy(float) - p, 1))
        return pd.DataFrame({"coefficients": beta.tolist(), "sigma": sigma})

    solved = solve("rows", "_yy", F.array(*[f"_xy{i}" for i in range(p)]),
                   F.array(*[f"_xx{i}_{j}" for i, j in cross]))
    return long_enough.withColumn("_fit", solved).select(
        *keys, "rows", "last_ts", "_fit.coefficients", "_fit.sigma")


def seasonal_forecast(df: DataFrame, keys: list[str], ts: str, value: str, hours: int = 48) -> DataFrame:
    """The next hours of every series with more than 48 rows, with a 95% band, never negative."""
    fitted = fit_seasonal(df, keys, ts, value)
    start = F.date_trunc("hour", "last_ts")
    ahead = fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(hours)))).withColumn(
        "hour_ts", start.cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("step")))
    guess = F.aggregate(F.arrays_zip(F.array(*_basis(F.col("hour_ts"))).alias("x"), F.col("coefficients").alias("c")),
                        F.lit(0.0), lambda acc, pair: acc + pair["x"] * pair["c"])
    floor = F.lit(0.0)
    spread = F.col("sigma") * Z_95
    return ahead.withColumn("_g", guess).select(
        *keys, "hour_ts", F.greatest(floor, F.col("_g")).alias("prediction"),
        F.greatest(floor, F.col("_g") - spread).alias("lower"),
        F.greatest(floor, F.col("_g") + spread).alias("upper"))


def weather_adjust(forecast: DataFrame, weather: DataFrame, on: list[str]) -> DataFrame:
    """Forecast scaled by cloud and heat; hours without weather keep their value."""
    both = forecast.join(weather.select(*on, "cloud_cover", "temperature"), on, "left")
    adjusted = solar.weather_adjusted(F.col("prediction"), F.coalesce("cloud_cover", F.lit(0.0)),
                                      F.coalesce("temperature", F.lit(25.0)))
    return both.withColumn("adjusted", adjusted)


def horizon_rows(df: DataFrame, order: SeriesOrder, value: str, lookback: int, horizon: int,
                 hours_per_step: int = 1) -> DataFrame:
    """One training row per (position, step ahead) with the recent values as columns; ``back_0`` is the last known one."""
    samples = sequences(df, order, [value], value, lookback, horizon)
    wide = samples.select(
        *order.keys, F.col(order.ts).alias("origin_ts"),
        *[F.col("window")[lookback - 1 - i][0].alias(f"back_{i}") for i in range(lookback)],
        F.posexplode("label").alias("_pos", "label"))
    when = F.col("origin_ts").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("_pos") + 1) * hours_per_step)
    return wide.withColumns({
        "step": F.col("_pos") + 1,
        "target_hour_sin": F.sin(F.hour(when) * (2 * math.pi / 24)),
        "target_hour_cos": F.cos(F.hour(when) * (2 * math.pi / 24)),
    }).drop("_pos")


def horizon_features(lookback: int) -> list[str]:
    return [f"back_{i}" for i in range(lookback)] + ["step", "target_hour_sin", "target_hour_cos"]


def horizon_forecast(df: DataFrame, order: SeriesOrder, value: str, lookback: int = 168, horizon: int = 48,
                     trees: int = 100, hours_per_step: int = 1, test_share: float = 0.2) -> DataFrame:
    """Direct multi-step forecast: one boosted model over all (position, step) rows, scored on the later time range.

    Positions to learn from end a horizon before that range begins. ``last_value`` is the forecast that nothing changes.
    """
    rows = horizon_rows(df, order, value, lookback, horizon, hours_per_step)
    names = horizon_features(lookback)
    parts = materialize(models.split_by_time(rows, "origin_ts", horizon * hours_per_step, test_share), "horizon-rows")
    model = models.gbt(names, "label", trees, 0.1, 6).fit(
        parts.where("part = 'train'").withColumns({c: F.col(c).cast("double") for c in names}))
    return models.predict(model, parts.where("part = 'test'")).select(
        *order.keys, "origin_ts", "step", "label", "prediction", F.col("back_0").alias("last_value"))


def hours_ahead(df: DataFrame, start: Column, hours: int, name: str = "hour_ts") -> DataFrame:
    """Every row once per hour from ``start``."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))
    return df.withColumn("step", steps).withColumn(
        name, F.date_trunc("hour", start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("step")))


def solar_forecast_table(hosts: DataFrame, host: str, capacity: str, start: Column, hours: int,
                         model: DataFrame | None = None, weather: DataFrame | None = None,
                         preset: str = "post") -> DataFrame:
    """Hourly forecast per host: model value, else solar potential from weather, else a sine of the day.

    ``model`` has (host, hour_ts, prediction), ``weather`` (hour_ts, cloud_cover).
    """
    grid = hours_ahead(hosts.select(host, F.col(capacity).alias("_cap")), start, hours)
    cap, when = F.col("_cap"), F.col("hour_ts")
    sources = []
    if model is not None:
        grid = grid.join(model.select(host, "hour_ts", F.col("prediction").alias("_model")), [host, "hour_ts"], "left")
        sources.append((F.col("_model"), "model"))
    if weather is not None:
        grid = grid.join(weather.select("hour_ts", F.col("cloud_cover").alias("_cloud")), ["hour_ts"], "left")
        sources.append((solar.solar_potential(when, F.col("_cloud")) / 1000 * cap, "weather"))
    sources.append((solar.daylight_factor(when) * cap, "daylight"))
    value = F.coalesce(*[s for s, _ in sources])
    origin = F.lit(sources[-1][1])
    for source, label in reversed(sources[:-1]):
        origin = F.when(source.isNotNull(), label).otherwise(origin)
    power = solar.clip(value, 0.0, cap)
    low, high = solar.band(F.col("predicted_kwh"), preset)
    return grid.withColumn("predicted_kwh", power).select(
        host, "hour_ts", "predicted_kwh", low.alias("confidence_lower"), high.alias("confidence_upper"),
        origin.alias("source"))


# The weather a request without data assumes.
BASELINE_WEATHER = {"temperature": 30.0, "humidity": 50.0, "cloud_cover": 50.0}


def baseline_forecast(hosts: DataFrame, host: str, start: Column, hours: int,
                      model: "models.PipelineModel | None" = None) -> DataFrame:
    """Forecast from constant weather; zero without a model."""
    grid = hours_ahead(hosts.select(host), start, hours).withColumns({
        **{k: F.lit(v) for k, v in BASELINE_WEATHER.items()},
        "hour": F.hour("hour_ts"), "day_of_week": F.weekday("hour_ts"), "month": F.month("hour_ts")})
    scored = models.predict(model, grid) if model is not None else grid.withColumn("prediction", F.lit(0.0))
    low, high = solar.band(F.col("prediction"), "get")
    return scored.select(host, "hour_ts", *BASELINE_WEATHER, "hour", "day_of_week", "month",
                         F.col("prediction").alias("predicted_kwh"), low.alias("confidence_lower"),
                         high.alias("confidence_upper"))


def demand_forecast_table(history: DataFrame, keys: list[str], ts: str, value: str, hours: int,
                          model_rows: DataFrame | None = None) -> DataFrame:
    """Hourly demand per user after its last reading; zero where no model value exists."""
    last = history.groupBy(*keys).agg(F.max(ts).alias("_last"))
    grid = hours_ahead(last, F.col("_last") + F.make_dt_interval(hours=F.lit(1)), hours).drop("_last")
    if model_rows is None:
        return grid.withColumn("predicted_kwh", F.lit(0.0)).drop("step")
    joined = grid.join(model_rows.select(*keys, "hour_ts", "prediction"), [*keys, "hour_ts"], "left")
    return joined.withColumn("predicted_kwh", F.coalesce("prediction", F.lit(0.0))).drop("prediction", "step")
