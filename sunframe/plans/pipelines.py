"""The two standard preparation pipelines as Spark jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec

from ..operators import cleaning, features
from ..operators.scaling import Scaler
from ..operators.series import SeriesOrder, windowed
from ..session import materialize


def prepare_solar(df: DataFrame, order: SeriesOrder, capacity_kw: float, columns: list[str] | None = None,
                  lags: tuple[int, ...] = features.LAGS, sizes: tuple[int, ...] = features.ROLLING) -> DataFrame:
    """Everything of ``solar_pipeline`` before scaling."""
    columns = columns or cleaning.numeric_columns(df, (*order.keys, *order.tiebreak))
    order = order.resolve(df)
    filled = cleaning.fill_mean(cleaning.fill_linear(df, order, columns), columns)
    filled = materialize(filled, "solar-filled")  # the bounds below need three passes
    cleaned, _ = cleaning.outliers_iqr(filled, columns)
    lag_of = [c for c in ("power_kw", "temperature") if c in columns]
    roll_of = [c for c in ("power_kw",) if c in columns]

    def smooth(w: WindowSpec) -> dict[str, Column]:
        return cleaning.centred_means(w, columns, 3)

    def history(w: WindowSpec) -> dict[str, Column]:
        return {**features.lag_columns(w, lag_of, lags), **features.rolling_columns(w, roll_of, sizes)}

    made = windowed(cleaned, order, [smooth, history], max(max(lags), max(sizes) - 1) + 1, 1)
    made = features.time_features(made, order.ts)
    made = features.weather_features(made)
    made = features.system_features(made, {"panel_capacity_kw": float(capacity_kw)})
    return cleaning.drop_incomplete(features.interaction_features(made))


def prepare_consumption(df: DataFrame, order: SeriesOrder, columns: list[str] | None = None,
                        lags: tuple[int, ...] = features.CONSUMPTION_LAGS,
                        sizes: tuple[int, ...] = features.ROLLING) -> DataFrame:
    """Everything of ``consumption_pipeline`` before scaling."""
    columns = columns or cleaning.numeric_columns(df, (*order.keys, *order.tiebreak))
    order = order.resolve(df)
    filled = materialize(cleaning.fill_mean(
        cleaning.fill_seasonal(df, order.ts, columns), columns), "consumption-filled")
    cleaned, _ = cleaning.outliers_iqr(filled, columns)
    use = [c for c in ("power_kw",) if c in columns]

    def history(w: WindowSpec) -> dict[str, Column]:
        return {**features.lag_columns(w, use, lags), **features.rolling_columns(w, use, sizes)}

    made = windowed(cleaned, order, history, max(max(lags), max(sizes) - 1))
    made = features.weather_features(features.time_features(made, order.ts))
    return cleaning.drop_incomplete(features.interaction_features(made))


def _scaled(prepared: DataFrame, order: SeriesOrder, scaler: Scaler | None, label: str) -> tuple[DataFrame, Scaler]:
    prepared = materialize(prepared, label)
    if scaler is None:
        scaler = Scaler.fit(prepared, cleaning.numeric_columns(prepared, (*order.keys, *order.tiebreak)))
    return scaler.transform(prepared), scaler


def solar_pipeline(df: DataFrame, order: SeriesOrder, capacity_kw: float, scaler: Scaler | None = None,
                   **options) -> tuple[DataFrame, Scaler]:
    """Fill, bound, smooth, build features, drop incomplete rows, scale.

    A scaler from training is reused when given; otherwise one is fitted and returned.
    """
    return _scaled(prepare_solar(df, order, capacity_kw, **options), order, scaler, "solar-features")


def consumption_pipeline(df: DataFrame, order: SeriesOrder, scaler: Scaler | None = None,
                         **options) -> tuple[DataFrame, Scaler]:
    """Seasonal fill, bound, build features, drop incomplete rows, scale."""
    return _scaled(prepare_consumption(df, order, **options), order, scaler, "consumption-features")

