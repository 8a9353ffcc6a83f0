"""Missing values, outliers and smoothing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nearest import nearest_k
from .quantiles import quantile_table
from .series import SeriesOrder, neighbours, windowed

_ROW = "_sf_row"
IQR_REACH = 1.5
Z_LIMIT = 3.0


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def _without_helpers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(_ROW, *[f"{c}_prev" for c in columns], *[f"{c}_next" for c in columns])


def fill_forward(df: DataFrame, order: SeriesOrder, columns: list[str], limit: int = 2) -> DataFrame:
    """Last value carried on, at most ``limit`` rows into a gap."""
    near = neighbours(df, order, columns)
    filled = {c: F.coalesce(c, F.when(
        F.col(_ROW) - F.col(f"{c}_prev.row") <= limit, F.col(f"{c}_prev.value"))) for c in columns}
    return _without_helpers(near.withColumns(filled), columns)


def fill_both(df: DataFrame, order: SeriesOrder, columns: list[str]) -> DataFrame:
    """Last value carried on; a leading gap takes the first value that follows."""
    near = neighbours(df, order, columns)
    filled = {c: F.coalesce(F.col(f"{c}_prev.value"), F.col(f"{c}_next.value")) for c in columns}
    return _without_helpers(near.withColumns(filled), columns)


def fill_linear(df: DataFrame, order: SeriesOrder, columns: list[str],
                by_time: bool = False, max_gap_rows: int | None = None) -> DataFrame:
    """Straight line between the neighbours of a gap; the ends take the nearest value.

    Rows count as equally spaced. ``by_time`` weighs by elapsed time instead, ``max_gap_rows``
    leaves longer gaps open; both are off in the standard pipelines.
    """
    if by_time:
        df = df.withColumn("_sf_clock", F.unix_micros(F.col(order.ts).cast("timestamp")))
        df = df.withColumns({f"_sf_at_{c}": F.when(F.col(c).isNotNull(), F.col("_sf_clock"))
                             for c in columns})
    helped = [*columns, *[f"_sf_at_{c}" for c in columns]] if by_time else columns
    near = neighbours(df, order, helped)

    def line(c: str) -> Column:
        left, right = F.col(f"{c}_prev"), F.col(f"{c}_next")
        if by_time:
            start, end = F.col(f"_sf_at_{c}_prev.value"), F.col(f"_sf_at_{c}_next.value")
            share = (F.col("_sf_clock") - start) / (end - start)
        else:
            share = (F.col(_ROW) - left["row"]) / (right["row"] - left["row"])
        between = left["value"] + (right["value"] - left["value"]) * share
        value = F.coalesce(F.col(c), between, left["value"], right["value"])
        if max_gap_rows is None:
            return value
        gap = right["row"] - left["row"] - 1
        return F.when(F.col(c).isNotNull() | (gap <= max_gap_rows), value)

    out = _without_helpers(near.withColumns({c: line(c) for c in columns}), helped)
    return out.drop("_sf_clock", *[f"_sf_at_{c}" for c in columns]) if by_time else out


def seasonal_profile(df: DataFrame, ts: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of each column by hour and weekday (Monday = 0)."""
    return df.groupBy(*(by or []), F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday")).agg(
        *[F.avg(c).alias(c) for c in columns])


def fill_seasonal(df: DataFrame, ts: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Missing values take the mean of the same hour and weekday."""
    by = by or []
    profile = seasonal_profile(df, ts, columns, by).select(
        *[F.col(b).alias(f"_p_{b}") for b in by], F.col("hour").alias("_p_hour"),
        F.col("weekday").alias("_p_weekday"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    if not by:
        profile = F.broadcast(profile)  # at most 24 x 7 rows
    keyed = df.withColumns({"_hour": F.hour(ts), "_weekday": F.weekday(ts)})
    match = [keyed[b].eqNullSafe(profile[f"_p_{b}"]) for b in by]
    match += [keyed["_hour"] == profile["_p_hour"], keyed["_weekday"] == profile["_p_weekday"]]
    joined = keyed.join(profile, match, "left")
    filled = joined.withColumns({c: F.coalesce(c, f"_p_{c}") for c in columns})
    return filled.drop("_hour", "_weekday", "_p_hour", "_p_weekday",
                       *[f"_p_{b}" for b in by], *[f"_p_{c}" for c in columns])


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """What is still missing takes the column mean (one aggregate row, used as constants)."""
    means = column_means(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in means.items() if m is not None})


def _replace_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> tuple[DataFrame, dict[str, int]]:
    """Cells outside their bounds take the mean of the cells inside; rows stay."""
    def outside(c: str) -> Column:
        low, high = bounds[c]
        return F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))

    aggs = []
    for i, c in enumerate(bounds):
        aggs += [F.count_if(outside(c)).alias(f"n{i}"),
                 F.avg(F.when(~outside(c), F.col(c))).alias(f"m{i}")]
    seen = df.agg(*aggs).first()
    counts = {c: seen[f"n{i}"] for i, c in enumerate(bounds)}
    cleaned = df.withColumns({
        c: F.when(outside(c), F.lit(seen[f"m{i}"])).otherwise(F.col(c).cast("double"))
        for i, c in enumerate(bounds)})
    return cleaned, counts


def iqr_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    found = quantile_table(df, columns, [0.25, 0.75])
    bounds = {}
    for c, q in found.items():
        if q:
            reach = IQR_REACH * (q[0.75] - q[0.25])
            bounds[c] = (q[0.25] - reach, q[0.75] + reach)
    return bounds


def outliers_iqr(df: DataFrame, columns: list[str] | None = None,
                 keys: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Cells beyond 1.5 interquartile ranges, with counts per column."""
    return _replace_outliers(df, iqr_bounds(df, columns or numeric_columns(df, keys)))


def outliers_zscore(df: DataFrame, columns: list[str] | None = None,
                    keys: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Cells more than three population deviations from the mean, with counts per column."""
    columns = columns or numeric_columns(df, keys)
    stats = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns)
                     for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    bounds = {c: (stats[f"m{i}"] - Z_LIMIT * stats[f"s{i}"], stats[f"m{i}"] + Z_LIMIT * stats[f"s{i}"])
              for i, c in enumerate(columns) if stats[f"m{i}"] is not None}
    return _replace_outliers(df, bounds)


def smooth_mean(df: DataFrame, order: SeriesOrder, columns: list[str], window: int = 3) -> DataFrame:
    """Centred rolling mean that shrinks at the ends."""
    return windowed(df, order, lambda w: centred_means(w, columns, window), window // 2, (window - 1) // 2)


def centred_means(w: WindowSpec, columns: list[str], window: int) -> dict[str, Column]:
    frame = w.rowsBetween(-(window // 2), (window - 1) // 2)
    return {c: F.avg(c).over(frame) for c in columns}


def smooth_ewma(df: DataFrame, order: SeriesOrder, columns: list[str], span: int = 3,
                precision: float = 1e-16) -> DataFrame:
    """Recursive exponential mean, alpha = 2 / (span + 1).

    Weights fall geometrically, so a frame long enough for ``precision`` gives the full recursion.
    """
    alpha = 2 / (span + 1)
    depth = 1 if alpha >= 1 else math.ceil(math.log(precision) / math.log(1 - alpha))

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-depth, 0)

        def mean(c: str) -> Column:
            seen = F.collect_list(F.col(c).cast("double")).over(frame)
            return F.aggregate(F.slice(seen, 2, depth), F.element_at(seen, 1),
                               lambda acc, x: acc * (1 - alpha) + x * alpha)

        return {c: mean(c) for c in columns}

    return windowed(df, order, build, depth, 0)


def savgol_weights(window: int) -> np.ndarray:
    """Row j holds the weights that give the fitted parabola at position j of a window."""
    offsets = np.arange(window) - window // 2
    basis = np.vander(offsets, 3).astype(float)
    return basis @ np.linalg.pinv(basis)


def smooth_savgol(df: DataFrame, order: SeriesOrder, columns: list[str], window: int = 3) -> DataFrame:
    """Quadratic smoothing with an odd window; the ends follow the first and last parabola.

    Series with no more rows than the window stay as they are.
    """
    half, weights = window // 2, savgol_weights(window)

    def build(w: WindowSpec) -> dict[str, Column]:
        one = F.lit(1)

        def exists(step: int) -> Column:
            return (F.lead(one, step) if step > 0 else F.lag(one, -step)).over(w).isNotNull()

        def fitted(c: str, position: int) -> Column:
            total = F.lit(0.0)
            for k, weight in enumerate(weights[position]):
                step = k - position
                at = F.col(c) if step == 0 else (
                    F.lead(c, step) if step > 0 else F.lag(c, -step)).over(w)
                total = total + at * F.lit(float(weight))
            return total

        enough = F.count(one).over(w.rowsBetween(-window, window)) > window

        def smooth(c: str) -> Column:
            value = fitted(c, half)
            for j in range(half - 1, -1, -1):
                value = F.when(~exists(-(j + 1)), fitted(c, j)).otherwise(value)
            for j in range(half - 1, -1, -1):
                value = F.when(~exists(j + 1), fitted(c, window - 1 - j)).otherwise(value)
            return F.when(enough, value).otherwise(F.col(c).cast("double"))

        return {c: smooth(c) for c in columns}

    return windowed(df, order, build, window, window)


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


def incomplete_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in, rows kept and rows removed by ``drop_incomplete``."""
    whole = F.lit(True)
    for c in columns or df.columns:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count("*").alias("rows_in"), F.count_if(whole).alias("rows_kept")).withColumn(
        "rows_removed", F.col("rows_in") - F.col("rows_kept"))


def hourly_grid(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """One row per key and clock hour from its first to its last reading, with hourly means."""
    hour = F.date_trunc("hour", ts).alias("hour_ts")
    means = df.groupBy(*keys, hour).agg(*[F.avg(c).alias(c) for c in columns])
    spans = means.groupBy(*keys).agg(F.min("hour_ts").alias("lo"), F.max("hour_ts").alias("hi"))
    grid = spans.select(*keys, F.explode(F.sequence(
        "lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour_ts"))
    return grid.join(means, [*keys, "hour_ts"], "left")


# -- nearest-neighbour fill ------------------------------------------------------------------

def fill_knn(df: DataFrame, row_id: str, columns: list[str], neighbours_wanted: int = 5) -> DataFrame:
    """A missing cell takes the mean over the nearest rows that have it.

    Distance is Euclidean over the columns both rows have, scaled up for missing ones; ties go to
    the lower id. Equal rows are collapsed to one point that keeps its lowest ids, and points meet
    donors through grid cells that double in width until the nearest donors are certain, so no
    group is ever paired with itself.
    """
    means = column_means(df, columns)
    out = df
    for target in columns:
        coords = [c for c in columns if c != target]
        found = _knn_values(df, row_id, target, coords, neighbours_wanted)
        out = out.join(found, row_id, "left")
    filled = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_knn_{c}"), F.lit(means[c])) for c in columns})
    return filled.drop(*[f"_knn_{c}" for c in columns])


def _knn_values(df: DataFrame, row_id: str, target: str, coords: list[str], k: int) -> DataFrame:
    """(row_id, _knn_target) for rows that lack ``target`` and share a column with some donor.

    Rows are handled per pattern of present columns; there are at most 2^columns patterns.
    """
    lacking = df.where(F.col(target).isNull())
    donors = df.where(F.col(target).isNotNull())
    parts = []
    for asked in _patterns(lacking, coords):
        asks = _with_pattern(lacking, coords, asked)
        hits = []
        for given in _patterns(donors, coords):
            shared = [c for c in asked if c in given]
            if shared:
                hits.append(_nearest(asks, _with_pattern(donors, coords, given), row_id, target,
                                     asked, shared, (len(coords) + 1) / len(shared), k))
        if not hits:
            continue
        near = hits[0]
        for h in hits[1:]:
            near = near.unionByName(h)
        points = [f"q_{c}" for c in asked]
        best = Window.partitionBy(*points).orderBy("_square", "_donor")
        means = (near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
                 .groupBy(*points).agg(F.avg("_value").alias(f"_knn_{target}")))
        rows = asks.select(row_id, *[F.col(c).cast("double").alias(f"q_{c}") for c in asked])
        parts.append(rows.join(means, points).select(row_id, f"_knn_{target}"))
    if not parts:
        return df.limit(0).select(row_id, F.lit(None).cast("double").alias(f"_knn_{target}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _patterns(df: DataFrame, coords: list[str]) -> list[list[str]]:
    if not coords:
        return []
    seen = df.groupBy(*[F.col(c).isNotNull().alias(c) for c in coords]).count().collect()
    return [[c for c in coords if row[c]] for row in seen if any(row[c] for c in coords)]


def _with_pattern(df: DataFrame, coords: list[str], known: list[str]) -> DataFrame:
    for c in coords:
        df = df.where(F.col(c).isNotNull() if c in known else F.col(c).isNull())
    return df


def _nearest(asks: DataFrame, donors: DataFrame, row_id: str, target: str, asked: list[str],
             shared: list[str], scale: float, k: int) -> DataFrame:
    """The k nearest donors of every distinct query point over the shared columns."""
    whole = asks.select(*[F.col(c).cast("double").alias(f"q_{c}") for c in asked]).distinct()
    points = donors.select(
        F.col(row_id).alias("_donor"), F.col(target).cast("double").alias("_value"),
        *[F.col(c).cast("double").alias(f"d_{c}") for c in shared])
    square = F.lit(0.0)
    for c in shared:
        square = square + (F.col(f"q_{c}") - F.col(f"d_{c}")) * (F.col(f"q_{c}") - F.col(f"d_{c}"))
    found = nearest_k(
        whole.select(*[f"q_{c}" for c in shared]), points, [f"q_{c}" for c in shared],
        [f"d_{c}" for c in shared], "_donor", k, square, lambda width: F.lit(width * width))
    found = found.select(*[f"q_{c}" for c in shared], "_donor", "_value",
                         (F.col("_distance") * scale).alias("_square"))
    return whole.join(found, [f"q_{c}" for c in shared])
