"""Queries over validation, cleaning and feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import solar
from ..functions.geo import haversine_km, planar_km
from ..operators import cleaning, features, scaling, validation
from ..sources.csvfiles import detect_source
from . import pipelines
from .registry import BY_DEVICE, SERIES, big, query, r

METER = {"event_ts": "timestamp", "power_kw": "active_power_kw", "voltage": "voltage_v",
         "frequency": "frequency_hz"}
GENERATION = {"current_a": "current"}


def meter(spark, sf):
    return view(spark, sf, "readings").withColumnsRenamed(METER)


def generation(spark, sf):
    return view(spark, sf, "readings").withColumnsRenamed(GENERATION)


def _counts_sql(limits: dict, source: dict[str, str], by: str = "") -> str:
    """UNION of one row per checked column."""
    key = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    rows = []
    for name, (low, high) in limits.items():
        c = source.get(name, name)
        below = f"count(*) FILTER (WHERE {c} < {low})" if low is not None else "0"
        above = f"count(*) FILTER (WHERE {c} > {high})" if high is not None else "0"
        rows.append(f"SELECT {key}'{name}' AS column_name, {big(below, 'below_min')}, "
                    f"{big(above, 'above_max')} FROM readings{tail}")
    return " UNION ALL ".join(rows)


_METER_LIMITS = {"active_power_kw": (0, 100), "power_factor": (0, 1), "voltage_v": (190, 260),
                 "current_a": (0, 100), "frequency_hz": (49.5, 50.5)}
_BACK = {v: k for k, v in METER.items()}


# -- schema and validation -------------------------------------------------------------------

@query("check_columns", """
    SELECT column_name, CASE WHEN wanted AND have THEN 'ok' WHEN wanted THEN 'missing' ELSE 'extra' END AS status,
           wanted AND NOT have AS is_error
    FROM (SELECT column_name, bool_or(side = 'want') AS wanted, bool_or(side = 'have') AS have FROM (
        SELECT unnest(['timestamp', 'active_energy_kwh', 'active_power_kw', 'reactive_power_kvar',
            'apparent_power_kva', 'power_factor', 'voltage_v', 'current_a', 'frequency_hz',
            'data_quality_flag', 'estimated_flag']) AS column_name, 'want' AS side
        UNION ALL SELECT CASE column_name WHEN 'event_ts' THEN 'timestamp' WHEN 'power_kw' THEN 'active_power_kw'
            WHEN 'voltage' THEN 'voltage_v' WHEN 'frequency' THEN 'frequency_hz' ELSE column_name END, 'have'
        FROM (DESCRIBE SELECT * FROM readings)) GROUP BY column_name)""", "readings")
def _check_columns(spark, sf):
    return validation.check_columns(meter(spark, sf), "meter")


@query("check_types", f"""
    SELECT 'timestamp' AS column_name, 'datetime' AS expected, 'ok' AS status, {big('0', 'bad_values')}
    UNION ALL SELECT name, kind, 'missing', 0 FROM (VALUES ('active_energy_kwh', 'float'),
        ('reactive_power_kvar', 'float'), ('apparent_power_kva', 'float'), ('data_quality_flag', 'int'),
        ('estimated_flag', 'int')) t(name, kind)
    UNION ALL SELECT name, 'float', 'ok', 0 FROM (VALUES ('power_factor'), ('voltage_v'), ('current_a'),
        ('frequency_hz')) t(name)
    UNION ALL SELECT 'active_power_kw', 'float', CASE WHEN bad > 0 THEN 'wrong type' ELSE 'ok' END, bad FROM (
        SELECT CAST(count(*) FILTER (WHERE reading_id % 10 = 0) AS BIGINT) AS bad FROM readings)""", "readings")
def _check_types(spark, sf):
    text = F.when(F.col("reading_id") % 10 == 0, "n/a").otherwise(F.col("active_power_kw").cast("string"))
    return validation.check_types(meter(spark, sf).withColumn("active_power_kw", text), "meter")


@query("contract_ranges", _counts_sql(_METER_LIMITS, _BACK), "readings")
def _contract_ranges(spark, sf):
    return validation.contract_ranges(meter(spark, sf), "meter")


@query("canonicalize_columns", f"""
    SELECT reading_id, {r('ghi', 'GHI')}, {r('dni', 'DNI')}, {r('temperature', 'Temperature')},
           {r('zenith_angle', 'zenith_angle')} FROM irradiance""", "irradiance")
def _canonicalize(spark, sf):
    df = view(spark, sf, "irradiance").select(
        "reading_id", "ghi", F.col("dni").alias("Direct Normal Irradiance"),
        F.col("temperature").alias("Air Temperature"), "zenith_angle")
    return validation.canonicalize_columns(df)


@query("detect_source", f"""
    SELECT source, {big('count(*)', 'rows')} FROM (
        SELECT 'meter' AS source FROM readings UNION ALL SELECT 'nsrdb' FROM readings
        UNION ALL SELECT 'weather' FROM readings UNION ALL SELECT 'unknown' FROM readings) GROUP BY source""",
       "readings")
def _detect_source(spark, sf):
    base = view(spark, sf, "readings")
    shapes = [base, view(spark, sf, "irradiance"), base.select("temperature", "humidity", "wind_speed"),
              base.select("reading_id", "voltage")]
    out = None
    for df in shapes:
        part = df.select(F.lit(detect_source(df.columns)).alias("source"))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("source").agg(F.count("*").alias("rows"))


_SOLAR_LIMITS = {"power_kw": (0, 6.0), "voltage": (200, 260), "current": (0, 100), "frequency": (49.5, 50.5),
                 "power_factor": (0.8, 1.0), "temperature": (-20, 60)}


@query("validate_ranges", _counts_sql(_SOLAR_LIMITS, {"current": "current_a"}, "device_id"), "readings")
def _validate_ranges(spark, sf):
    return validation.validate_ranges(generation(spark, sf), "solar_generation", 5.0, ["device_id"])


@query("validate_ranges_consumption", _counts_sql(
    {"power_kw": (0, 50), **{k: v for k, v in _SOLAR_LIMITS.items() if k not in ("power_kw", "temperature")}},
    {"current": "current_a"}), "readings")
def _validate_consumption(spark, sf):
    return validation.validate_ranges(generation(spark, sf), "consumption")


@query("validate_ranges_weather", _counts_sql(
    {"temperature": (-20, 60), "humidity": (0, 100), "wind_speed": (0, 50), "cloud_cover": (0, 100)}, {}), "readings")
def _validate_weather(spark, sf):
    return validation.validate_ranges(view(spark, sf, "readings"), "weather")


@query("validate_temporal", f"""
    SELECT device_id, {big('sum(back)', 'order_violations')}, {big('count(*) - count(DISTINCT ts)', 'duplicate_timestamps')}
    FROM (SELECT device_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY device_id ORDER BY reading_id)
                 THEN 1 ELSE 0 END AS back
          FROM (SELECT device_id, reading_id, date_trunc('minute', event_ts)
                    - CASE WHEN reading_id % 20 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS ts FROM readings))
    GROUP BY device_id""", "readings")
def _validate_temporal(spark, sf):
    moved = F.date_trunc("minute", "event_ts") - F.when(
        F.col("reading_id") % 20 == 0, F.expr("INTERVAL 3 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    df = view(spark, sf, "readings").withColumn("event_ts", moved)
    return validation.validate_temporal(df, BY_DEVICE, "reading_id")


@query("validate_night", f"""
    SELECT device_id, {big("count(*) FILTER (WHERE (hour(event_ts) < 5 OR hour(event_ts) > 19) AND power_kw > 0.1)",
                           'suspicious_readings')} FROM readings GROUP BY device_id""", "readings")
def _validate_night(spark, sf):
    return validation.night_generation(view(spark, sf, "readings"), "event_ts", "power_kw", by=["device_id"])


_FLAG_SQL = """list_filter([
    CASE WHEN power_kw < 0 THEN 'power_kw below minimum' END, CASE WHEN power_kw > 6.0 THEN 'power_kw above maximum' END,
    CASE WHEN voltage < 200 THEN 'voltage below minimum' END, CASE WHEN voltage > 260 THEN 'voltage above maximum' END,
    CASE WHEN current_a < 0 THEN 'current below minimum' END, CASE WHEN current_a > 100 THEN 'current above maximum' END,
    CASE WHEN frequency < 49.5 THEN 'frequency below minimum' END,
    CASE WHEN frequency > 50.5 THEN 'frequency above maximum' END,
    CASE WHEN power_factor < 0.8 THEN 'power_factor below minimum' END,
    CASE WHEN power_factor > 1.0 THEN 'power_factor above maximum' END,
    CASE WHEN temperature < -20 THEN 'temperature below minimum' END,
    CASE WHEN temperature > 60 THEN 'temperature above maximum' END], lambda x: x IS NOT NULL)"""


@query("row_flags", f"SELECT reading_id, {_FLAG_SQL} AS broken_rules FROM readings", "readings")
def _row_flags(spark, sf):
    return validation.row_flags(generation(spark, sf), "solar_generation", 5.0).select("reading_id", "broken_rules")


@query("row_flags_share", f"""
    SELECT device_id, {big('count(*) FILTER (WHERE len(f) = 0)', 'good_rows')},
           {big('count(*) FILTER (WHERE len(f) > 0)', 'bad_rows')},
           {r('count(*) FILTER (WHERE len(f) > 0) / count(*)', 'bad_share')},
           count(*) FILTER (WHERE len(f) > 0) / count(*) > 0.5 AS escalate
    FROM (SELECT device_id, {_FLAG_SQL} AS f FROM readings) GROUP BY device_id""", "readings")
def _row_flags_share(spark, sf):
    flagged = validation.row_flags(generation(spark, sf), "solar_generation", 5.0)
    return validation.good_bad_share(flagged, ["device_id"])


_FFILL = f"last_value({{c}} IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BFILL = f"first_value({{c}} IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("require_columns", f"""
    SELECT reading_id, {r(f"coalesce({_FFILL.format(c='t')}, {_BFILL.format(c='t')})", '"Temperature"')},
           {r('ghi', '"GHI"')}, {r('dni', '"DNI"')}, {r('dhi', '"DHI"')}
    FROM (SELECT *, CASE WHEN reading_id % 7 = 0 THEN NULL ELSE temperature END AS t FROM irradiance)""", "irradiance")
def _require_columns(spark, sf):
    df = view(spark, sf, "irradiance").withColumnsRenamed(
        {"temperature": "Temperature", "ghi": "GHI", "dni": "DNI", "dhi": "DHI"})
    df = df.withColumn("Temperature", F.when(F.col("reading_id") % 7 != 0, F.col("Temperature")))
    checked = validation.require_columns(df)
    filled = cleaning.fill_both(checked, BY_DEVICE, list(validation.REQUIRED_IRRADIANCE))
    return filled.select("reading_id", *validation.REQUIRED_IRRADIANCE)


# -- cleaning --------------------------------------------------------------------------------

GAPS = ["power_kw", "temperature"]
_NUMBERED = f"""numbered AS (SELECT *, row_number() OVER ({SERIES}) AS rn FROM readings_gappy)"""


def _near_sql(c: str) -> str:
    back = f"({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    row = f"CASE WHEN {c} IS NOT NULL THEN rn END"
    return (f"last_value({c} IGNORE NULLS) OVER {back} AS {c}_pv, last_value({row} IGNORE NULLS) OVER {back} AS {c}_pr, "
            f"first_value({c} IGNORE NULLS) OVER {ahead} AS {c}_nv, "
            f"first_value({row} IGNORE NULLS) OVER {ahead} AS {c}_nr")


_NEAR = f"near AS (SELECT *, {_near_sql('power_kw')}, {_near_sql('temperature')} FROM numbered)"


def _keys(df):
    return df.select("reading_id", *GAPS)


@query("fill_forward", f"""
    SELECT reading_id, {', '.join(r(f'CASE WHEN {c} IS NOT NULL THEN {c} WHEN rn - {c}_pr <= 2 THEN {c}_pv END', c)
                                  for c in GAPS)} FROM near""", "readings_gappy", f"{_NUMBERED}, {_NEAR}")
def _fill_forward(spark, sf):
    return _keys(cleaning.fill_forward(view(spark, sf, "readings_gappy"), BY_DEVICE, GAPS, 2))


@query("fill_both", f"SELECT reading_id, {', '.join(r(f'coalesce({c}_pv, {c}_nv)', c) for c in GAPS)} FROM near",
       "readings_gappy", f"{_NUMBERED}, {_NEAR}")
def _fill_both(spark, sf):
    return _keys(cleaning.fill_both(view(spark, sf, "readings_gappy"), BY_DEVICE, GAPS))


def _linear_sql(c: str) -> str:
    return (f"coalesce({c}, {c}_pv + ({c}_nv - {c}_pv) * ((rn - {c}_pr)::DOUBLE / ({c}_nr - {c}_pr)), "
            f"{c}_pv, {c}_nv)")


@query("fill_linear", f"SELECT reading_id, {', '.join(r(_linear_sql(c), c) for c in GAPS)} FROM near",
       "readings_gappy", f"{_NUMBERED}, {_NEAR}")
def _fill_linear(spark, sf):
    return _keys(cleaning.fill_linear(view(spark, sf, "readings_gappy"), BY_DEVICE, GAPS))


@query("fill_seasonal", f"""
    SELECT reading_id, {', '.join(
        r(f'coalesce({c}, avg({c}) OVER (PARTITION BY hour(event_ts), isodow(event_ts)))', c) for c in GAPS)}
    FROM readings_gappy""", "readings_gappy")
def _fill_seasonal(spark, sf):
    return _keys(cleaning.fill_seasonal(view(spark, sf, "readings_gappy"), "event_ts", GAPS))


@query("fill_knn", f"""
    SELECT reading_id, {', '.join(r(f'coalesce({c}, {c}_knn, avg({c}) OVER ())', c) for c in GAPS)} FROM (
      SELECT b.*, kp.v AS power_kw_knn, kt.v AS temperature_knn FROM readings_gappy b
      LEFT JOIN (SELECT q, avg(v) AS v FROM (
          SELECT q.reading_id AS q, d.power_kw AS v, row_number() OVER (
              PARTITION BY q.reading_id ORDER BY abs(q.temperature - d.temperature), d.reading_id) AS k
          FROM readings_gappy q JOIN readings_gappy d ON q.power_kw IS NULL AND q.temperature IS NOT NULL
               AND d.power_kw IS NOT NULL AND d.temperature IS NOT NULL) WHERE k <= 5 GROUP BY q) kp ON kp.q = reading_id
      LEFT JOIN (SELECT q, avg(v) AS v FROM (
          SELECT q.reading_id AS q, d.temperature AS v, row_number() OVER (
              PARTITION BY q.reading_id ORDER BY (q.power_kw - d.power_kw) * (q.power_kw - d.power_kw), d.reading_id) AS k
          FROM readings_gappy q JOIN readings_gappy d ON q.temperature IS NULL AND q.power_kw IS NOT NULL
               AND d.power_kw IS NOT NULL AND d.temperature IS NOT NULL) WHERE k <= 5 GROUP BY q) kt ON kt.q = reading_id)
    """, "readings_gappy")
def _fill_knn(spark, sf):
    return _keys(cleaning.fill_knn(view(spark, sf, "readings_gappy"), "reading_id", GAPS))


@query("fill_mean", f"SELECT reading_id, {', '.join(r(f'coalesce({c}, avg({c}) OVER ())', c) for c in GAPS)} "
                    "FROM readings_gappy", "readings_gappy")
def _fill_mean(spark, sf):
    return _keys(cleaning.fill_mean(view(spark, sf, "readings_gappy"), GAPS))


OUT = ["power_kw", "temperature", "voltage"]
_IQR = "quart AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b" for c in OUT) + " FROM readings)"


def _bounded(low: str, high: str) -> str:
    parts = []
    for c in OUT:
        lo, hi = low.format(c=c), high.format(c=c)
        parts.append(r(f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN avg(CASE WHEN {c} < {lo} OR {c} > {hi} THEN NULL "
                       f"ELSE {c} END) OVER () ELSE {c} END", c))
    return ", ".join(parts)


_IQR_LOW, _IQR_HIGH = "{c}_a - 1.5 * ({c}_b - {c}_a)", "{c}_b + 1.5 * ({c}_b - {c}_a)"


@query("outliers_iqr", f"SELECT reading_id, {_bounded(_IQR_LOW, _IQR_HIGH)} FROM readings, quart", "readings", _IQR)
def _outliers_iqr(spark, sf):
    cleaned, _ = cleaning.outliers_iqr(view(spark, sf, "readings"), OUT)
    return cleaned.select("reading_id", *OUT)


def _outside_sql(c: str) -> str:
    low, high = _IQR_LOW.format(c=c), _IQR_HIGH.format(c=c)
    return f"count(*) FILTER (WHERE {c} < {low} OR {c} > {high})"


@query("outlier_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {big(_outside_sql(c), 'outliers')} FROM readings, quart" for c in OUT),
    "readings", _IQR)
def _outlier_counts(spark, sf):
    _, counts = cleaning.outliers_iqr(view(spark, sf, "readings"), OUT)
    return spark.createDataFrame(list(counts.items()), "column_name string, outliers long")


@query("outliers_zscore", f"""SELECT reading_id, {_bounded('{c}_m - 3.0 * {c}_s', '{c}_m + 3.0 * {c}_s')}
    FROM readings, stats""", "readings", "stats AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in OUT) + " FROM readings)")
def _outliers_zscore(spark, sf):
    cleaned, _ = cleaning.outliers_zscore(view(spark, sf, "readings"), OUT)
    return cleaned.select("reading_id", *OUT)


SMOOTH = ["power_kw", "voltage"]


@query("smooth_mean", f"SELECT reading_id, {', '.join(r(f'avg({c}) OVER ({SERIES} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', c) for c in SMOOTH)} FROM readings",
       "readings")
def _smooth_mean(spark, sf):
    return cleaning.smooth_mean(view(spark, sf, "readings"), BY_DEVICE, SMOOTH).select("reading_id", *SMOOTH)


@query("smooth_ewma", f"""SELECT reading_id, {', '.join(r(
    f"list_reduce(list({c}) OVER ({SERIES} ROWS BETWEEN 60 PRECEDING AND CURRENT ROW), lambda a, x: a * 0.5 + x * 0.5)", c)
    for c in SMOOTH)} FROM readings""", "readings")
def _smooth_ewma(spark, sf):
    return cleaning.smooth_ewma(view(spark, sf, "readings"), BY_DEVICE, SMOOTH, 3).select("reading_id", *SMOOTH)


# Five-point quadratic weights times 35, per position in the window.
SAVGOL_5 = ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3), (-5, 6, 12, 13, 9), (3, -5, -3, 9, 31))


def _savgol_sql(c: str) -> str:
    """Inside the series the middle row of weights, at its ends the fitted ones."""

    def fit(position: int) -> str:
        out = []
        for k, v in enumerate(SAVGOL_5[position]):
            step = k - position
            at = c if step == 0 else (f"lead({c}, {step}) OVER w" if step > 0 else f"lag({c}, {-step}) OVER w")
            out.append(f"{at} * ({v} / 35.0::DOUBLE)")
        return " + ".join(out)

    return (f"CASE WHEN count(*) OVER (PARTITION BY device_id) <= 5 THEN {c} "
            f"WHEN row_number() OVER w = 1 THEN {fit(0)} WHEN row_number() OVER w = 2 THEN {fit(1)} "
            f"WHEN lead(1, 1) OVER w IS NULL THEN {fit(4)} WHEN lead(1, 2) OVER w IS NULL THEN {fit(3)} "
            f"ELSE {fit(2)} END")


@query("smooth_savgol", f"SELECT reading_id, {', '.join(r(_savgol_sql(c), c) for c in SMOOTH)} FROM readings "
                        f"WINDOW w AS ({SERIES})", "readings")
def _smooth_savgol(spark, sf):
    return cleaning.smooth_savgol(view(spark, sf, "readings"), BY_DEVICE, SMOOTH, 5).select("reading_id", *SMOOTH)


@query("drop_incomplete", f"""SELECT reading_id, {r('power_kw', 'power_kw')}, {r('temperature', 'temperature')}
    FROM readings_gappy WHERE power_kw IS NOT NULL AND temperature IS NOT NULL""", "readings_gappy")
def _drop_incomplete(spark, sf):
    return _keys(cleaning.drop_incomplete(view(spark, sf, "readings_gappy")))


@query("incomplete_report", f"""SELECT {big('count(*)', 'rows_in')},
    {big('count(*) FILTER (WHERE power_kw IS NOT NULL AND temperature IS NOT NULL)', 'rows_kept')},
    {big('count(*) FILTER (WHERE power_kw IS NULL OR temperature IS NULL)', 'rows_removed')} FROM readings_gappy""",
       "readings_gappy")
def _incomplete_report(spark, sf):
    return cleaning.incomplete_report(view(spark, sf, "readings_gappy"))


@query("hourly_grid", f"""
    SELECT g.device_id, g.hour_ts, {r('power_kw', 'power_kw')} FROM (
        SELECT device_id, unnest(generate_series(min(date_trunc('hour', event_ts)), max(date_trunc('hour', event_ts)),
               INTERVAL 1 HOUR)) AS hour_ts FROM readings GROUP BY device_id) g
    LEFT JOIN (SELECT device_id, date_trunc('hour', event_ts) AS hour_ts, avg(power_kw) AS power_kw
               FROM readings GROUP BY 1, 2) m ON g.device_id = m.device_id AND g.hour_ts = m.hour_ts""", "readings")
def _hourly_grid(spark, sf):
    return cleaning.hourly_grid(view(spark, sf, "readings"), ["device_id"], "event_ts", ["power_kw"])


# -- scalar features -------------------------------------------------------------------------

def _cycle(name: str, value: str, period: int) -> str:
    angle = f"{value} * (2 * pi() / {period})"
    return f"{r(f'sin({angle})', name + '_sin')}, {r(f'cos({angle})', name + '_cos')}"


_DOW = "(isodow(event_ts) - 1)"
_TIME_SQL = f"""{_cycle('hour', 'hour(event_ts)', 24)}, {_cycle('day_of_week', _DOW, 7)},
    {_cycle('month', 'month(event_ts)', 12)}, {r('(dayofyear(event_ts) - 1) / 365', 'day_of_year')},
    CAST({_DOW} >= 5 AS INTEGER) AS is_weekend, CAST(hour(event_ts) BETWEEN 6 AND 18 AS INTEGER) AS is_daytime,
    CAST(hour(event_ts) BETWEEN 10 AND 15 AS INTEGER) AS is_peak_solar,
    CAST(hour(event_ts) BETWEEN 18 AND 22 AS INTEGER) AS is_peak_consumption"""


@query("time_features", f"SELECT reading_id, {_TIME_SQL} FROM readings", "readings")
def _time_features(spark, sf):
    return features.time_features(view(spark, sf, "readings").select("reading_id", "event_ts"), "event_ts").drop("event_ts")


_WIND = "pow(wind_speed * 3.6, 0.16)"
_SKY_SQL = """CAST(regexp_matches(lower(description), 'clear|sunny') AS INTEGER) AS is_clear,
    CAST(regexp_matches(lower(description), 'cloud') AS INTEGER) AS is_cloudy,
    CAST(regexp_matches(lower(description), 'rain|drizzle') AS INTEGER) AS is_rainy"""


@query("weather_features", f"""
    SELECT reading_id, {r('1 - cloud_cover / 100 * 0.75', 'clear_sky_index')},
        {r('(1 - cloud_cover / 100 * 0.75) * 1000', 'estimated_irradiance')},
        {r('temperature + (5.0 / 9) * (humidity / 100 * (6.112 * exp(17.67 * temperature / (temperature + 243.5)))) - 10', 'heat_index')},
        {r(f'13.12 + 0.6215 * temperature - 11.37 * {_WIND} + 0.3965 * temperature * {_WIND}', 'wind_chill')},
        {_SKY_SQL} FROM readings""", "readings")
def _weather_features(spark, sf):
    made = features.weather_features(view(spark, sf, "readings"))
    return made.select("reading_id", "clear_sky_index", "estimated_irradiance", "heat_index", "wind_chill",
                       "is_clear", "is_cloudy", "is_rainy")


@query("sky_flags", f"SELECT reading_id, {_SKY_SQL} FROM readings", "readings")
def _sky_flags(spark, sf):
    return features.sky_flags(view(spark, sf, "readings").select("reading_id", "description")).drop("description")


@query("system_features", f"""
    SELECT reading_id, {r('1 - panel_age_years * 0.007', 'panel_degradation_factor')},
        {r('capacity_kw * (1 - panel_age_years * 0.007)', 'theoretical_max_power')},
        {r('panel_age_years', 'system_panel_age_years')}, {r('capacity_kw', 'system_panel_capacity_kw')},
        {r('panel_efficiency', 'system_panel_efficiency')}
    FROM readings JOIN device_registry USING (device_id)""", "readings device_registry")
def _system_features(spark, sf):
    df = view(spark, sf, "readings").select("reading_id", "device_id").join(
        view(spark, sf, "device_registry").withColumnsRenamed(
            {"panel_age_years": "_age", "capacity_kw": "_cap", "panel_efficiency": "_eff"}), "device_id")
    made = features.system_features(df, {
        "panel_age_years": F.col("_age"), "panel_capacity_kw": F.col("_cap"), "panel_efficiency": F.col("_eff")})
    return made.select("reading_id", "panel_degradation_factor", "theoretical_max_power", "system_panel_age_years",
                       "system_panel_capacity_kw", "system_panel_efficiency")


@query("interaction_features", f"""
    SELECT reading_id, {r('temperature * sin(hour(event_ts) * (2 * pi() / 24))', 'temp_hour_interaction')},
        {r('ghi * 0.18', 'expected_generation_interaction')}, {r('temperature * temperature', 'temperature_squared')}
    FROM irradiance""", "irradiance")
def _interaction_features(spark, sf):
    df = view(spark, sf, "irradiance").withColumnRenamed("ghi", "irradiance")
    df = features.system_features(features.time_features(df, "event_ts"), {"panel_efficiency": 0.18})
    return features.interaction_features(df).select(
        "reading_id", "temp_hour_interaction", "expected_generation_interaction", "temperature_squared")


_POTENTIAL = ("greatest(0.0, sin((hour(event_ts) - 6) * (pi() / 12))) * (1 - cloud_cover / 100 * 0.9) "
              "* (0.7 + abs(sin(dayofyear(event_ts) * (2 * pi()) / 365)) * 0.3) * 1000")


@query("solar_potential", f"SELECT reading_id, {r(f'greatest(0.0, {_POTENTIAL})', 'solar_potential')} FROM readings",
       "readings")
def _solar_potential(spark, sf):
    return view(spark, sf, "readings").select(
        "reading_id", solar.solar_potential(F.col("event_ts"), F.col("cloud_cover")).alias("solar_potential"))


@query("power_from_ghi", f"SELECT reading_id, {r('least(5.0, greatest(0.0, ghi / 1000 * 5.0 * 0.85))', 'power_kw')} "
                         "FROM irradiance", "irradiance")
def _power_from_ghi(spark, sf):
    return view(spark, sf, "irradiance").select(
        "reading_id", solar.power_from_ghi(F.col("ghi"), 5.0).alias("power_kw"))


@query("solar_position", f"""
    SELECT reading_id, {r('dec', 'declination')}, {r('ha', 'hour_angle')}, {r('el', 'elevation')},
           {r('ha + 180', 'azimuth')}, {r('sin(radians(el)) * 1000', 'clear_irradiance')}
    FROM (SELECT *, greatest(0.0, degrees(asin(sin(radians(latitude)) * sin(radians(dec))
                 + cos(radians(latitude)) * cos(radians(dec)) * cos(radians(ha))))) AS el
          FROM (SELECT reading_id, latitude, sin(radians((dayofyear(event_ts) + 284) * (360.0::DOUBLE / 365))) * 23.45 AS dec,
                       (hour(event_ts) + minute(event_ts) / 60 - 12) * 15 AS ha
                FROM readings JOIN device_registry USING (device_id)))""", "readings device_registry")
def _solar_position(spark, sf):
    df = view(spark, sf, "readings").join(
        view(spark, sf, "device_registry").select("device_id", "latitude"), "device_id")
    return features.solar_position(df, "event_ts", "latitude").select(
        "reading_id", "declination", "hour_angle", "elevation", "azimuth", "clear_irradiance")


@query("electrical_features", f"""
    SELECT reading_id, {r('power_kw * 1000', 'power_w')},
        {r('CASE WHEN power_kw > 0 AND voltage > 0 THEN power_kw * 1000 / voltage ELSE 0 END', 'current')},
        CASE WHEN power_kw > 0.01 THEN 'producing' ELSE 'idle' END AS status FROM readings""", "readings")
def _electrical(spark, sf):
    return features.electrical_features(view(spark, sf, "readings")).select("reading_id", "power_w", "current", "status")


@query("assemble_features", f"""
    SELECT device_id, reading_id, {r('temperature', 'temperature')}, {r('ghi', 'ghi')},
        TIMESTAMP '2023-01-01' + to_hours(row_number() OVER ({SERIES}) - 1) AS timestamp FROM irradiance""", "irradiance")
def _assemble(spark, sf):
    return features.assemble_features(view(spark, sf, "irradiance"),
                                      ["reading_id", "temperature", "ghi", "precipitable_water"], BY_DEVICE)


@query("haversine_km", f"""
    SELECT device_id, {r('''2 * 6371 * asin(sqrt(pow(sin(radians(12.97 - latitude) / 2), 2)
        + cos(radians(latitude)) * cos(radians(12.97)) * pow(sin(radians(77.59 - longitude) / 2), 2)))''', 'km')}
    FROM device_registry""", "device_registry")
def _haversine(spark, sf):
    return view(spark, sf, "device_registry").select("device_id", haversine_km(
        F.col("latitude"), F.col("longitude"), F.lit(12.97), F.lit(77.59)).alias("km"))


@query("planar_km", f"""SELECT device_id,
    {r('sqrt(pow(12.97 - latitude, 2) + pow(77.59 - longitude, 2)) * 111', 'km')} FROM device_registry""", "device_registry")
def _planar(spark, sf):
    return view(spark, sf, "device_registry").select("device_id", planar_km(
        F.col("latitude"), F.col("longitude"), F.lit(12.97), F.lit(77.59)).alias("km"))


# -- windows ---------------------------------------------------------------------------------

# The readings of the even and of the odd devices as one series each: long enough for every lag and window.
LAGS, SIZES = features.LAGS, features.ROLLING


@query("lag_features", f"""SELECT reading_id, {', '.join(
    r(f'lag({c}, {n}) OVER ({SERIES})', f'{c}_lag_{n}h') for c in ('power_kw', 'temperature') for n in LAGS)}
    FROM side_readings""", "side_readings")
def _lag_features(spark, sf):
    made = features.lag_features(view(spark, sf, "side_readings"), BY_DEVICE, ["power_kw", "temperature"], LAGS)
    return made.select("reading_id", *[c for c in made.columns if "_lag_" in c])


def _rolling_sql(c: str, source: str = "") -> str:
    return ", ".join(r(f"{f}({source or c}) OVER ({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)",
                       f"{c}_rolling_{name}_{n}h")
                     for n in SIZES for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))


@query("rolling_features", f"SELECT reading_id, {_rolling_sql('power_kw')} FROM side_readings", "side_readings")
def _rolling_features(spark, sf):
    made = features.rolling_features(view(spark, sf, "side_readings"), BY_DEVICE, ["power_kw"], SIZES)
    return made.select("reading_id", *[c for c in made.columns if "_rolling_" in c])


@query("sequences", f"""
    SELECT reading_id, {r('list_sum(back)', 'window_sum')}, {big('len(back)', 'window_rows')},
           {r('ahead[1]', 'first_label')}, {r('ahead[12]', 'last_label')}
    FROM (SELECT reading_id, list(power_kw) OVER ({SERIES} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS back,
                 list(power_kw) OVER ({SERIES} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS ahead FROM readings)
    WHERE len(back) = 24 AND len(ahead) = 12""", "readings")
def _sequences(spark, sf):
    made = features.sequences(view(spark, sf, "readings"), BY_DEVICE, ["power_kw"], "power_kw", 24, 12)
    total = F.aggregate("window", F.lit(0.0), lambda acc, x: acc + x[0])
    return made.select("reading_id", total.alias("window_sum"), F.size("window").cast("long").alias("window_rows"),
                       F.col("label")[0].alias("first_label"), F.col("label")[11].alias("last_label"))


# -- scaling and pipelines -------------------------------------------------------------------

SCALE = ["power_kw", "temperature", "voltage"]
_CENTRE = {"standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"),
           "robust": ("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")}


def _scale_query(method: str) -> None:
    centre, scale = _CENTRE[method]
    stats = ", ".join(f"{centre.format(c=c)} AS {c}_c, {scale.format(c=c)} AS {c}_s" for c in SCALE)
    sql = ", ".join(r(f"({c} - {c}_c) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END", c) for c in SCALE)

    name = "scale_features" if method == "standard" else f"scale_features_{method}"

    @query(name, f"SELECT reading_id, {sql} FROM readings, stats", "readings",
           f"stats AS (SELECT {stats} FROM readings)")
    def _run(spark, sf):
        df = view(spark, sf, "readings").select("reading_id", *SCALE)
        return scaling.Scaler.fit(df, SCALE, method).transform(df)


for _method in _CENTRE:
    _scale_query(_method)


def _pipeline_sql(columns: list[str], lags: dict[str, tuple], smooth: bool) -> str:
    """The steps after filling as a chain of CTEs ending in ``ready``."""
    quart = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b" for c in columns)
    bounded = []
    for c in columns:
        out = f"({c} < {_IQR_LOW.format(c=c)} OR {c} > {_IQR_HIGH.format(c=c)})"
        bounded.append(f"CASE WHEN {out} THEN avg(CASE WHEN {out} THEN NULL ELSE {c} END) OVER () ELSE {c} END AS {c}")
    smoothed = ", ".join(
        f"avg({c}) OVER ({SERIES} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS {c}" if smooth else c for c in columns)
    lagged = ", ".join(f"lag({c}, {n}) OVER ({SERIES}) AS {c}_lag_{n}h" for c, ns in lags.items() for n in ns)
    rolled = ", ".join(
        f"{f}(power_kw) OVER ({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS power_kw_rolling_{name}_{n}h"
        for n in PIPE_SIZES for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))
    return f"""q AS (SELECT {quart} FROM filled),
      bounded AS (SELECT reading_id, device_id, event_ts, {', '.join(bounded)} FROM filled, q),
      smoothed AS (SELECT reading_id, device_id, event_ts, {smoothed} FROM bounded),
      history AS (SELECT *, {lagged}, {rolled} FROM smoothed),
      ready AS (SELECT * FROM history WHERE {' AND '.join(f'{c}_lag_{n}h IS NOT NULL' for c, ns in lags.items() for n in ns)})"""


PIPE_SIZES, PIPE_LAGS, USE_LAGS = features.ROLLING, features.LAGS, features.CONSUMPTION_LAGS
PIPE = ["power_kw", "temperature"]
_SHOWN = ["power_kw", "temperature", "power_kw_lag_24h", "power_kw_rolling_mean_24h", "power_kw_rolling_std_6h"]


def _scaled_sql(columns: list[str]) -> str:
    return ", ".join(r(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)", c) for c in columns)


_HOUR_SIN = "sin(hour(event_ts) * (2 * pi() / 24))"


@query("solar_pipeline", f"""
    SELECT reading_id, {_scaled_sql(_SHOWN)},
        {r(f'({_HOUR_SIN} - avg({_HOUR_SIN}) OVER ()) / stddev_pop({_HOUR_SIN}) OVER ()', 'hour_sin')},
        {r('(temperature * temperature - avg(temperature * temperature) OVER ()) / stddev_pop(temperature * temperature) OVER ()', 'temperature_squared')},
        {r('0', 'system_panel_capacity_kw')} FROM ready""", "side_gappy",
       f"""{_NUMBERED.replace('readings_gappy', 'side_gappy')}, {_NEAR}, filled AS (SELECT reading_id, device_id, event_ts,
           {', '.join(f'{_linear_sql(c)} AS {c}' for c in PIPE)} FROM near),
           {_pipeline_sql(PIPE, {'power_kw': PIPE_LAGS, 'temperature': PIPE_LAGS}, True)}""")
def _solar_pipeline(spark, sf):
    made, _ = pipelines.solar_pipeline(view(spark, sf, "side_gappy"), BY_DEVICE, 5.0, columns=PIPE)
    return made.select("reading_id", *_SHOWN, "hour_sin", "temperature_squared", "system_panel_capacity_kw")


@query("consumption_pipeline", f"SELECT reading_id, {_scaled_sql([*_SHOWN, 'power_kw_lag_720h'])} FROM ready",
       "side_gappy", f"""filled AS (SELECT reading_id, device_id, event_ts, {', '.join(
           f'coalesce({c}, avg({c}) OVER (PARTITION BY hour(event_ts), isodow(event_ts))) AS {c}' for c in PIPE)}
           FROM side_gappy), {_pipeline_sql(PIPE, {'power_kw': USE_LAGS}, False)}""")
def _consumption_pipeline(spark, sf):
    made, _ = pipelines.consumption_pipeline(view(spark, sf, "side_gappy"), BY_DEVICE, columns=PIPE)
    return made.select("reading_id", *_SHOWN, "power_kw_lag_720h")
