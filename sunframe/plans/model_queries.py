"""Queries over models and forecasts. Training runs with few trees here; defaults follow the operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import solar
from ..operators import cleaning, features, forecasting, isolation, models
from ..operators.series import SeriesOrder
from ..session import materialize, scratch_dir
from .registry import big, query, r

#: Boosting goes one tree after the other, about a second each here; the operators default to the full numbers.
TREES = 5
SOLAR_IN = ["ghi", "dni", "dhi", "temperature", "cloud_type", "zenith_angle"]
DEMAND_IN = ["temperature", "humidity", "hour_sin", "hour_cos", "day_of_week_sin", "is_weekend"]

# What a model's registered query returns is one row of checks on rows that it was not trained on; the SQL twin finds
# the same rows by the same rule, and knows what must hold.


def _is_test(key: str) -> str:
    """The SQL twin of ``split_train_test``."""
    return f"substr(md5(concat({key}, '|42')), 1, 8) < '33333333'"


def _checked(scored, train, label: str, low: float = 0.0, high: float = math.inf):
    """Rows, mean label, and whether predictions keep their bounds and beat the mean of the training rows."""
    y, p = F.col(label).cast("double"), F.col("prediction")
    mean = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    inside = p.between(low, high) if high < math.inf else p >= low
    return scored.withColumn("_mean", mean).agg(
        F.count("*").alias("rows"), F.avg(y).alias("label_mean"), F.bool_and(inside).alias("within_bounds"),
        (F.avg((y - p) * (y - p)) < F.avg((y - F.col("_mean")) * (y - F.col("_mean")))).alias("beats_mean"))


def _checks(source: str, key: str, label: str) -> str:
    return f"""SELECT {big('count(*)', 'rows')}, {r(f'avg({label})', 'label_mean')}, true AS within_bounds, true AS beats_mean
    FROM {source} WHERE {_is_test(key)}"""


def _classed(scored, label: str):
    """Rows, mean label, and whether the classes beat the most frequent one and probabilities are such."""
    share = F.avg((F.col("predicted_class") == F.col(label)).cast("double"))
    return scored.agg(F.count("*").alias("rows"), F.avg(F.col(label).cast("double")).alias("label_mean"), share.alias("_right"),
                      F.array_max(F.array(*[F.avg((F.col(label) == k).cast("double")) for k in range(3)])).alias("_most"),
                      F.bool_and(F.col("probability").between(0, 1) & F.col("probability_1").between(0, 1)).alias("within_bounds")
                      ).select("rows", "label_mean", "within_bounds", (F.col("_right") > F.col("_most")).alias("beats_mean"))


_POWER = "least(greatest(ghi / 1000 * 5 * 0.85, 0), 5)"
_LOAD = "power_kw / 10 + temperature / 10 + CASE WHEN hour(event_ts) BETWEEN 18 AND 22 THEN 2 ELSE 0 END"


def _solar(spark, sf):
    df = view(spark, sf, "irradiance")
    return models.split_train_test(df.withColumn("power_kw", solar.power_from_ghi(F.col("ghi"), 5.0)), ["reading_id"])


def _demand(spark, sf):
    """A load that follows heat and evenings."""
    made = features.time_features(view(spark, sf, "readings"), "event_ts")
    return models.split_train_test(made.withColumn("load_kw", F.expr(_LOAD)), ["reading_id"])


def _train(df):
    return df.where(~F.col("is_test"))


def _test(df):
    return df.where("is_test")


@query("solar_gbt", _checks("irradiance", "reading_id", _POWER), "irradiance")
def _solar_gbt(spark, sf):
    df = _solar(spark, sf)
    model = models.solar_gbt(_train(df), SOLAR_IN, "power_kw", TREES)
    return _checked(models.predict(model, _test(df), high=5.0), _train(df), "power_kw", 0.0, 5.0)


@query("demand_gbt", _checks("readings", "reading_id", _LOAD), "readings")
def _demand_gbt(spark, sf):
    df = _demand(spark, sf)
    model = models.demand_gbt(_train(df), DEMAND_IN, "load_kw", TREES)
    return _checked(models.predict(model, _test(df)), _train(df), "load_kw")


@query("demand_forest", f"""SELECT t.*, {big(str(len(DEMAND_IN)), 'features')}, {r('1', 'importance')}, 'temperature' AS first_feature
    FROM ({_checks('readings', 'reading_id', _LOAD)}) t""", "readings")
def _demand_forest(spark, sf):
    df = _demand(spark, sf)
    model = models.demand_forest(_train(df), DEMAND_IN, "load_kw", TREES)
    ranked = models.importances(model, df, 20).agg(
        F.count("*").alias("features"), F.sum("importance").alias("importance"),
        F.max_by("feature", "importance").alias("first_feature"))
    return _checked(models.predict(model, _test(df)), _train(df), "load_kw").join(F.broadcast(ranked), F.lit(True))


_PRICE = "least(greatest(6.5 + (1 - supply_kwh / (demand_kwh + 0.1)) * 2 + sin(hour(hour_ts) / 24 * (2 * pi())) * 1.5, 4), 12)"
_HOUR_NUMBER = "epoch_us(hour_ts) // 3600000000"


@query("price_gbt", _checks("hourly_balance", _HOUR_NUMBER, _PRICE), "hourly_balance")
def _price_gbt(spark, sf):
    from ..operators import rules

    df = view(spark, sf, "hourly_balance").withColumn("hour", F.hour("hour_ts"))
    ratio = rules.supply_demand_ratio(F.col("supply_kwh"), F.col("demand_kwh"))
    number = F.floor(F.unix_micros(F.col("hour_ts").cast("timestamp")) / 3_600_000_000)
    df = df.withColumns({"ratio": ratio, "price": rules.price_label(ratio, F.col("hour")), "number": number})
    df = models.split_train_test(df, ["number"])
    model = models.price_gbt(_train(df), ["supply_kwh", "demand_kwh", "ratio", "hour"], "price", TREES)
    return _checked(models.predict(model, _test(df), *models.PRICE_BOUNDS), _train(df), "price", *models.PRICE_BOUNDS)


_RISK_SCORE = "(800 - (financial_score * 2 + 600)) / 200 * 0.6 + (0.2 - roi_expectation / 100) / 0.2 * 0.4"


@query("risk_forest", _checks("investors", "investor_id",
                              f"CASE WHEN {_RISK_SCORE} <= 0.2 THEN 0 WHEN {_RISK_SCORE} <= 0.6 THEN 1 ELSE 2 END"), "investors")
def _risk_forest(spark, sf):
    from ..operators import rules

    df = view(spark, sf, "investors").withColumns({
        "credit_score": F.col("financial_score") * 2 + 600, "roi_estimate": F.col("roi_expectation") / 100})
    df = models.split_train_test(df.withColumn("label", rules.risk_label(F.col("credit_score"), F.col("roi_estimate"))), ["investor_id"])
    model = models.risk_forest(_train(df), ["credit_score", "roi_estimate", "available_balance"], "label", TREES)
    return _classed(models.predict_class(model, _test(df)), "label")


@query("failure_forest", _checks("readings", "reading_id", """CASE WHEN power_factor * 0.4 + (temperature - 30) / 15 * 0.3
    + CAST(reading_id % 60 AS DOUBLE) / 60 * 0.3 > 0.7 THEN 1 ELSE 0 END"""), "readings")
def _failure_forest(spark, sf):
    from ..operators import rules

    df = view(spark, sf, "readings").withColumn("age_months", (F.col("reading_id") % 60).cast("double"))
    df = df.withColumn("label", rules.failure_label(F.col("power_factor"), F.col("temperature"), F.col("age_months")))
    df = models.split_train_test(df, ["reading_id"])
    model = models.failure_forest(_train(df), ["power_factor", "temperature", "age_months"], "label", TREES)
    return _classed(models.predict_class(model, _test(df)), "label")


ANOMALY_IN = ["power_kw", "voltage", "current_a", "frequency", "power_factor"]


@query("isolation_forest", f"""SELECT {big('count(*)', 'rows')}, true AS about_one_in_twenty, true AS highest_scores, true AS within_bounds
    FROM readings""", "readings")
def _isolation(spark, sf):
    df = view(spark, sf, "readings").select("reading_id", "device_id", *ANOMALY_IN)
    made = models.anomaly_report(df, "reading_id", ANOMALY_IN)
    flagged = F.col("is_anomaly") == 1
    return made.agg(
        F.count("*").alias("rows"), F.avg("is_anomaly").between(0.04, 0.0501).alias("about_one_in_twenty"),
        (F.min(F.when(flagged, F.col("anomaly_score"))) > F.max(F.when(~flagged, F.col("anomaly_score")))).alias("highest_scores"),
        F.bool_and(F.col("normal_score").between(0, 1) & F.col("anomaly_score").between(0, 1)).alias("within_bounds"))


@query("outliers_isolation", f"""SELECT {big('count(*)', 'rows')}, true AS about_one_in_twenty, true AS only_readings FROM readings""", "readings")
def _outliers_isolation(spark, sf):
    df = view(spark, sf, "readings").select("reading_id", *ANOMALY_IN)
    forest = isolation.IsolationForest.fit(df, "reading_id", ANOMALY_IN)
    kept = isolation.drop_anomalies(materialize(forest.score(df), "scores"))
    told = kept.select("reading_id", F.lit(1).alias("kept"))
    return df.join(told, "reading_id", "left").agg(
        F.count("*").alias("rows"), (F.count("kept") / F.count("*")).between(0.9499, 0.96).alias("about_one_in_twenty"),
        (F.sum("kept") == kept.agg(F.count("*")).scalar()).alias("only_readings"))


@query("seasonal_forecast", f"""SELECT device_id, {big('48', 'hours')}, date_trunc('hour', max(event_ts)) + INTERVAL 1 HOUR AS first_hour,
    date_trunc('hour', max(event_ts)) + INTERVAL 48 HOUR AS last_hour, true AS in_its_band
    FROM readings WHERE power_kw IS NOT NULL GROUP BY device_id HAVING count(*) > 48""", "readings")
def _seasonal(spark, sf):
    made = forecasting.seasonal_forecast(view(spark, sf, "readings"), ["device_id"], "event_ts", "power_kw", 48)
    return made.groupBy("device_id").agg(
        F.count("*").alias("hours"), F.min("hour_ts").alias("first_hour"), F.max("hour_ts").alias("last_hour"),
        F.bool_and((F.col("lower") >= 0) & (F.col("lower") <= F.col("prediction")) & (F.col("prediction") <= F.col("upper"))).alias("in_its_band"))


_ORIGINS_SQL = """spans AS (SELECT device_id % 2 AS side, date_trunc('hour', min(event_ts)) AS lo, date_trunc('hour', max(event_ts)) AS hi
    FROM readings GROUP BY 1),
    hours AS (SELECT side, lo + to_hours(CAST(i AS INTEGER)) AS hour_ts, i, date_diff('hour', lo, hi) AS n FROM spans,
              unnest(generate_series(0, date_diff('hour', lo, hi))) u(i)),
    origins AS (SELECT side, epoch_us(hour_ts) AS us FROM hours WHERE i >= 167 AND i <= n - 48),
    ends AS (SELECT min(us) AS lo, max(us) AS hi FROM origins)"""


@query("horizon_forecast", f"""SELECT CAST(side AS INTEGER) AS side, {big('count(*) * 48', 'rows')}, true AS beats_last_value, true AS within_bounds
    FROM origins, ends WHERE us >= lo + CAST(floor((hi - lo) * (1 - 0.2::DOUBLE)) AS BIGINT) GROUP BY side""", "readings", _ORIGINS_SQL)
def _horizon(spark, sf):
    """Hourly means of the even and of the odd devices: two series long enough for a week back and two days ahead."""
    sides = view(spark, sf, "readings").withColumn("side", F.pmod("device_id", F.lit(2)).cast("int"))
    grid = cleaning.hourly_grid(sides, ["side"], "event_ts", ["power_kw"])
    order = SeriesOrder(("side",), "hour_ts")
    hours = materialize(cleaning.fill_linear(grid, order, ["power_kw"]), "hourly")
    made = forecasting.horizon_forecast(hours, order, "power_kw", trees=TREES)

    def error(name: str):
        return F.avg((F.col("label") - F.col(name)) * (F.col("label") - F.col(name)))

    return made.groupBy("side").agg(F.count("*").alias("rows"), (error("prediction") < error("last_value")).alias("beats_last_value"),
                                    F.bool_and(F.col("prediction") >= 0).alias("within_bounds"))


_POTENTIAL = ("greatest(0.0, sin((hour(event_ts) - 6) * (pi() / 12))) * (1 - cloud_cover / 100 * 0.9) "
              "* (0.7 + abs(sin(dayofyear(event_ts) * (2 * pi()) / 365)) * 0.3) * 1000")


@query("weather_adjust", f"""SELECT reading_id, {r('greatest(0.0, power_kw * (1 - cloud_cover / 100 * 0.8) * (1 - greatest(0.0, temperature - 25) * 0.004))', 'adjusted')}
    FROM readings""", "readings")
def _weather_adjust(spark, sf):
    df = view(spark, sf, "readings")
    return forecasting.weather_adjust(
        df.select("reading_id", F.col("power_kw").alias("prediction")),
        df.select("reading_id", "cloud_cover", "temperature"), ["reading_id"]).select("reading_id", "adjusted")


_START = "2024-02-01 00:00:00"


@query("solar_forecast_table", f"""
    SELECT device_id, hour_ts, {r('p', 'predicted_kwh')}, {r('greatest(0.0, p * (1 - 0.15))', 'confidence_lower')},
        {r('p * (1 + 0.15)', 'confidence_upper')}, source FROM (
      SELECT device_id, hour_ts, least(capacity_kw, greatest(0.0, coalesce(m, pot / 1000 * capacity_kw, day * capacity_kw))) AS p,
        CASE WHEN m IS NOT NULL THEN 'model' WHEN pot IS NOT NULL THEN 'weather' ELSE 'daylight' END AS source
      FROM (SELECT *, CASE WHEN (device_id + step) % 3 = 0 THEN (step % 10) END AS m,
            CASE WHEN step % 2 = 0 THEN greatest(0.0, day * (1 - (step % 100) / 100 * 0.9)
                 * (0.7 + abs(sin(dayofyear(hour_ts) * (2 * pi()) / 365)) * 0.3) * 1000) END AS pot
        FROM (SELECT device_id, capacity_kw, step, hour_ts, greatest(0.0, sin((hour(hour_ts) - 6) * (pi() / 12))) AS day
          FROM (SELECT device_id, capacity_kw, step, TIMESTAMP '{_START}' + to_hours(step) AS hour_ts
                FROM device_registry, (SELECT unnest(generate_series(0, 47)) AS step)))))""", "device_registry")
def _solar_forecast_table(spark, sf):
    hosts = view(spark, sf, "device_registry")
    start = F.lit(_START).cast("timestamp_ntz")
    grid = forecasting.hours_ahead(hosts.select("device_id"), start, 48)
    model = grid.where((F.col("device_id") + F.col("step")) % 3 == 0).select(
        "device_id", "hour_ts", (F.col("step") % 10).cast("double").alias("prediction"))
    weather = grid.where(F.col("step") % 2 == 0).groupBy("hour_ts").agg((F.max("step") % 100).cast("double").alias("cloud_cover"))
    return forecasting.solar_forecast_table(hosts, "device_id", "capacity_kw", start, 48, model, weather)


@query("baseline_forecast", f"""SELECT device_id, hour_ts, {r('30', 'temperature')}, {r('50', 'humidity')}, {r('50', 'cloud_cover')},
    CAST(hour(hour_ts) AS INTEGER) AS hour, CAST(isodow(hour_ts) - 1 AS INTEGER) AS day_of_week, CAST(month(hour_ts) AS INTEGER) AS month,
    {r('0', 'predicted_kwh')}, {r('0', 'confidence_lower')}, {r('0', 'confidence_upper')}
    FROM (SELECT device_id, TIMESTAMP '{_START}' + to_hours(step) AS hour_ts
          FROM device_registry, (SELECT unnest(generate_series(0, 23)) AS step))""", "device_registry")
def _baseline(spark, sf):
    return forecasting.baseline_forecast(view(spark, sf, "device_registry"), "device_id", F.lit(_START).cast("timestamp_ntz"), 24)


@query("demand_forecast_table", f"""SELECT device_id, {big('24', 'hours')}, date_trunc('hour', max(event_ts) + INTERVAL 1 HOUR) AS first_hour,
    count(power_kw) > 48 AS modelled FROM readings GROUP BY device_id""", "readings")
def _demand_table(spark, sf):
    df = view(spark, sf, "readings")
    fitted = forecasting.seasonal_forecast(df, ["device_id"], "event_ts", "power_kw", 24)
    made = forecasting.demand_forecast_table(df, ["device_id"], "event_ts", "power_kw", 24, fitted)
    return made.groupBy("device_id").agg(F.count("*").alias("hours"), F.min("hour_ts").alias("first_hour"),
                                         (F.max("predicted_kwh") > 0).alias("modelled"))


@query("confidence_band", "SELECT reading_id, " + ", ".join(
    f"{r(f'greatest(0.0, power_kw * (1 - {s}))', f'{n}_lower')}, {r(f'power_kw * (1 + {s})', f'{n}_upper')}"
    for n, s in (("post", "0.15"), ("get", "0.2"), ("normal90", "0.2 * 1.645"))) + " FROM readings", "readings")
def _band(spark, sf):
    out = []
    for preset in ("post", "get", "normal90"):
        low, high = solar.band(F.col("power_kw"), preset)
        out += [low.alias(f"{preset}_lower"), high.alias(f"{preset}_upper")]
    return view(spark, sf, "readings").select("reading_id", *out)


_N = "(SELECT count(*) FROM irradiance)"
_FOLDS = f"""SELECT reading_id, CAST(CASE WHEN k < {_N} - 5 * ({_N} // 6) THEN 0
    ELSE (k - ({_N} - 5 * ({_N} // 6))) // ({_N} // 6) + 1 END AS INTEGER) AS fold
    FROM (SELECT reading_id, rank() OVER (ORDER BY event_ts) - 1 AS k FROM irradiance)"""


@query("split_train_test", f"""SELECT {_is_test('reading_id')} AS is_test, {big('count(*)', 'rows')}, {big('count(DISTINCT device_id)', 'devices')},
    {big('sum(reading_id)', 'ids')} FROM readings GROUP BY 1""", "readings")
def _split(spark, sf):
    df = models.split_train_test(view(spark, sf, "readings"), ["reading_id"])
    return df.groupBy("is_test").agg(F.count("*").alias("rows"), F.countDistinct("device_id").alias("devices"),
                                     F.sum("reading_id").alias("ids"))


@query("cross_validate", f"SELECT {big('5', 'folds')}, true AS beats_mean, true AS steady FROM (SELECT count(*) FROM irradiance)", "irradiance")
def _cross_validate(spark, sf):
    df = _solar(spark, sf).select("reading_id", "power_kw", *SOLAR_IN)
    made = models.cross_validate(df, models.gbt(SOLAR_IN, "power_kw", 2, 0.1, 4), ["reading_id"], "power_kw")
    return made.select(F.col("folds").cast("long").alias("folds"), (F.col("cv_r2_mean") > 0.5).alias("beats_mean"),
                       (F.col("cv_r2_std") < 0.05).alias("steady"))


@query("time_series_cv", f"""SELECT fold, {big('count(*)', 'rows')}, true AS beats_mean FROM ({_FOLDS}) WHERE fold > 0 GROUP BY fold""", "irradiance")
def _ts_cv(spark, sf):
    df = _solar(spark, sf).select("event_ts", "power_kw", *SOLAR_IN)
    made = models.time_series_cv(df, models.gbt(SOLAR_IN, "power_kw", 2, 0.1, 4), "event_ts", "power_kw")
    spread = models.time_folds(df, "event_ts").groupBy("fold").agg(F.stddev_pop("power_kw").alias("spread"))
    return made.join(spread, "fold").select("fold", "rows", (F.col("rmse") < F.col("spread")).alias("beats_mean"))


@query("time_folds", _FOLDS, "irradiance")
def _time_folds(spark, sf):
    return models.time_folds(view(spark, sf, "irradiance"), "event_ts").select("reading_id", "fold")


_TRAINED = [*[(m, k) for m in ("solar_gbt:nsrdb", "demand_gbt:meter") for k in ("mae", "rmse", "mape", "r2")],
            ("risk_forest:meter", "accuracy"), ("risk_forest:meter", "auc_roc"),
            ("isolation_forest:meter", "anomalies_detected"), ("isolation_forest:meter", "contamination")]


@query("train_all", f"""SELECT model_name, metric, true AS measured, true AS sound
    FROM (VALUES {', '.join(map(str, _TRAINED))}) v(model_name, metric) WHERE EXISTS (FROM readings)""", "readings")
def _train_all(spark, sf):
    when = F.col("event_ts")
    calendar = {"Hour_sin": F.sin(F.hour(when) * (2 * math.pi / 24)), "Hour_cos": F.cos(F.hour(when) * (2 * math.pi / 24))}
    sun = view(spark, sf, "irradiance").withColumns(calendar).withColumnsRenamed(
        {"ghi": "GHI", "dni": "DNI", "dhi": "DHI", "temperature": "Temperature"})
    use = view(spark, sf, "readings").withColumns({
        **calendar, "power_factor_deviation": F.abs(F.col("power_factor") - 0.9),
        "risk_label": (F.col("power_factor") < 0.85).cast("int")}).withColumnsRenamed(
        {"temperature": "Temperature", "humidity": "Humidity", "voltage": "voltage_v", "frequency": "frequency_hz"})
    use = use.withColumn("active_power_kw", F.col("power_kw"))
    made = models.train_all({"nsrdb": sun, "meter": use}, ["reading_id"], 2)
    sound = F.when(F.col("metric").isin("accuracy", "auc_roc"), F.col("value") > 0.6).otherwise(F.col("value") >= -1)
    return made.select("model_name", "metric", (F.col("value").isNotNull() & ~F.isnan("value")).alias("measured"), sound.alias("sound"))


@query("save_load_models", f"""SELECT {big('count(*)', 'rows')}, true AS same FROM irradiance WHERE {_is_test('reading_id')}""", "irradiance")
def _save_load(spark, sf):
    df = _solar(spark, sf)
    path = scratch_dir(spark, "model")
    model = models.solar_gbt(_train(df), SOLAR_IN, "power_kw", 2)
    models.save_model(model, path)
    first = models.predict(model, _test(df)).select("reading_id", F.col("prediction").alias("before"))
    again = models.predict(models.load_model(path), _test(df)).select("reading_id", "prediction")
    return first.join(again, "reading_id").agg(F.count("*").alias("rows"), F.bool_and(F.col("before") == F.col("prediction")).alias("same"))
