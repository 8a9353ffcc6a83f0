"""Queries over business rules and model evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import cleaning, evaluation, models, rules
from .registry import big, query, r

_RATIO = "supply_kwh / (demand_kwh + 0.1)"


@query("trading_hours", f"""SELECT hour_ts, {r(_RATIO, 'supply_demand_ratio')},
    {r(f'CASE WHEN {_RATIO} < 0.5 THEN 1.5 WHEN {_RATIO} > 2 THEN 0.7 ELSE 1.0 END', 'price_multiplier')},
    CAST({_RATIO} BETWEEN 0.8 AND 1.2 AS INTEGER) AS is_optimal FROM hourly_balance""", "hourly_balance")
def _trading_hours(spark, sf):
    return rules.trading_hours(view(spark, sf, "hourly_balance"), "supply_kwh", "demand_kwh").select(
        "hour_ts", "supply_demand_ratio", "price_multiplier", "is_optimal")


_MODEL_PRICE = ("CASE WHEN hour(hour_ts) % 3 = 0 THEN NULL ELSE "
                "least(12.0, greatest(4.0, 6 + supply_kwh / (demand_kwh + 0.1))) END")
_PRICE = f"coalesce({_MODEL_PRICE}, 6.5)"


@query("price_quote", f"""SELECT hour_ts, {r(_PRICE, 'recommended_price')},
    {r(f'greatest(4.0, {_PRICE} * 0.9)', 'price_min')}, {r(f'least(12.0, {_PRICE} * 1.1)', 'price_max')},
    {r(_RATIO, 'supply_demand_ratio')}, [9, 10, 11, 12, 13, 14, 15, 16] AS optimal_trading_hours FROM hourly_balance""",
       "hourly_balance")
def _price_quote(spark, sf):
    ratio = F.col("supply_kwh") / (F.col("demand_kwh") + 0.1)
    df = view(spark, sf, "hourly_balance").withColumns({
        "tariff": F.lit(6.5), "model_price": F.when(F.hour("hour_ts") % 3 != 0, F.least(
            F.lit(12.0), F.greatest(F.lit(4.0), ratio + 6)))})
    return rules.price_quote(df, "supply_kwh", "demand_kwh", "tariff", "model_price").select(
        "hour_ts", "recommended_price", "price_min", "price_max", "supply_demand_ratio", "optimal_trading_hours")


@query("energy_summary", f"""SELECT device_id, CAST(event_ts AS DATE) AS day, {big('count(*)', 'readings')},
    {r('sum(power_kw) * 0.25', 'energy_kwh')}, {r('max(power_kw)', 'peak_kw')}, {r('avg(power_kw)', 'mean_kw')},
    {r('count(*) FILTER (WHERE power_kw > 0.01) * 0.25', 'producing_hours')} FROM readings GROUP BY 1, 2""", "readings")
def _energy_summary(spark, sf):
    return rules.energy_summary(view(spark, sf, "readings"), [
        "device_id", F.to_date("event_ts").alias("day")], "power_kw", 0.25)


DESCRIBED = ["power_kw", "temperature", "voltage", "cloud_cover"]


@query("describe_features", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'double' AS type, {big(f'count({c})', 'count')}, {r(f'avg({c})', 'mean')}, "
    f"{r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'min')}, {r(f'quantile_cont({c}, 0.25)', 'p25')}, "
    f"{r(f'quantile_cont({c}, 0.5)', 'p50')}, {r(f'quantile_cont({c}, 0.75)', 'p75')}, {r(f'max({c})', 'max')} FROM readings"
    for c in DESCRIBED), "readings")
def _describe(spark, sf):
    return evaluation.describe_features(view(spark, sf, "readings"), DESCRIBED)


_OUT = "count(*) FILTER (WHERE voltage < 200 OR voltage > 260)"


@query("voltage_anomaly", f"""SELECT device_id, {big(_OUT, 'out_of_range')}, {big('count(*)', 'readings')},
    {r(f'{_OUT} / count(*) * 100', 'percentage')},
    CASE WHEN {_OUT} / count(*) * 100 > 10 THEN 'high' WHEN {_OUT} / count(*) * 100 > 5 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN {_OUT} / count(*) * 100 > 10 THEN 'CRITICAL: Frequent voltage anomalies'
         WHEN {_OUT} / count(*) * 100 > 5 THEN 'WARNING: Some voltage anomalies detected'
         ELSE 'OK: Voltage within acceptable range' END AS status FROM readings GROUP BY device_id""", "readings")
def _voltage_anomaly(spark, sf):
    return rules.voltage_anomaly(view(spark, sf, "readings"), ["device_id"])


@query("anomaly_severity", f"""SELECT device_id, {big('n', 'anomalies_detected')},
    CASE WHEN n > 10 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN n > 0 THEN ['voltage_fluctuation', 'efficiency_drop'] ELSE CAST([] AS VARCHAR[]) END AS anomaly_types,
    CASE WHEN n > 5 THEN 'Schedule maintenance check' ELSE 'Continue monitoring' END AS recommended_action
    FROM (SELECT device_id, sum(CASE WHEN voltage > 255 AND power_kw > 1 THEN 1 ELSE 0 END) AS n
          FROM readings GROUP BY device_id)""", "readings")
def _anomaly_severity(spark, sf):
    flagged = view(spark, sf, "readings").withColumn(
        "is_anomaly", ((F.col("voltage") > 255) & (F.col("power_kw") > 1)).cast("int"))
    return rules.anomaly_severity(flagged, ["device_id"])


_CLASS = "coalesce(k, 1)"


@query("risk_report", f"""SELECT investor_id, {big(f'{_CLASS} * 50', 'risk_score')},
    CASE {_CLASS} WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unknown' END AS risk_category,
    {r('coalesce(p, 0.5)', 'risk_probability')}, {r(f'greatest(5.0, 15 - {_CLASS} * 50 * 0.1)', 'expected_roi_percentage')},
    concat('Risk level: ', CASE {_CLASS} WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unknown' END,
        '. Expected ROI: ', printf('%.1f', greatest(5.0, 15 - {_CLASS} * 50 * 0.1)::DOUBLE), '%') AS recommendation
    FROM (SELECT investor_id, CASE WHEN investor_id % 20 <> 0 THEN investor_id % 4 END AS k,
                 CASE WHEN investor_id % 20 <> 0 THEN financial_score / 100 END AS p FROM investors)""", "investors")
def _risk_report(spark, sf):
    known = F.col("investor_id") % 20 != 0
    df = view(spark, sf, "investors").select(
        "investor_id", F.when(known, F.col("investor_id") % 4).alias("k"),
        F.when(known, F.col("financial_score") / 100).alias("p"))
    return rules.risk_report(df, "k", "p").drop("k", "p")


_RISK_RAW = "(800 - (600 + reading_id % 201)) / 200 * 0.6::DOUBLE + (0.2::DOUBLE - temperature / 180) / 0.2::DOUBLE * 0.4::DOUBLE"
_FAIL_RAW = "power_factor * 0.4::DOUBLE + (temperature - 30) / 15 * 0.3::DOUBLE + (reading_id % 60) / 60 * 0.3::DOUBLE"


@query("rule_labels", f"""SELECT reading_id, CASE WHEN {_RISK_RAW} <= 0.2 THEN 0 WHEN {_RISK_RAW} <= 0.6 THEN 1 ELSE 2 END AS risk,
    CAST({_FAIL_RAW} > 0.7 AS INTEGER) AS failure,
    {r("least(12.0, greatest(4.0, 6.5 + (1 - power_kw / (humidity + 0.1)) * 2 + sin(hour(event_ts) / 24 * (2 * pi())) * 1.5))", 'price')}
    FROM readings""", "readings")
def _rule_labels(spark, sf):
    return view(spark, sf, "readings").select(
        "reading_id", rules.risk_label(F.col("reading_id") % 201 + 600, F.col("temperature") / 180).alias("risk"),
        rules.failure_label(F.col("power_factor"), F.col("temperature"), F.col("reading_id") % 60).alias("failure"),
        rules.price_label(F.col("power_kw") / (F.col("humidity") + 0.1), F.hour("event_ts")).alias("price"))


@query("class_distribution", f"""SELECT y_label, {big('count(*)', 'rows')},
    {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM class_predictions GROUP BY y_label""", "class_predictions")
def _class_distribution(spark, sf):
    return rules.class_distribution(view(spark, sf, "class_predictions"), "y_label")


@query("prediction_stats", f"""SELECT model_name, {r('min(y_pred)', 'min')}, {r('max(y_pred)', 'max')}, {r('avg(y_pred)', 'mean')},
    {r('stddev_pop(y_pred)', 'std')}, {big('count(y_pred)', 'rows')},
    {big('count(*) FILTER (WHERE y_pred > 0.01)', 'non_zero')} FROM predictions GROUP BY model_name""", "predictions")
def _prediction_stats(spark, sf):
    return rules.prediction_stats(view(spark, sf, "predictions"), "y_pred", ["model_name"])


@query("profile_seasonality", f"""SELECT CAST(hour(event_ts) AS INTEGER) AS hour, CAST(isodow(event_ts) - 1 AS INTEGER) AS weekday,
    {r('avg(power_kw)', 'power_kw')}, {r('avg(temperature)', 'temperature')} FROM readings_gappy GROUP BY 1, 2""", "readings_gappy")
def _profile(spark, sf):
    return cleaning.seasonal_profile(view(spark, sf, "readings_gappy"), "event_ts", ["power_kw", "temperature"])


_DAILY = """daily AS (SELECT device_id, CAST(event_ts AS DATE) AS day, avg(power_kw / (3 + device_id % 8)) AS efficiency
    FROM readings GROUP BY 1, 2), numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY day) - 1 AS x FROM daily),
    fit AS (SELECT device_id, count(*) AS n, arg_max(efficiency, x) AS latest, regr_slope(efficiency, x) AS slope
            FROM numbered GROUP BY device_id)"""


@query("degradation_trend", f"""SELECT device_id, {big('n', 'days_analyzed')},
    CASE WHEN n >= 30 THEN 'success' ELSE 'insufficient_data' END AS status,
    {r('CASE WHEN n >= 30 THEN latest END', 'current_efficiency')}, {r('CASE WHEN n >= 30 THEN slope END', 'daily_degradation')},
    {r('CASE WHEN n >= 30 THEN CASE WHEN latest > 0 THEN slope * 365 / latest ELSE 0 END END', 'annual_degradation_rate')},
    CASE WHEN n >= 30 THEN CASE WHEN latest > 0 THEN slope * 365 / latest ELSE 0 END < -0.02 END AS is_degrading FROM fit""",
       "readings", _DAILY)
def _degradation(spark, sf):
    daily = view(spark, sf, "readings").groupBy("device_id", F.to_date("event_ts").alias("day")).agg(
        F.avg(F.col("power_kw") / (F.col("device_id") % 8 + 3)).alias("efficiency"))
    return rules.degradation_trend(daily, ["device_id"], "day", "efficiency")


# -- evaluation ------------------------------------------------------------------------------

_REL = "abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)"
_METRICS = f"""metrics AS (SELECT model_name, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse,
    avg({_REL}) AS mape, 1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)) AS r2 FROM predictions GROUP BY model_name)"""


def _metrics(spark, sf):
    return evaluation.regression_metrics(view(spark, sf, "predictions"), ["model_name"])


# The relative error explodes at zero truths, so it is compared on a logarithmic scale.
@query("regression_metrics", f"SELECT model_name, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('ln(mape)', 'log_mape')}, {r('r2', 'r2')} FROM metrics",
       "predictions", _METRICS)
def _regression_metrics(spark, sf):
    return _metrics(spark, sf).withColumn("log_mape", F.log("mape")).drop("mape")


_RES = "(y_pred - y_true)"


@query("regression_report", f"""SELECT model_name, {big('count(*)', 'n_samples')}, {r(f'avg({_RES} * {_RES})', 'mse')},
    {r(f'sqrt(avg({_RES} * {_RES}))', 'rmse')}, {r(f'avg(abs{_RES})', 'mae')},
    {r(f'1 - avg({_RES} * {_RES}) / var_pop(y_true)', 'r2_score')},
    {r(f'1 - var_pop{_RES} / var_pop(y_true)', 'explained_variance')},
    {r(f'avg({_REL}) FILTER (WHERE y_true <> 0) * 100', 'mape')}, {r('avg(y_true)', 'y_true_mean')},
    {r('stddev_pop(y_true)', 'y_true_std')}, {r('avg(y_pred)', 'y_pred_mean')}, {r('stddev_pop(y_pred)', 'y_pred_std')},
    {r(f'avg{_RES}', 'residual_mean')}, {r(f'stddev_pop{_RES}', 'residual_std')},
    {r(f'quantile_cont(abs{_RES}, 0.5)', 'error_p50')}, {r(f'quantile_cont(abs{_RES}, 0.9)', 'error_p90')},
    {r(f'quantile_cont(abs{_RES}, 0.95)', 'error_p95')}, {r(f'quantile_cont(abs{_RES}, 0.99)', 'error_p99')},
    {r(f'max(abs{_RES})', 'max_error')}, {r(f'sqrt(avg({_RES} * {_RES})) / (max(y_true) - min(y_true))', 'nrmse')},
    {r(f'sqrt(avg({_RES} * {_RES})) / avg(y_true)', 'cv_rmse')} FROM predictions GROUP BY model_name""", "predictions")
def _regression_report(spark, sf):
    return evaluation.regression_report(view(spark, sf, "predictions"), ["model_name"])


@query("peak_metrics", f"""SELECT model_name, {r('max(bar)', 'peak_threshold')}, {big('count(*)', 'peak_rows')},
    {r('avg(abs(y_true - y_pred))', 'peak_mae')}, {r(f'avg({_REL}) * 100', 'peak_mape')}
    FROM predictions JOIN (SELECT model_name, quantile_cont(y_true, 0.75) AS bar FROM predictions GROUP BY 1) USING (model_name)
    WHERE y_true >= bar GROUP BY model_name""", "predictions")
def _peak_metrics(spark, sf):
    return evaluation.peak_metrics(view(spark, sf, "predictions"), ["model_name"])


_PER_CLASS = """per AS (SELECT c, count(*) FILTER (WHERE y_label = c) AS support, count(*) FILTER (WHERE y_hat = c) AS guessed,
    count(*) FILTER (WHERE y_label = c AND y_hat = c) AS hits
    FROM class_predictions, (SELECT DISTINCT y_label AS c FROM class_predictions UNION SELECT y_hat FROM class_predictions) GROUP BY c),
    rates AS (SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS p,
                        CASE WHEN support > 0 THEN hits / support ELSE 0 END AS q FROM per)"""


@query("classification_metrics", f"""SELECT {r('sum(hits) / sum(support)', 'accuracy')}, {r('sum(p * support) / sum(support)', 'precision')},
    {r('sum(q * support) / sum(support)', 'recall')},
    {r('sum(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END * support) / sum(support)', 'f1')} FROM rates""",
       "class_predictions", _PER_CLASS)
def _classification(spark, sf):
    return evaluation.classification_metrics(view(spark, sf, "class_predictions"), "y_label", "y_hat")


@query("confusion_matrix", f"""SELECT CAST(y_label AS INTEGER) AS truth, {', '.join(
    big(f'count(*) FILTER (WHERE y_hat = {c})', f'predicted_{c}') for c in range(3))} FROM class_predictions GROUP BY y_label""",
       "class_predictions")
def _confusion(spark, sf):
    return evaluation.confusion_matrix(view(spark, sf, "class_predictions"), "y_label", "y_hat", [0, 1, 2])


@query("auc_roc", f"""SELECT {r("""(sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2)
    / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos))""", 'auc_roc')} FROM (
    SELECT y_label >= 1 AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk
    FROM class_predictions)""", "class_predictions")
def _auc(spark, sf):
    df = view(spark, sf, "class_predictions").withColumn("pos", (F.col("y_label") >= 1).cast("int"))
    return evaluation.auc_roc(df, "pos", "score")


@query("auc_roc_readings", f"""SELECT {r("""(sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2)
    / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos))""", 'auc_roc')} FROM (
    SELECT y_true > 1 AS pos, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2 AS rk
    FROM predictions)""", "predictions")
def _auc_readings(spark, sf):
    df = view(spark, sf, "predictions").withColumn("pos", (F.col("y_true") > 1).cast("int"))
    return evaluation.auc_roc(df, "pos", "y_pred")


@query("compare_models", f"SELECT model_name, {r('rmse', 'rmse')}, {r('mae', 'mae')}, {r('r2', 'r2')} FROM metrics ORDER BY rmse",
       "predictions", _METRICS)
def _compare(spark, sf):
    return evaluation.compare_models(_metrics(spark, sf)).select("model_name", "rmse", "mae", "r2")


@query("select_best", f"""SELECT 'regression' AS task, arg_min(model_name, rmse) AS model_name, {r('min(rmse)', 'value')} FROM metrics
    UNION ALL SELECT 'classification', arg_max(model_name, r2), {r('max(r2)', 'value')} FROM metrics""", "predictions", _METRICS)
def _select_best(spark, sf):
    m = _metrics(spark, sf)
    low = evaluation.select_best(m, "rmse").select(F.lit("regression").alias("task"), "model_name", F.col("rmse").alias("value"))
    high = evaluation.select_best(m, "r2", higher_is_better=True).select(
        F.lit("classification").alias("task"), "model_name", F.col("r2").alias("value"))
    return low.unionByName(high)


@query("error_by_bin", f"""SELECT g.model_name, CAST(g.bin AS BIGINT) AS bin, {r('lo + w * (g.bin + 0.5)', 'bin_center')},
    {r('coalesce(mae, 0)', 'mae')}, {big('coalesce(n, 0)', 'rows')} FROM (
        SELECT model_name, lo, w, unnest([0, 1, 2, 3, 4]) AS bin FROM ends) g
    LEFT JOIN (SELECT model_name, least(4, floor((y_true - lo) / w)) AS bin, avg(abs(y_pred - y_true)) AS mae, count(*) AS n
        FROM predictions JOIN ends USING (model_name) WHERE y_true < hi GROUP BY 1, 2) f
    ON f.model_name = g.model_name AND f.bin = g.bin""", "predictions",
       "ends AS (SELECT model_name, min(y_true) AS lo, max(y_true) AS hi, (max(y_true) - min(y_true)) / 5 AS w FROM predictions GROUP BY 1)")
def _error_by_bin(spark, sf):
    return evaluation.error_by_bin(view(spark, sf, "predictions"), ["model_name"])


@query("residual_histogram", f"""SELECT model_name, {big('least(29, floor((res - lo) / ((hi - lo) / 30)))', 'bin')}, {big('count(*)', 'rows')},
    {r('min(res)', 'least')}, {r('max(res)', 'most')} FROM (SELECT model_name, y_pred - y_true AS res FROM predictions)
    JOIN (SELECT model_name, min(y_pred - y_true) AS lo, max(y_pred - y_true) AS hi FROM predictions GROUP BY 1) USING (model_name)
    GROUP BY 1, 2""", "predictions")
def _residual_histogram(spark, sf):
    return evaluation.residual_histogram(view(spark, sf, "predictions"), ["model_name"])


_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("residual_quantiles", " UNION ALL ".join(
    f"SELECT model_name, {r(str(p), 'prob')}, {r(f'quantile_cont(y_pred - y_true, {p})', 'value')} FROM predictions GROUP BY model_name"
    for p in _PROBS), "predictions")
def _residual_quantiles(spark, sf):
    return evaluation.residual_quantiles(view(spark, sf, "predictions"), ["model_name"], _PROBS)


@query("score_table", f"""SELECT model_name, {r('r2 * 100', 'r2_points')}, {r('100 - rmse / max(rmse) OVER () * 100', 'rmse_points')},
    {r('100 - mae / max(mae) OVER () * 100', 'mae_points')}, {r('100 - CASE WHEN mape < 100 THEN mape / 100 ELSE 100 END', 'mape_points')},
    CASE WHEN r2 > 0.8 THEN 'Good' WHEN r2 > 0.6 THEN 'Acceptable' ELSE 'Needs Improvement' END AS status,
    CASE WHEN r2 > 0.9 THEN 'Excellent' WHEN r2 > 0.8 THEN 'Good' ELSE 'Acceptable' END AS grade FROM metrics""", "predictions", _METRICS)
def _score_table(spark, sf):
    return evaluation.score_table(_metrics(spark, sf))


@query("refresh_decision", f"""SELECT model_name, {r('o', 'old_mae')}, {r('n', 'new_mae')}, {r('(o - n) / o', 'improvement')},
    CASE WHEN (o - n) / o > 0.05 THEN 'deploy' ELSE 'keep' END AS decision FROM (
    SELECT model_name, avg(abs(y_true - y_pred)) AS o, avg(abs(y_true - (y_pred * 0.75::DOUBLE + y_true * 0.25::DOUBLE))) AS n
    FROM predictions GROUP BY model_name)""", "predictions")
def _refresh(spark, sf):
    df = view(spark, sf, "predictions")
    better = df.withColumn("y_pred", F.col("y_pred") * 0.75 + F.col("y_true") * 0.25)
    return evaluation.refresh_decision(
        evaluation.regression_metrics(df, ["model_name"]), evaluation.regression_metrics(better, ["model_name"]))


_DRIFTING = ["power_kw", "temperature", "voltage"]


@query("drift_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{s}' AS statistic, {r('b', 'baseline')}, {r('n', 'current')},
    {r('abs(n - b) / abs(b)', 'relative_change')}, abs(n - b) / abs(b) > 0.15 AS is_drifting
    FROM (SELECT {f}({c}) FILTER (WHERE event_ts < TIMESTAMP '2024-01-16') AS b,
                 {f}({c} * 1.2::DOUBLE) FILTER (WHERE event_ts >= TIMESTAMP '2024-01-16') AS n FROM readings)"""
    for c in _DRIFTING for s, f in (("mean", "avg"), ("std", "stddev_samp"))), "readings")
def _drift(spark, sf):
    df = view(spark, sf, "readings")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    newer = df.where(F.col("event_ts") >= cut).withColumns({c: F.col(c) * 1.2 for c in _DRIFTING})
    return evaluation.drift_report(df.where(F.col("event_ts") < cut), newer, _DRIFTING)


@query("ensemble", f"""SELECT row_id, {r('CASE WHEN y_pred > 0.5 THEN y_pred END', 'first_prediction')},
    {r('CASE WHEN y_true < 3 THEN y_true END', 'second_prediction')},
    {r('''CASE WHEN y_pred > 0.5 AND y_true < 3 THEN y_pred * 0.6 + y_true * 0.4
          WHEN y_pred > 0.5 THEN y_pred ELSE y_true END''', 'prediction')}
    FROM predictions WHERE y_pred > 0.5 OR y_true < 3""", "predictions")
def _ensemble(spark, sf):
    """One model predicts from half a kilowatt up, the other below three."""
    df = view(spark, sf, "predictions")
    first = df.where(F.col("y_pred") > 0.5).select("row_id", F.col("y_pred").alias("prediction"))
    second = df.where(F.col("y_true") < 3).select("row_id", F.col("y_true").alias("prediction"))
    return models.ensemble(first, second, ["row_id"])
