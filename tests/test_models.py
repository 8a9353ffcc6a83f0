import numpy as np
import pytest
from pyspark.sql import functions as F

from sunframe.fixtures import view
from sunframe.functions import solar
from sunframe.operators import evaluation, forecasting, isolation, models
from sunframe.operators.series import SeriesOrder
from sunframe.session import materialize

IN = ["ghi", "dni", "dhi", "temperature", "cloud_type", "zenith_angle"]


def test_solar_model_orders_night_cloud_and_peak(spark, sf):
    df = view(spark, sf, "irradiance").withColumn("power_kw", solar.power_from_ghi(F.col("ghi"), 5.0))
    parts = models.split_train_test(df, ["reading_id"])
    model = models.solar_gbt(parts.where(~F.col("is_test")), IN, "power_kw", 5)
    edge = spark.createDataFrame([("night", 0.0, 0.0, 0.0, 15.0, 0.0, 90.0), ("peak", 1000.0, 900.0, 100.0, 25.0, 0.0, 20.0),
                                  ("cloudy", 300.0, 100.0, 200.0, 20.0, 8.0, 45.0)],
                                 "name string, ghi double, dni double, dhi double, temperature double, cloud_type double, zenith_angle double")
    got = {r.name: r.prediction for r in models.predict(model, edge).collect()}
    assert 0 <= got["night"] < got["cloudy"] < got["peak"]
    scored = models.predict(model, parts.where("is_test"))
    assert scored.count() == parts.where("is_test").count()
    assert models.holdout_metrics(scored, "power_kw", "m").first().r2 > 0.8  # the mean scores 0


def test_split_is_stable(spark, sf):
    df = view(spark, sf, "readings")
    a = {r.reading_id for r in models.split_train_test(df, ["reading_id"]).where("is_test").collect()}
    b = {r.reading_id for r in models.split_train_test(df.repartition(7), ["reading_id"]).where("is_test").collect()}
    assert a == b and 0.15 < len(a) / df.count() < 0.25


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(2000)] + [(2000 + i, 9.0 + i, -9.0, 9.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    forest = isolation.IsolationForest.fit(df, "id", ["a", "b", "c"], trees=40)
    assert all(len(t["feature"]) <= 2 * 256 for t in forest.trees) and len(forest.trees) == 40
    flagged = isolation.flag_anomalies(materialize(forest.score(df), "t")).toPandas()
    assert flagged[flagged.id >= 2000].is_anomaly.all()
    assert flagged.is_anomaly.mean() == pytest.approx(0.05, abs=0.005)
    assert flagged.normal_score.between(0, 1).all()
    again = isolation.IsolationForest.fit(df.repartition(5), "id", ["a", "b", "c"], trees=40)
    assert all((x["threshold"] == y["threshold"]).all() for x, y in zip(forest.trees, again.trees))


def test_seasonal_forecast_follows_a_daily_wave(spark):
    hours = spark.range(24 * 20).select(F.lit(1).alias("k"), (F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("id").cast("int"))).alias("t")).withColumn("x", F.sin(F.hour("t") * (2 * np.pi / 24)) + 2)
    short = spark.createDataFrame([(2, "2024-03-01 00:00:00", 1.0)], "k int, t string, x double").withColumn(
        "t", F.col("t").cast("timestamp_ntz"))
    got = forecasting.seasonal_forecast(hours.unionByName(short), ["k"], "t", "x", 24).toPandas()
    assert set(got.k) == {1} and len(got) == 24  # a series of one row has no forecast
    want = np.sin(got.hour_ts.dt.hour * (2 * np.pi / 24)) + 2
    assert np.abs(got.prediction - want).max() < 0.1
    assert ((got.lower <= got.prediction) & (got.prediction <= got.upper)).all()


def test_ensemble_falls_back(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, prediction double")
    b = spark.createDataFrame([(2, 4.0), (3, 3.0)], "id long, prediction double")
    got = {r.id: r.prediction for r in models.ensemble(a, b, ["id"]).collect()}
    assert got == {1: 1.0, 2: pytest.approx(2.8), 3: 3.0}


def test_compare_and_select(spark):
    # the worked example of three models: the lowest RMSE wins
    m = spark.createDataFrame([("lstm", 50.0, 75.0, 0.15), ("boosted", 45.0, 70.0, 0.12), ("forest", 55.0, 85.0, 0.18)],
                              "model_name string, mae double, rmse double, mape double")
    assert [r.model_name for r in evaluation.compare_models(m).collect()] == ["boosted", "lstm", "forest"]
    assert evaluation.select_best(m).first().model_name == "boosted"
    assert evaluation.select_best(m, "mae", higher_is_better=True).first().model_name == "forest"


def test_non_finite_rows_are_left_out(spark):
    df = spark.createDataFrame([("m", 1.0, 1.5), ("m", 2.0, 2.0), ("m", float("nan"), 1.0), ("m", 1.0, float("inf"))],
                               "model_name string, y_true double, y_pred double")
    got = evaluation.regression_report(df, ["model_name"]).first()
    assert got.n_samples == 2 and got.max_error == 0.5


def test_time_folds_follow_time(spark, sf):
    got = models.time_folds(view(spark, sf, "irradiance"), "event_ts").groupBy("fold").agg(
        F.count("*").alias("n"), F.min("event_ts").alias("lo"), F.max("event_ts").alias("hi")).orderBy("fold").collect()
    assert [r.fold for r in got] == list(range(6))
    assert all(a.hi < b.lo for a, b in zip(got, got[1:])) and len({r.n for r in got[1:]}) == 1


def test_train_all_and_saved_models(spark, sf, tmp_path):
    df = view(spark, sf, "irradiance").withColumnsRenamed({"ghi": "GHI", "dni": "DNI", "temperature": "Temperature"})
    got = models.train_all({"site": df}, ["reading_id"], 2).collect()
    assert {r.model_name for r in got} == {"solar_gbt:site"} and {r.metric for r in got} == {"mae", "rmse", "mape", "r2"}
    r2 = next(r.value for r in got if r.metric == "r2")
    assert r2 < 0.5  # the label itself is not among the features
    model = models.solar_gbt(df, ["GHI", "DNI"], "Temperature", 2)
    models.save_model(model, f"{tmp_path}/m")
    a, b = (models.predict(m, df).agg(F.sum("prediction")).first()[0] for m in (model, models.load_model(f"{tmp_path}/m")))
    assert a == pytest.approx(b)


def test_horizon_rows(spark):
    df = spark.range(12).select(F.lit(1).alias("k"), (F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("id").cast("int"))).alias("t"), F.col("id").cast("double").alias("x"))
    rows = forecasting.horizon_rows(df, SeriesOrder(("k",), "t", long=False), "x", 3, 2)
    assert rows.count() == 16 and rows.where("label - back_0 <> step").count() == 0


def test_risk_and_anomaly_trainers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(v), float(rng.normal()), int(v + rng.normal() * 0.1 > 0.5), float(rng.normal(230, 2)), 0.9)
            for i, v in enumerate(rng.random(2000))]
    df = spark.createDataFrame(rows, "id long, volatility double, price_ratio double, risk_label int, voltage_v double, power_factor double")
    got = {(r.model_name, r.metric): r.value for r in models.train_all({"t": df}, ["id"], 10).collect()}
    assert got["risk_forest:t", "accuracy"] > 0.85 and got["risk_forest:t", "auc_roc"] > 0.95
    assert 0 < got["isolation_forest:t", "anomalies_detected"] <= 100 and got["isolation_forest:t", "contamination"] == 0.05


def test_time_split_leaves_a_gap(spark):
    df = spark.range(100).select((F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("t"), "id")
    parts = {p: sorted(r.id for r in models.split_by_time(df, "t", 10).where(F.col("part") == p).collect()) for p in ("train", "gap", "test")}
    assert parts["test"][0] >= 79 and parts["train"][-1] + 10 < parts["test"][0] and sum(map(len, parts.values())) == 100
    assert models.split_by_time(df.limit(0), "t", 10).count() == 0


def test_horizon_forecast_beats_the_last_value(spark):
    hours = spark.range(24 * 12).select(F.lit(1).alias("k"), (F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("id").cast("int"))).alias("t"), (F.sin(F.col("id") * (2 * np.pi / 24)) + 2).alias("x"))
    got = forecasting.horizon_forecast(hours, SeriesOrder(("k",), "t", long=False), "x", 24, 12, trees=10).toPandas()
    assert ((got.label - got.prediction) ** 2).mean() < 0.1 * ((got.label - got.last_value) ** 2).mean()
