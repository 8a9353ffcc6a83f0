"""Training and applying models with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import evaluation
from .isolation import IsolationForest, flag_anomalies
from .quantiles import running_total

# Feature lists per model; columns a table lacks are left out.
FEATURES = {
    "solar": ["GHI", "DNI", "DHI", "Temperature", "Humidity", "WindSpeed", "Hour_sin", "Hour_cos",
              "DayOfYear_sin", "DayOfYear_cos"],
    "demand": ["Hour_sin", "Hour_cos", "DayOfWeek_sin", "DayOfWeek_cos", "Month_sin", "Month_cos",
               "Temperature", "Humidity"],
    "risk": ["volatility", "price_ratio", "frequency_anomalies", "power_factor_deviation"],
    "anomaly": ["power_kw", "voltage_v", "current_a", "frequency_hz", "power_factor"],
}
PRICE_BOUNDS = (4.0, 12.0)


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    kept = [c for c in wanted if c in df.columns]
    if not kept:
        raise ValueError("none of the feature columns is present")
    return kept


def _prepared(features: list[str], scaled: bool = False) -> list:
    filled = [f"_in_{c}" for c in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="mean"),
              VectorAssembler(inputCols=filled, outputCol="_raw" if scaled else "features")]
    if scaled:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    return stages


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def gbt(features: list[str], label: str, trees: int, rate: float, depth: int, share: float = 1.0,
        scaled: bool = False, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[*_prepared(features, scaled), GBTRegressor(
        labelCol=label, maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=share,
        featureSubsetStrategy="all", seed=seed)])


def solar_gbt(df: DataFrame, features: list[str], label: str, trees: int = 500) -> PipelineModel:
    return gbt(features, label, trees, 0.1, 8, 0.8).fit(_doubles(df, [*features, label]))


def demand_gbt(df: DataFrame, features: list[str], label: str, trees: int = 300) -> PipelineModel:
    return gbt(features, label, trees, 0.05, 6, 0.8).fit(_doubles(df, [*features, label]))


def price_gbt(df: DataFrame, features: list[str], label: str, trees: int = 200) -> PipelineModel:
    return gbt(features, label, trees, 0.1, 5, 0.8, scaled=True).fit(_doubles(df, [*features, label]))


def demand_forest(df: DataFrame, features: list[str], label: str, trees: int = 200) -> PipelineModel:
    return Pipeline(stages=[*_prepared(features), RandomForestRegressor(
        labelCol=label, numTrees=trees, maxDepth=15, minInstancesPerNode=5, seed=42)]
    ).fit(_doubles(df, [*features, label]))


def risk_forest(df: DataFrame, features: list[str], label: str, trees: int = 200) -> PipelineModel:
    return Pipeline(stages=[*_prepared(features, True), RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=10, seed=42)]).fit(_doubles(df, [*features, label]))


def failure_forest(df: DataFrame, features: list[str], label: str, trees: int = 150) -> PipelineModel:
    return Pipeline(stages=[*_prepared(features, True), RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=8, seed=42)]).fit(_doubles(df, [*features, label]))


def predict(model: PipelineModel, df: DataFrame, low: float | None = 0.0, high: float | None = None,
            name: str = "prediction") -> DataFrame:
    """Predictions within bounds; helper columns removed, no row lost."""
    inputs = [c for c in model.stages[0].getInputCols() if c in df.columns]
    out = model.transform(_doubles(df, inputs))
    value: Column = F.col("prediction")
    if low is not None:
        value = F.greatest(F.lit(low), value)
    if high is not None:
        value = F.least(F.lit(high), value)
    return out.select(*df.columns, value.alias(name))


def predict_class(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Class, its probability and the probability of class 1."""
    inputs = [c for c in model.stages[0].getInputCols() if c in df.columns]
    out = model.transform(_doubles(df, inputs))
    odds = vector_to_array("probability")
    return out.select(*df.columns, F.col("prediction").cast("int").alias("predicted_class"),
                      F.array_max(odds).alias("probability"), F.get(odds, F.lit(1)).alias("probability_1"))


def importances(model: PipelineModel, df: DataFrame, top: int) -> DataFrame:
    """The most important features of a tree model, best first."""
    names = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names, map(float, weights)), key=lambda r: (-r[1], r[0]))[:top]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def _key_hash(key: list[str], seed: int) -> Column:
    """Eight hex digits that follow from the key as text; SQL with md5 finds the same."""
    return F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))), 1, 8)


def split_train_test(df: DataFrame, key: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``, decided by a hash of the key: the same row always falls the same way."""
    return df.withColumn("is_test", _key_hash(key, seed) < F.lit(f"{int(test_share * 2 ** 32):08x}"))


def split_by_time(df: DataFrame, ts: str, gap_hours: int, test_share: float = 0.2) -> DataFrame:
    """Adds ``part``: ``train`` for rows whose next ``gap_hours`` end before the last share of the time range, ``test``
    for rows in that share, ``gap`` between them, so that no row to learn from looks into the tested range."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    first, last = df.agg(F.min(at), F.max(at)).first()
    cut = None if first is None else int(first + (last - first) * (1 - test_share))
    ahead = at + gap_hours * 3_600_000_000
    return df.withColumn("part", F.when(at >= F.lit(cut), "test").when(ahead < F.lit(cut), "train").otherwise("gap"))


def ensemble(first: DataFrame, second: DataFrame, key: list[str], first_weight: float = 0.6) -> DataFrame:
    """Weighted mean of two prediction tables; where one is absent the other stands alone."""
    a = first.select(*key, F.col("prediction").alias("first_prediction"))
    b = second.select(*key, F.col("prediction").alias("second_prediction"))
    x, y = F.col("first_prediction"), F.col("second_prediction")
    return a.join(b, key, "full").withColumn(
        "prediction", F.coalesce(x * first_weight + y * (1 - first_weight), x, y))


def cross_validate(df: DataFrame, estimator: Pipeline, key: list[str], label: str, folds: int = 5) -> DataFrame:
    """Mean R2 over hashed folds."""
    spot = F.pmod(F.conv(_key_hash(key, 0), 16, 10).cast("long"), F.lit(folds)).cast("int")
    judge = RegressionEvaluator(labelCol=label, metricName="r2")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge,
                        numFolds=folds, foldCol="_fold", parallelism=2)
    model = cv.fit(df.withColumn("_fold", spot))
    row = (folds, float(model.avgMetrics[0]), float(model.stdMetrics[0]))
    return df.sparkSession.createDataFrame([row], "folds int, cv_r2_mean double, cv_r2_std double")


def time_folds(df: DataFrame, ts: str, folds: int = 5) -> DataFrame:
    """Adds ``fold`` by time: 0 trains only, fold i is tested on a model of the folds before it.

    Ranks come from counts per timestamp and running totals; rows of one instant share a fold.
    """
    timed = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")).cast("double"))
    tally = timed.groupBy("_t").agg(F.count("*").alias("n"))
    ranks = running_total(tally, "_t", ["n"]).select("_t", "n_before")
    total = df.count()
    size = max(1, total // (folds + 1))
    first = total - folds * size
    fold = F.when(F.col("n_before") < first, 0).otherwise(F.floor((F.col("n_before") - first) / size) + 1)
    return timed.join(ranks, "_t").withColumn("fold", fold.cast("int")).drop("_t", "n_before")


def time_series_cv(df: DataFrame, estimator: Pipeline, ts: str, label: str, folds: int = 5) -> DataFrame:
    """RMSE per expanding fold; one fit per fold."""
    parts = materialize(time_folds(df, ts, folds), "time-folds")  # read by every fit
    out = None
    for i in range(1, folds + 1):
        model = estimator.fit(parts.where(F.col("fold") < i))
        scored = model.transform(parts.where(F.col("fold") == i))
        error = F.col(label) - F.col("prediction")
        row = scored.agg(F.lit(i).alias("fold"), F.count("*").alias("rows"), F.sqrt(F.avg(error * error)).alias("rmse"))
        out = row if out is None else out.unionByName(row)
    return out


def holdout_metrics(scored: DataFrame, label: str, name: str) -> DataFrame:
    return evaluation.regression_metrics(
        scored.withColumn("model_name", F.lit(name)), ["model_name"], label, "prediction")


def _long(metrics: DataFrame) -> DataFrame:
    """(model_name, metric, value) of one-row-per-model metrics."""
    names = [c for c in metrics.columns if c != "model_name"]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select("model_name", F.explode(pairs).alias("_m")).select("model_name", "_m.metric", "_m.value")


def train_all(tables: dict[str, DataFrame], key: list[str], trees: int | None = None) -> DataFrame:
    """Route each table to the trainers its columns allow; (model_name, metric, value) on rows not trained on.

    ``trees`` replaces every trainer's own number.
    """
    from functools import reduce

    results = []
    for name, df in tables.items():
        columns = set(df.columns)
        if columns & {"GHI", "DNI"}:
            label = "GHI" if "GHI" in columns else df.columns[0]
            features = [c for c in FEATURES["solar"] if c in columns and c != label]
            if features:
                results.append(_trained(df, features, label, key, f"solar_gbt:{name}", trees or 200))
        if "active_power_kw" in columns:
            results.append(_trained(df, available(df, FEATURES["demand"]), "active_power_kw", key,
                                    f"demand_gbt:{name}", trees or 200))
        if "risk_label" in columns and columns & set(FEATURES["risk"]):
            results.append(train_risk(df, key, f"risk_forest:{name}", trees or 100))
        if {"voltage_v", "power_factor"} <= columns:
            results.append(train_anomaly(df, key[0], f"isolation_forest:{name}", trees or 100))
    if not results:
        raise ValueError("no table has the columns of a known model")
    return reduce(DataFrame.unionByName, results)


def _trained(df: DataFrame, features: list[str], label: str, key: list[str], name: str, trees: int) -> DataFrame:
    target = df.withColumn("_label", F.col(label).cast("double"))
    parts = split_train_test(_doubles(target, features), key)
    model = gbt(features, "_label", trees, 0.1, 6).fit(parts.where(~F.col("is_test")))
    return _long(holdout_metrics(predict(model, parts.where("is_test"), low=None), "_label", name))


def train_risk(df: DataFrame, key: list[str], name: str = "risk_forest", trees: int = 100) -> DataFrame:
    """Accuracy and area under the ROC curve of a forest for ``risk_label`` (0 or 1) on rows not trained on."""
    features = available(df, FEATURES["risk"])
    parts = split_train_test(_doubles(df, [*features, "risk_label"]), key).where(F.col("risk_label").isNotNull())
    model = Pipeline(stages=[*_prepared(features), RandomForestClassifier(
        labelCol="risk_label", numTrees=trees, maxDepth=8, seed=42)]).fit(parts.where(~F.col("is_test")))
    scored = predict_class(model, parts.where("is_test"))
    right = scored.agg(F.avg((F.col("predicted_class") == F.col("risk_label")).cast("double")).alias("accuracy"))
    area = evaluation.auc_roc(scored, "risk_label", "probability_1").scalar()
    return _long(right.withColumns({"auc_roc": area, "model_name": F.lit(name)}))


def train_anomaly(df: DataFrame, row_id: str, name: str = "isolation_forest", trees: int = 100,
                  contamination: float = 0.05) -> DataFrame:
    """How many rows an isolation forest flags at this contamination."""
    flagged = anomaly_report(df, row_id, available(df, FEATURES["anomaly"]), contamination, trees)
    counts = flagged.agg(F.sum("is_anomaly").alias("anomalies_detected"), F.lit(contamination).alias("contamination"))
    return _long(counts.withColumn("model_name", F.lit(name)))


def anomaly_report(df: DataFrame, row_id: str, features: list[str], contamination: float = 0.05,
                   trees: int = 100) -> DataFrame:
    """Every row with its anomaly score and flag."""
    forest = IsolationForest.fit(df, row_id, features, trees)
    return flag_anomalies(materialize(forest.score(df), "anomaly-scores"), contamination)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
