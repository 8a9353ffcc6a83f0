"""Model evaluation as aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .quantiles import exact_quantiles, running_total

EPS = 2.220446049250313e-16  # the smallest divisor of the relative error


def usable(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Rows whose truth and prediction are finite numbers."""
    keep = F.lit(True)
    for c in (truth, prediction):
        x = F.col(c)
        keep = keep & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.where(keep)


def _relative(truth: Column, prediction: Column) -> Column:
    return F.abs(truth - prediction) / F.greatest(F.abs(truth), F.lit(EPS))


def regression_metrics(df: DataFrame, by: list[str], truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """MAE, RMSE, MAPE and R2 per model; the total variation comes from the moments."""
    y, p = F.col(truth), F.col(prediction)
    error = (y - p) * (y - p)
    return df.groupBy(*by).agg(
        F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg(error)).alias("rmse"),
        F.avg(_relative(y, p)).alias("mape"),
        (1 - F.sum(error) / (F.var_pop(y) * F.count(y))).alias("r2"))


def regression_report(df: DataFrame, by: list[str], truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """The full set of regression metrics per model, non-finite rows left out."""
    df = usable(df, truth, prediction).withColumn("_abs", F.abs(F.col(prediction) - F.col(truth)))
    y, p = F.col(truth), F.col(prediction)
    r = p - y
    base = df.groupBy(*by).agg(
        F.count("*").alias("n_samples"), F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae"),
        (1 - F.avg(r * r) / F.var_pop(y)).alias("r2_score"),
        (1 - F.var_pop(r) / F.var_pop(y)).alias("explained_variance"),
        (F.avg(F.when(y != 0, _relative(y, p))) * 100).alias("mape"),
        F.avg(y).alias("y_true_mean"), F.stddev_pop(y).alias("y_true_std"),
        F.avg(p).alias("y_pred_mean"), F.stddev_pop(p).alias("y_pred_std"),
        F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"),
        F.max(F.abs(r)).alias("max_error"), (F.max(y) - F.min(y)).alias("_range"))
    base = base.withColumn("rmse", F.sqrt("mse"))
    ranged = F.col("_range") > 0
    base = base.withColumns({
        "nrmse": F.when(ranged, F.col("rmse") / F.col("_range")),
        "cv_rmse": F.when(ranged & (F.col("y_true_mean") != 0), F.col("rmse") / F.col("y_true_mean")),
    }).drop("_range")
    names = {0.5: "error_p50", 0.9: "error_p90", 0.95: "error_p95", 0.99: "error_p99"}
    tails = exact_quantiles(df, ["_abs"], list(names), by).groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == q, F.col("value"))).alias(n) for q, n in names.items()])
    return base.join(tails, by)


def peak_metrics(df: DataFrame, by: list[str], truth: str = "y_true", prediction: str = "y_pred",
                 quantile: float = 0.75) -> DataFrame:
    """Errors on the rows at or above the upper quartile of the truth."""
    df = usable(df, truth, prediction)
    bar = materialize(exact_quantiles(df, [truth], [quantile], by).select(
        *by, F.col("value").alias("peak_threshold")), "peak-thresholds")
    y, p = F.col(truth), F.col(prediction)
    high = df.join(bar, by).where(y >= F.col("peak_threshold"))
    return high.groupBy(*by).agg(
        F.max("peak_threshold").alias("peak_threshold"), F.count("*").alias("peak_rows"),
        F.avg(F.abs(y - p)).alias("peak_mae"), (F.avg(_relative(y, p)) * 100).alias("peak_mape"))


def confusion_counts(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(label).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("rows"))


def confusion_matrix(df: DataFrame, label: str, predicted: str, classes: list[int]) -> DataFrame:
    """Counts, one row per true class and one column per predicted class."""
    return df.groupBy(F.col(label).alias("truth")).agg(*[
        F.count_if(F.col(predicted) == c).alias(f"predicted_{c}") for c in classes])


def classification_metrics(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; undefined ratios count as zero."""
    by = by or []
    cells = confusion_counts(df, label, predicted, by)
    sides = cells.select(*by, F.col("truth").alias("cls"), F.col("rows").alias("support"),
                         F.lit(0).alias("guessed"), F.when(F.col("truth") == F.col("predicted"),
                                                           F.col("rows")).otherwise(0).alias("hits"))
    sides = sides.unionByName(cells.select(
        *by, F.col("predicted").alias("cls"), F.lit(0).alias("support"), F.col("rows").alias("guessed"),
        F.lit(0).alias("hits")))
    per = sides.groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hits")])
    precision = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    both = precision + recall
    f1 = F.when(both > 0, precision * recall * 2 / both).otherwise(0.0)
    weight, total = F.col("support"), F.sum("support")
    return per.groupBy(*by).agg(
        (F.sum("hits") / total).alias("accuracy"), (F.sum(precision * weight) / total).alias("precision"),
        (F.sum(recall * weight) / total).alias("recall"), (F.sum(f1 * weight) / total).alias("f1"))


def auc_roc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half.

    Rows are combined per distinct score; running totals over score ranges replace a global sort.
    """
    tally = df.groupBy(score).agg(F.count_if(F.col(positive) == 1).cast("double").alias("pos"),
                                  F.count_if(F.col(positive) != 1).cast("double").alias("neg"))
    ranked = running_total(tally, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc_roc"))


def compare_models(metrics: DataFrame, sort_by: str = "rmse", name: str = "model_name") -> DataFrame:
    """The metric table from best to worst."""
    return metrics.orderBy(sort_by, name)


def select_best(metrics: DataFrame, metric: str = "rmse", name: str = "model_name",
                higher_is_better: bool = False) -> DataFrame:
    """Best model; equal metrics go to the first name."""
    known = metrics.where(F.col(metric).isNotNull())
    value = F.col(metric) if not higher_is_better else -F.col(metric)
    best = known.agg(F.min(F.struct(value.alias("v"), F.col(name).alias("n"))).alias("b"))
    sign = -1 if higher_is_better else 1
    return best.where(F.col("b").isNotNull()).select(
        F.col("b.n").alias(name), (F.col("b.v") * sign).alias(metric))


def error_by_bin(df: DataFrame, by: list[str], truth: str = "y_true", prediction: str = "y_pred",
                 bins: int = 5) -> DataFrame:
    """Mean absolute error in equal-width bins of the truth; the last upper edge is left out."""
    ends = materialize(df.groupBy(*by).agg(F.min(truth).alias("_lo"), F.max(truth).alias("_hi")), "bin-ends")
    width = (F.col("_hi") - F.col("_lo")) / bins
    placed = df.join(ends, by).where(F.col(truth) < F.col("_hi")).withColumn(
        "bin", F.least(F.lit(bins - 1), F.floor((F.col(truth) - F.col("_lo")) / width)))
    found = placed.groupBy(*by, "bin").agg(
        F.avg(F.abs(F.col(prediction) - F.col(truth))).alias("mae"), F.count("*").alias("rows"))
    grid = ends.select(*by, (F.col("_lo") * 1).alias("_lo"), width.alias("_w"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(found, [*by, "bin"], "left").select(
        *by, "bin", (F.col("_lo") + F.col("_w") * (F.col("bin") + 0.5)).alias("bin_center"),
        F.coalesce("mae", F.lit(0.0)).alias("mae"), F.coalesce("rows", F.lit(0)).alias("rows"))


def residual_histogram(df: DataFrame, by: list[str], truth: str = "y_true", prediction: str = "y_pred",
                       bins: int = 30) -> DataFrame:
    """Residual counts in equal-width bins; the last bin includes its upper edge."""
    df = df.withColumn("_r", F.col(prediction) - F.col(truth))
    ends = materialize(df.groupBy(*by).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi")), "bin-ends")
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_r") - F.col("_lo")) / width))).otherwise(0)
    return df.join(ends, by).groupBy(*by, slot.cast("long").alias("bin")).agg(
        F.count("*").alias("rows"), F.min("_r").alias("least"), F.max("_r").alias("most"))


def residual_quantiles(df: DataFrame, by: list[str], probs: list[float], truth: str = "y_true",
                       prediction: str = "y_pred") -> DataFrame:
    """Residual quantiles, the empirical half of a normality plot."""
    made = df.withColumn("residual", F.col(prediction) - F.col(truth))
    return exact_quantiles(made, ["residual"], probs, by).drop("column")


def score_table(metrics: DataFrame) -> DataFrame:
    """Scores from 0 to 100 relative to the worst model, and status labels from R2."""
    worst = metrics.agg(F.struct(F.max("rmse").alias("rmse"), F.max("mae").alias("mae"))).scalar()

    def inverted(c: str) -> Column:
        return F.when(worst[c] > 0, 100 - F.col(c) / worst[c] * 100).otherwise(0.0)

    r2 = F.col("r2")
    return metrics.select(
        "model_name", (r2 * 100).alias("r2_points"), inverted("rmse").alias("rmse_points"),
        inverted("mae").alias("mae_points"),
        (100 - F.when(F.col("mape") < 100, F.col("mape") / 100).otherwise(100.0)).alias("mape_points"),
        F.when(r2 > 0.8, "Good").when(r2 > 0.6, "Acceptable").otherwise("Needs Improvement").alias("status"),
        F.when(r2 > 0.9, "Excellent").when(r2 > 0.8, "Good").otherwise("Acceptable").alias("grade"))


def refresh_decision(old: DataFrame, new: DataFrame, margin: float = 0.05, name: str = "model_name") -> DataFrame:
    """Deploy a retrained model only when its MAE is more than 5% lower."""
    o = old.select(name, F.col("mae").alias("old_mae"))
    n = new.select(name, F.col("mae").alias("new_mae"))
    both = o.join(n, name)
    gain = (F.col("old_mae") - F.col("new_mae")) / F.col("old_mae")
    return both.withColumns({"improvement": gain, "decision": F.when(gain > margin, "deploy").otherwise("keep")})


def drift_report(baseline: DataFrame, current: DataFrame, columns: list[str], threshold: float = 0.15) -> DataFrame:
    """Relative change of mean and deviation per column against a baseline."""
    def stats(df: DataFrame, tag: str) -> DataFrame:
        wide = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns)
                        for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("statistic"), F.col(f"{n}{i}").alias(tag))
            for i, c in enumerate(columns) for s, n in (("mean", "m"), ("std", "s"))]))
        return wide.select(cells.alias("r")).select("r.*")

    both = stats(baseline, "baseline").join(stats(current, "current"), ["column_name", "statistic"])
    change = F.abs(F.col("current") - F.col("baseline")) / F.abs(F.col("baseline"))
    return both.withColumns({"relative_change": change, "is_drifting": change > threshold})


def describe_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per column, one row each."""
    types = dict(df.dtypes)
    wide = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in (
        (F.count, "c"), (F.avg, "m"), (F.stddev_samp, "s"), (F.min, "lo"), (F.max, "hi"))])
    cells = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"), F.col(f"c{i}").alias("count"),
        F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
        F.col(f"lo{i}").cast("double").alias("min"), F.col(f"hi{i}").cast("double").alias("max"),
    ) for i, c in enumerate(columns)]))
    base = wide.select(cells.alias("r")).select("r.*")
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    quart = exact_quantiles(df, columns, list(names)).groupBy(F.col("column").alias("column_name")).agg(*[
        F.max(F.when(F.col("prob") == q, F.col("value"))).alias(n) for q, n in names.items()])
    return base.join(quart, "column_name", "left")
