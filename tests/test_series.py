import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunframe.operators import quantiles, series


def _frame(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, 0 if i % 3 else i % 5, f"2024-01-{1 + i // 60:02d} {i % 24:02d}:00:00",
             None if rng.random() < .3 else float(rng.randint(0, 50))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k long, t string, x double").withColumn(
        "t", F.to_timestamp("t"))


def _order(long, block=37):
    return series.SeriesOrder(("k",), "t", ("id",), block_rows=block, grain="day", long=long)


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_blocked_window_equals_plain_window(spark):
    df = _frame(spark)

    def build(w):
        return {"l": F.lag("x", 5).over(w), "m": F.sum("x").over(w.rowsBetween(-6, 3))}

    plain = series.windowed(df, _order(False), build, 6, 3)
    blocked = series.windowed(df, _order(True), build, 6, 3)
    assert _rows(plain) == _rows(blocked)
    tiny = series.windowed(df, _order(True, 2), build, 6, 3)
    assert _rows(plain) == _rows(tiny)


def test_blocked_neighbours_equal_plain(spark):
    df = _frame(spark)
    assert _rows(series.neighbours(df, _order(False), ["x"])) == _rows(
        series.neighbours(df, _order(True, 4), ["x"]))


def test_resolve_counts_rows_per_key(spark):
    df = _frame(spark)
    assert _order(None).resolve(df).long is True
    assert _order(None, 10_000).resolve(df).long is False


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"g": rng.integers(0, 3, 5000), "a": rng.normal(size=5000),
                         "b": rng.integers(0, 7, 5000).astype(float)})
    df = spark.createDataFrame(data)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    for accuracy in (100_000, 200, 50):  # 200 and 50 force the bracket path
        got = {(r["g"], r["column"], r["prob"]): r["value"] for r in quantiles.exact_quantiles(
            df, ["a", "b"], probs, ["g"], accuracy).collect()}
        for g, part in data.groupby("g"):
            for c in "ab":
                for p in probs:
                    assert abs(got[(g, c, p)] - np.quantile(part[c], p)) < 1e-9


def test_running_total(spark):
    data = pd.DataFrame({"x": np.random.default_rng(3).permutation(2000) / 7.0, "n": 1})
    got = quantiles.running_total(spark.createDataFrame(data), "x", ["n"]).toPandas()
    assert (got.sort_values("x")["n_before"].to_numpy() == np.arange(2000)).all()


@pytest.mark.parametrize("accuracy,most_inside", [(20, 5), (200, 50), (100_000, 50_000)])
def test_quantile_brackets_are_narrowed(spark, accuracy, most_inside):
    """Coarse sketches: many rounds, brackets that miss, a value that a third of the rows share, one-row groups."""
    rng = np.random.default_rng(8)
    rows = [("a", float(x)) for x in rng.normal(size=900)] + [("a", 0.25)] * 500 + [("b", float(x)) for x in rng.pareto(0.5, 700)]
    rows += [("c", 4.0), ("d", 1.0), ("d", 2.0), ("e", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.value for r in quantiles.exact_quantiles(df, ["x"], probs, ["g"], accuracy, most_inside).collect()}
    for g in ("a", "b", "c", "d", None):
        own = [x for k, x in rows if k == g and x is not None]
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(own, p), abs=1e-12), (g, p)
    assert len(got) == 5 * len(probs)


def test_a_long_series_is_many_tasks(spark):
    """Blocks stay small, and tasks take few of them, however long the series is."""
    df = spark.range(400_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("t"), "id",
                                     F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    order = series.SeriesOrder(("k",), "t", ("id",))
    for made in (series.windowed(df, order, lambda w: {"back": F.lag("id").over(w)}, 1), series.neighbours(df, order, ["v"])):
        parts = [n for _, n in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 400_000 and max(parts) <= 200_000
