import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunframe.operators import cleaning, features, scaling, validation
from sunframe.operators.series import SeriesOrder
from sunframe.plans import pipelines
from sunframe.fixtures import view


def frame(spark, values, key=1):
    rows = [(key, i, f"2024-01-01 {i % 24:02d}:00:00", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k long, id long, t string, x double").withColumn(
        "t", F.col("t").cast("timestamp_ntz"))


ORDER = SeriesOrder(("k",), "t", ("id",), long=False)


def xs(df):
    return [r.x for r in df.orderBy("id").collect()]


def test_fills(spark):
    df = frame(spark, [None, 1.0, None, None, None, 5.0, None])
    assert xs(cleaning.fill_forward(df, ORDER, ["x"], 2)) == [None, 1.0, 1.0, 1.0, None, 5.0, 5.0]
    assert xs(cleaning.fill_both(df, ORDER, ["x"])) == [1.0, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0]
    assert xs(cleaning.fill_linear(df, ORDER, ["x"])) == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 5.0]
    assert xs(cleaning.fill_linear(df, ORDER, ["x"], by_time=True)) == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 5.0]
    assert xs(cleaning.fill_linear(df, ORDER, ["x"], max_gap_rows=2))[2:5] == [None] * 3
    assert xs(cleaning.fill_mean(df, ["x"]))[0] == 3.0


@pytest.mark.parametrize("block", [1, 2, 5])
def test_long_series_give_the_same_fills(spark, block):
    rng = np.random.default_rng(block)
    df = frame(spark, [None if rng.random() < 0.5 else float(i) for i in range(24)])
    long = SeriesOrder(("k",), "t", ("id",), block_rows=block, long=True)
    for f in (lambda o: cleaning.fill_forward(df, o, ["x"], 2), lambda o: cleaning.fill_both(df, o, ["x"]),
              lambda o: cleaning.fill_linear(df, o, ["x"]), lambda o: cleaning.smooth_savgol(df.na.fill(0.0), o, ["x"], 5),
              lambda o: cleaning.smooth_ewma(df.na.fill(0.0), o, ["x"], 3)):
        assert xs(f(long)) == pytest.approx(xs(f(ORDER)), nan_ok=True)


def test_smoothing_matches_pandas(spark):
    values = [float(v) for v in np.random.default_rng(0).integers(0, 50, 23)]
    df, s = frame(spark, values), pd.Series(values)
    assert xs(cleaning.smooth_mean(df, ORDER, ["x"], 3)) == pytest.approx(
        s.rolling(3, center=True, min_periods=1).mean().tolist())
    assert xs(cleaning.smooth_ewma(df, ORDER, ["x"], 5)) == pytest.approx(s.ewm(span=5, adjust=False).mean().tolist())
    assert xs(cleaning.smooth_savgol(df, ORDER, ["x"], 3)) == pytest.approx(values)
    parabola = [float((i - 7) ** 2) for i in range(23)]
    assert xs(cleaning.smooth_savgol(frame(spark, parabola), ORDER, ["x"], 7)) == pytest.approx(parabola)


def test_outliers_replace_cells_and_keep_rows(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 2.0, 1.0, 2.0, 3.0, 100.0])
    cleaned, counts = cleaning.outliers_iqr(df, ["x"])
    assert counts == {"x": 1} and xs(cleaned)[-1] == pytest.approx(2.0) and cleaned.count() == 8


def brute_knn(rows, k):
    """rows: list of (id, x, y, z) with None for missing; nan-Euclidean, ties to the lower id."""
    out = []
    means = [np.mean([r[c] for r in rows if r[c] is not None]) for c in (1, 2, 3)]
    for r in rows:
        filled = list(r)
        for c in (1, 2, 3):
            if r[c] is None:
                near = []
                for d in rows:
                    if d[c] is None:
                        continue
                    shared = [(r[j] - d[j]) ** 2 for j in (1, 2, 3) if j != c and r[j] is not None and d[j] is not None]
                    if shared:
                        near.append((sum(shared) * 3 / len(shared), d[0], d[c]))
                near.sort()
                filled[c] = np.mean([n[2] for n in near[:k]]) if near else means[c - 1]
        out.append(tuple(filled))
    return out


def test_knn_fill_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *[None if rng.random() < 0.25 else float(rng.integers(0, 40)) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {r.id: (r.x, r.y, r.z) for r in cleaning.fill_knn(df, "id", ["x", "y", "z"]).collect()}
    for i, *want in brute_knn(rows, 5):
        assert got[i] == pytest.approx(tuple(want)), i


def test_scaler_round_trip(spark, tmp_path):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0, 10.0]).withColumn("c", F.lit(7.0))
    for method in ("standard", "minmax", "robust"):
        scaler = scaling.Scaler.fit(df, ["x", "c"], method)
        scaler.save(spark, f"{tmp_path}/{method}")
        again = scaling.Scaler.load(spark, f"{tmp_path}/{method}")
        assert again == scaler
        assert {r.c for r in again.transform(df).collect()} == {0.0}
    standard = xs(scaling.Scaler.fit(df, ["x"]).transform(df))
    assert np.mean(standard) == pytest.approx(0) and np.std(standard) == pytest.approx(1)


def test_pipeline_is_the_same_for_long_series(spark, sf):
    df = view(spark, sf, "readings_gappy")
    base = dict(columns=["power_kw", "temperature"], lags=(1, 6), sizes=(3, 6))
    short = SeriesOrder(("device_id",), "event_ts", ("reading_id",), long=False)
    long = SeriesOrder(("device_id",), "event_ts", ("reading_id",), block_rows=25, long=True)
    a, _ = pipelines.solar_pipeline(df, short, 5.0, **base)
    b, _ = pipelines.solar_pipeline(df, long, 5.0, **base)
    pick = ["reading_id", "power_kw", "power_kw_lag_6h", "power_kw_rolling_std_6h", "hour_sin"]
    x, y = (d.select(pick).toPandas().sort_values("reading_id").to_numpy(dtype=float) for d in (a, b))
    assert len(x) and np.allclose(x, y)


def test_missing_columns_raise(spark):
    with pytest.raises(validation.MissingColumns):
        validation.require_columns(frame(spark, [1.0]))


def test_temporal_checks_agree_on_long_series(spark, sf):
    df = view(spark, sf, "readings").withColumn("event_ts", F.when(
        F.col("reading_id") % 9 == 0, F.col("event_ts") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("event_ts")))
    got = [sorted(map(tuple, validation.validate_temporal(df, SeriesOrder(
        ("device_id",), "event_ts", block_rows=b, long=flag), "reading_id").collect())) for b, flag in ((1, False), (40, True))]
    assert got[0] == got[1] and sum(r[1] for r in got[0]) > 0


def test_sequences_have_full_windows(spark):
    made = features.sequences(frame(spark, [float(i) for i in range(10)]), ORDER, ["x"], "x", 4, 2)
    rows = made.orderBy("id").collect()
    assert len(rows) == 5 and [w[0] for w in rows[0].window] == [0, 1, 2, 3] and list(rows[0].label) == [4, 5]
