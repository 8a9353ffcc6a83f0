"""Hand-worked rows for the formulas."""

import pytest
from pyspark.sql import functions as F

from sunframe.functions import deals, geo, solar
from sunframe.operators import rules


def one(spark, **columns):
    return [v for v in spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()]


def test_distance(spark):
    km, flat = one(spark, km=geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
                   flat=geo.planar_km(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)))
    assert km == pytest.approx(111.194926, abs=1e-5)
    assert flat == pytest.approx(555.0)


def test_system_value_and_returns(spark):
    value = deals.system_value(F.lit(5.0), F.lit(2.0), F.lit(85.0))
    assert one(spark, v=value) == [pytest.approx(5 * 100000 * 0.9 * 1.01)]
    assert one(spark, v=deals.system_value(F.lit(None).cast("double"), F.lit(2.0), F.lit(85.0))) == [0.0]
    old = deals.system_value(F.lit(1.0), F.lit(40.0), F.lit(75.0))
    assert one(spark, v=old, roi=deals.investor_roi(F.lit(1.0), old)) == [50000.0, pytest.approx(18.25)]


def test_scores(spark):
    full = deals.buyer_seller_score(F.lit(0.0), F.lit(5.0), F.lit(5.0), F.lit(10.0), F.lit(10.0), F.lit(0.0), F.lit("excellent"))
    far = deals.buyer_seller_score(F.lit(12.5), F.lit(5.0), F.lit(1.0), F.lit(10.0), F.lit(1.0), F.lit(4.0), F.lit("poor"))
    assert one(spark, a=full, b=far) == [100.0, pytest.approx(10 + 10 + 5)]
    # efficiency counts at most ten points with the age and efficiency formula
    new = deals.investor_seller_score(F.lit(0.0), F.lit(100.0), F.lit(0.5), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit("good"))
    assert one(spark, a=new) == [pytest.approx(20 + 9 + 30 + 15)]


def test_risk_labels(spark):
    got = one(spark, a=deals.party_risk(F.lit("excellent"), F.lit(80.0)), b=deals.party_risk(F.lit("good"), F.lit(60.0)),
              c=deals.party_risk(F.lit("fair"), F.lit(99.0)), d=rules.risk_label(F.lit(800.0), F.lit(0.1)),
              e=rules.failure_label(F.lit(1.0), F.lit(45.0), F.lit(60.0)), f=rules.price_label(F.lit(1.0), F.lit(6)))
    assert got == ["low", "medium", "high", 0, 1, pytest.approx(8.0)]


def test_sun(spark):
    noon, night = F.lit("2024-06-21 12:00:00").cast("timestamp_ntz"), F.lit("2024-06-21 00:00:00").cast("timestamp_ntz")
    high, low, potential, dark = one(
        spark, high=solar.elevation_deg(noon, F.lit(23.45)), low=solar.elevation_deg(night, F.lit(23.45)),
        potential=solar.solar_potential(noon, F.lit(0.0)), dark=solar.solar_potential(night, F.lit(0.0)))
    assert high == pytest.approx(90, abs=0.1) and low == 0.0
    assert 700 < potential <= 1000 and dark == 0.0


def test_missing_stays_missing(spark):
    none = F.lit(None).cast("double")
    now = F.lit("2024-06-21 12:00:00").cast("timestamp_ntz")
    low, high = solar.band(none, "post")
    assert one(spark, a=solar.clip(none, 0.0, 1.0), b=solar.solar_potential(now, none), c=low, d=high) == [None] * 4


def test_price_and_severity(spark):
    df = spark.createDataFrame([(1.0, 9.9, 5.0), (30.0, 9.9, 13.0)], "s double, d double, t double")
    rows = rules.price_quote(df, "s", "d", "t").orderBy("s").collect()
    assert rows[0].price_min == pytest.approx(4.5) and rows[0].price_max == pytest.approx(5.5)
    assert rows[1].price_max == 12.0 and rows[0].supply_demand_ratio == pytest.approx(0.1)
    flags = spark.createDataFrame([(1, 0)] * 4 + [(2, 1)] * 6 + [(3, 1)] * 11, "device_id long, is_anomaly int")
    got = {r.device_id: r.severity for r in rules.anomaly_severity(flags, ["device_id"]).collect()}
    assert got == {1: "low", 2: "medium", 3: "high"}
