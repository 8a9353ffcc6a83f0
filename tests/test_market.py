import random

import pytest
from pyspark.sql import functions as F

from sunframe.operators import indisk, investing, nearest, radius
from sunframe.plans.registry import round6


def scatter(spark, n, seed, prefix, copies=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if copies and i % 3 == 0:  # a third of all rows in one spot
            rows.append((i, 12.9, 77.5))
        else:
            rows.append((i, 12.9 + rng.uniform(-1, 1), 77.5 + rng.uniform(-1, 1)))
    return spark.createDataFrame(rows, f"{prefix}_id long, {prefix}_lat double, {prefix}_lon double"), rows


def km(a, b):
    from math import asin, cos, radians, sin, sqrt

    h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371 * asin(sqrt(h))


@pytest.mark.parametrize("limit", [4_000_000, 50])
def test_radius_join_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(radius, "MAX_PAIRS_PER_SLICE", limit)
    a, rows_a = scatter(spark, 90, 1, "a")
    b, rows_b = scatter(spark, 60, 2, "b")
    disks = b.withColumn("r", (F.col("b_id") % 5 * 20 + 0.5).cast("double"))
    got = {(r.a_id, r.b_id) for r in radius.radius_join(a, disks, ("a_lat", "a_lon"), ("b_lat", "b_lon"), F.col("r")).collect()}
    want = {(x[0], y[0]) for x in rows_a for y in rows_b if km(x, y) <= y[0] % 5 * 20 + 0.5}
    assert got == want


def test_radius_join_across_the_date_line_and_near_the_pole(spark):
    a = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.9, 10.0), (3, 0.0, 10.0)], "a_id long, a_lat double, a_lon double")
    b = spark.createDataFrame([(1, 0.0, -179.9), (2, 89.9, -170.0)], "b_id long, b_lat double, b_lon double")
    got = radius.radius_join(a, b, ("a_lat", "a_lon"), ("b_lat", "b_lon"), F.lit(50.0)).collect()
    assert {(r.a_id, r.b_id) for r in got} == {(1, 1), (2, 2)}


def test_slices_of_a_crowded_cell_copy_few_rows(spark):
    keys = [("_level", "_d_level")]
    points = spark.range(400).select(F.col("id").alias("a_id"), F.lit(3).alias("_level"))
    disks = spark.range(600).select(F.col("id").alias("b_id"), F.lit(3).alias("_d_level"))
    a, b, on = radius._slice_hot(points, disks, keys, 100)
    # parts of ten rows: every point meets 60 parts, every disk 40; one-sided slices listed 1.4 million disks
    assert (a.count(), b.count()) == (400 * 60, 600 * 40)
    pairs = a.join(b, [a[p] == b[d] for p, d in on])
    assert pairs.select("a_id", "b_id").distinct().count() == pairs.count() == 400 * 600


@pytest.mark.parametrize("limit", [4_000_000, 50])
def test_summary_of_pairs_equals_the_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(radius, "MAX_PAIRS_PER_SLICE", limit)
    industries, _ = scatter(spark, 90, 1, "x")
    hosts, _ = scatter(spark, 60, 2, "x")
    names = {"x_id": "id", "x_lat": "latitude", "x_lon": "longitude"}
    industries, hosts = industries.withColumnsRenamed(names), hosts.withColumnsRenamed(names)
    odd = spark.createDataFrame([(1, None, 77.5), (2, 12.9, None), (3, float("nan"), 77.5), (None, 12.9, 77.5), (None, 13.0, 77.5),
                                 (5, 12.9, 77.5), (5, 12.9, 77.5), (6, -60.0, 10.0), (7, 89.9, 10.0), (8, 89.9, -170.0)], hosts.schema)
    industries, hosts = industries.unionByName(odd), hosts.unionByName(odd)
    pairs = investing.nearby_industries(hosts, industries)
    want = {r[0]: r[1:] for r in pairs.groupBy("h_id").agg(F.count("*"), F.min("distance_km"), F.avg("distance_km")).collect()}
    made = investing.nearby_industries(hosts, industries, summary=True)
    assert made.columns == ["h_id", "pairs", "nearest_km", "mean_km"]
    got = {r[0]: r[1:] for r in made.collect()}
    assert got.keys() == want.keys() and None in got and {1, 7, 8} <= got.keys()
    for host, (count, nearest_km, mean_km) in want.items():
        assert got[host][0] == count
        assert got[host][1:] == pytest.approx((nearest_km, mean_km), abs=1e-9)


def test_block_summary_decides_the_edge_by_the_formula():
    import numpy as np

    rng = np.random.default_rng(7)
    lat, lon = rng.uniform(12, 13, 50), rng.uniform(77, 78, 50)
    a, b = np.radians(lat), np.radians(lon)
    points = [np.cos(a) * np.cos(b) / 2, np.cos(a) * np.sin(b) / 2, np.sin(a) / 2, lat, lon, np.cos(a)]
    up, out = np.sin(np.radians(lat - lat[0]) / 2), np.sin(np.radians(lon - lon[0]) / 2)
    reach = np.arcsin(np.sqrt(up * up + np.cos(a) * np.cos(a[0]) * out * out)) * 2 * 6371
    for r in reach[1:]:  # the radius is the very distance of one point
        edge = np.sin(r / 12742) ** 2
        disk = [c[:1] for c in points] + [np.array([v]) for v in (r, edge * (1 - 1e-9) - 1e-20, edge * (1 + 1e-9) + 1e-20)]
        count, least, total = radius.block_summary(points, disk)
        assert count[0] == (reach <= r).sum() and least[0] == 0.0
        assert total[0] == pytest.approx(reach[reach <= r].sum(), abs=1e-9)


@pytest.mark.parametrize("planar", [False, True])
def test_radius_join_lists_no_cell_out_of_reach(spark, planar):
    wide = F.lit(1.0)
    cells = spark.range(60).select(F.col("id").alias("_x")).crossJoin(spark.range(60).select(F.col("id").alias("_y")))
    near = {(r._x, r._y) for r in cells.where(radius._touched(F.lit(30.5), F.lit(30.5), F.lit(1000.0), wide, planar)).collect()}
    places = cells.select("_x", "_y", F.explode(F.array(*[F.lit(i / 8) for i in range(9)])).alias("u")).select(
        "_x", "_y", "u", F.explode(F.array(*[F.lit(i / 8) for i in range(9)])).alias("v"))
    measure = radius.planar_km if planar else radius.haversine_km
    within = measure(F.lit(30.5), F.lit(30.5), F.col("_y") + F.col("v"), F.col("_x") + F.col("u")) <= 1000
    held = {(r._x, r._y) for r in places.where(within).select("_x", "_y").distinct().collect()}
    assert held <= near and len(near) < 1.2 * len(held)


def test_radius_join_keeps_pairs_on_the_edge(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(0, 3), rng.uniform(-3, 3)) for i in range(300)]
    pairs = spark.createDataFrame(rows, "id long, a_lat double, a_lon double, up double, out double").withColumns(
        {"b_lat": F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("a_lat") + F.col("up"))), "b_lon": F.col("a_lon") + F.col("out")})
    pairs = pairs.withColumn("r", radius.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    pairs = pairs.unionByName(pairs.withColumns({"id": F.col("id") + 1000, "b_lat": F.col("a_lat"), "b_lon": F.col("a_lon"), "r": F.lit(0.0)}))
    disks = pairs.select(F.col("id").alias("b_id"), "b_lat", "b_lon", "r")
    points = pairs.select(F.col("id").alias("a_id"), "a_lat", "a_lon")
    got = radius.radius_join(points, disks, ("a_lat", "a_lon"), ("b_lat", "b_lon"), F.col("r"))
    own = got.where("a_id = b_id").select("a_id").distinct().count()  # the radius is the very distance
    assert own == 600


@pytest.mark.parametrize("cell_rows", [500, 4])
def test_nearest_equals_brute_force(spark, cell_rows):
    a, rows_a = scatter(spark, 40, 3, "a")
    b, rows_b = scatter(spark, 120, 4, "b")
    found = nearest.nearest_on_globe(a.select("a_lat", "a_lon"), b, ("a_lat", "a_lon"), ("b_lat", "b_lon"), "b_id", 4,
                                     F.lit(60.0), cell_rows=cell_rows)
    got = {}
    for r in found.collect():
        got.setdefault((r.a_lat, r.a_lon), set()).add(r.b_id)
    for x in {r[1:] for r in rows_a}:
        near = sorted((km((0, *x), y), y[0]) for y in rows_b if km((0, *x), y) <= 60)[:4]
        assert got.get(x, set()) == {i for _, i in near}


def test_quick_rounding_equals_decimal_rounding(spark):
    rng = random.Random(6)
    values = [0.0, -0.0, -1e-9, 5e-7, -5e-7, 1.0000005, 2.5e-6, 99999.9999995, 1e5, 1e300, float("nan"), float("inf"), None,
              *[rng.uniform(-60, 60) for _ in range(2000)], *[k / 2e6 for k in range(-500, 500)],
              *[rng.uniform(-1e5, 1e5) for _ in range(2000)]]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(
        round6(F.col("x")).cast("string").alias("quick"), F.round("x", 6).cast("string").alias("slow"))
    assert df.where(~F.col("quick").eqNullSafe(F.col("slow"))).count() == 0


def test_affordable_hosts_counts(spark):
    hosts = spark.createDataFrame([(float(c),) for c in (1, 2, 2, 5)], "available_capacity_kw double")
    buyers = spark.createDataFrame([(1, 0.0), (2, 550000 * 2 / 1.2 + 1), (3, 1e9)], "buyer_id long, budget double")
    got = {r.buyer_id: (r.affordable_hosts, r.affordable_kw) for r in investing.affordable_hosts(buyers, hosts).collect()}
    assert got == {1: (0, 0.0), 2: (3, 5.0), 3: (4, 10.0)}


def test_leading_offers_hold_every_far_winner(spark):
    rng = random.Random(7)
    rows = [(i, float(rng.randint(4, 9)), float(rng.randint(3, 5)), float(rng.randint(5, 20)), rng.random() < .5) for i in range(200)]
    hosts = spark.createDataFrame(rows, "host_id long, price_per_kwh double, rating double, available_kwh double, renewable_cert boolean")
    kept = {r.host_id for r in investing.leading_offers(hosts).collect()}
    for top in (4.0, 6.0, 9.0):
        for need in (2.0, 12.0, 30.0):
            for green in (True, False):
                ok = [r for r in rows if r[1] <= top]
                if ok:
                    best = min(ok, key=lambda r: (-((100 - r[1] / top * 50) * .3 + r[2] * 5 + min(100, r[3] / need * 100) * .1
                                                    + (10 if r[4] and green else 0)), r[0]))
                    assert best[0] in kept
    assert len(kept) < 60


def random_offers(rng, n, correlated):
    """Few different values, so that equal prices, ratings and stocks meet; or stock that grows with the price."""
    rows = []
    for i in range(n):
        price = rng.choice([5.0, rng.randint(40, 90) / 10])
        stock = price * 3 if correlated else float(rng.randint(5, 20))
        rows.append((i, 12.9 + rng.uniform(-1, 1), 77.5 + rng.uniform(-1, 1), price, stock, rng.randint(30, 50) / 10, rng.random() < .5))
    return rows


@pytest.mark.parametrize("correlated", [False, True])
@pytest.mark.parametrize("direct", [False, True])
def test_price_match_equals_brute_force(spark, correlated, direct):
    rng = random.Random(3 + correlated)
    offers = random_offers(rng, 150, correlated)
    asks = [(i, 12.9 + rng.uniform(-1, 1), 77.5 + rng.uniform(-1, 1), rng.choice([3.0, 5.0, 7.3, 12.0]), float(rng.randint(2, 30)),
             rng.random() < .5) for i in range(40)]
    hosts = spark.createDataFrame(offers, "host_id long, latitude double, longitude double, price_per_kwh double, "
                                          "available_kwh double, rating double, renewable_cert boolean")
    buyers = spark.createDataFrame(asks, "buyer_id long, latitude double, longitude double, max_price double, "
                                         "required_kwh double, renewable_pref boolean")
    got = {r.buyer_id: r for r in investing.price_match(buyers, hosts, direct).collect()}
    for b, lat, lon, top, need, pref in asks:
        best = None
        for h, hlat, hlon, price, stock, rating, cert in offers:
            if price <= top:
                far = ((lat - hlat) ** 2 + (lon - hlon) ** 2) ** .5 * 111
                score = ((100 - price / top * 50) * .3 + rating * 5 + min(100, stock / need * 100) * .1
                         + (10 if cert and pref else 0) + max(0, 100 - far / 50 * 100) * .25)
                if best is None or score > best[0] + 1e-9:
                    best = (score, h)
        assert got[b].matched == (best is not None)
        if best:
            assert got[b].best_host_id == best[1] and abs(got[b].best_score - best[0]) < 1e-9
        assert got[b].alternatives == sum(o[3] <= top for o in offers)


def test_contenders_of_one_level_are_few(spark):
    """20,000 hosts with the same points at different costs, and as many at one cost."""
    n, k = 20_000, 5
    df = spark.range(n).select(
        F.col("id").alias("h_id"), F.lit("c").alias("h_city"), F.lit("s").alias("h_state"), F.lit(1.0).alias("roi_score"),
        F.lit(1.0).alias("risk_base"), F.lit(1.0).alias("demand_score"), F.lit(1.0).alias("location_score"))
    spread = df.withColumn("cost", F.pmod(F.xxhash64("h_id"), F.lit(1 << 40)).cast("double"))
    costs = {r.h_id: r.cost for r in spread.select("h_id", "cost").collect()}
    got = investing.contenders(spread, k).where("scope = 'any' and tolerance = 'low'").collect()
    assert len(got) < 1_000 and investing.contenders(df.withColumn("cost", F.lit(7.0)), k).count() == 9 * k
    kept = sorted((r.cost, r.h_id) for r in got)
    for budget in sorted(costs.values())[::1999]:
        want = sorted(h for h, c in costs.items() if c <= budget)[:k]
        assert sorted(h for c, h in kept if c <= budget)[:k] == want


@pytest.mark.parametrize("rim_rows", [500, 6])
def test_top_in_disks_equals_brute_force(spark, rim_rows):
    a, rows_a = scatter(spark, 30, 5, "a")
    b, rows_b = scatter(spark, 150, 6, "b")
    disks = a.withColumn("r", (F.col("a_id") % 4 * 25 + 10).cast("double"))
    points = b.withColumn("v", F.col("b_id") % 7)
    found = indisk.top_in_disks(disks, points, ("a_lat", "a_lon"), "r", ("b_lat", "b_lon"),
                                [F.desc("v"), F.asc("b_id")], 3, rim_rows)
    got = {}
    for r in found.collect():
        got.setdefault((r.a_lat, r.a_lon, r.r), set()).add(r.b_id)
    for x in rows_a:
        reach = x[0] % 4 * 25 + 10.0
        near = sorted((-(y[0] % 7), y[0]) for y in rows_b if km(x, y) <= reach)[:3]
        assert got.get((*x[1:], reach), set()) == {i for _, i in near}


def test_summary_copies_few_rows_of_a_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(radius, "MAX_PAIRS_PER_SLICE", 100)
    copied, cut = [], radius._cut
    monkeypatch.setattr(radius, "_cut", lambda *a: copied.append(cut(*a)) or copied[-1])
    rng = random.Random(3)
    industries, hosts = (spark.createDataFrame([(i, 12.9 + rng.random() / 100, 77.5 + rng.random() / 100) for i in range(n)],
                                               "id long, latitude double, longitude double") for n in (400, 600))
    made = investing.nearby_industries(hosts, industries, summary=True)
    assert {(r.pairs, r.h_id) for r in made.collect()} == {(400, i) for i in range(600)}
    # blocks follow the number of pairs; parts of ten rows copied every industry 60 times
    assert copied[0][0].count() <= 400 * 16 and radius.LONGEST_SIDE > 10


def test_summary_of_many_points_goes_through_pieces(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    lat, lon = rng.uniform(12, 13, 700), rng.uniform(77, 78, 700)
    points = [*radius._half_vectors(lat, lon), lat, lon, np.cos(np.radians(lat))]
    edge = np.sin(30 / 12742) ** 2
    disks = [c[:90] for c in points] + [np.full(90, v) for v in (30.0, edge * (1 - 1e-9) - 1e-20, edge * (1 + 1e-9) + 1e-20)]
    whole = radius.block_summary(points, disks)
    monkeypatch.setattr(radius, "PIECE", 64)
    count, least, total = radius.block_summary(points, disks)
    assert (count == whole[0]).all() and (least == whole[1]).all() and total == pytest.approx(whole[2], abs=1e-9)


def test_slices_grow_with_the_pairs_and_hold_no_long_side(spark, monkeypatch):
    monkeypatch.setattr(radius, "MAX_PAIRS_PER_SLICE", 100)
    monkeypatch.setattr(radius, "LONGEST_SIDE", 200)
    points = spark.range(401).select(F.col("id").alias("a_id"), F.when(F.col("id") < 400, 3).otherwise(4).alias("_level"))
    disks = spark.range(1200).select(F.col("id").alias("b_id"), F.when(F.col("id") < 600, 3).otherwise(4).alias("_d_level"))
    a, b, on = radius._slice_hot(points, disks, [("_level", "_d_level")])
    pairs = a.join(b, [a[p] == b[d] for p, d in on])
    assert pairs.select("a_id", "b_id").distinct().count() == pairs.count() == 400 * 600 + 600
    # parts of ten rows copied every point 60 times
    assert a.where("_level = 3").count() <= 400 * 20 and b.where("_d_level = 3").count() <= 600 * 20
    # one point with many disks: no slice of disks longer than the limit, up to the chance of a hash
    assert b.where("_d_level = 4").groupBy("_d_slice").count().agg(F.max("count")).first()[0] <= 300
