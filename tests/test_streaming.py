"""A stream over several files equals its batch twin; late and repeated rows behave as documented."""

from pyspark.sql import functions as F

from sunframe.fixtures import view
from sunframe.streaming import readings as streams


def folder(spark, sf, tmp_path, extra=None, parts=3):
    """The readings in event order as one file per step, then the extra rows."""
    df = streams.event_time(view(spark, sf, "readings"), "event_ts").withColumn(
        "part", F.ntile(parts).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("event_ts")))
    path = str(tmp_path / "in")
    for i in range(1, parts + 1):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    if extra is not None:
        extra(df.drop("part")).coalesce(1).write.mode("append").parquet(path)
    return path, df.drop("part")


def opened(spark, path, df):
    return streams.open_files(spark, path, df.schema, files_per_batch=1)


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_tumbling_equals_batch_and_drops_late_rows(spark, sf, tmp_path):
    path, df = folder(spark, sf, tmp_path, lambda d: d.orderBy("event_ts").limit(5))
    got = streams.run_to_end(streams.energy_tumbling(opened(spark, path, df), "device_id", "event_ts", "power_kw"), "t")
    closed = df.agg((F.max("event_ts") - F.expr("INTERVAL 1 HOUR")).alias("m")).first().m
    want = streams.energy_tumbling(df, "device_id", "event_ts", "power_kw").where(
        F.col("hour_ts") + F.expr("INTERVAL 1 HOUR") <= F.lit(closed))
    r = lambda d: rows(d.withColumns({c: F.round(c, 6) for c in ("energy_kwh", "peak_kw", "mean_kw", "producing_hours")}))
    assert r(got) == r(want)  # the five late rows changed nothing


def test_dedup_across_batches(spark, sf, tmp_path):
    path, df = folder(spark, sf, tmp_path, lambda d: d.orderBy(F.desc("event_ts")).limit(1))
    got = streams.run_to_end(streams.dedup(opened(spark, path, df), ["device_id"], "event_ts"), "d")
    assert got.count() == df.count()


def test_quarantine_splits_all_rows(spark, sf, tmp_path):
    path, df = folder(spark, sf, tmp_path)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    streams.run_to_end(opened(spark, path, df), "v", each_batch=streams.quarantine_sink(good, bad, "solar_generation", 5.0))
    n_good, n_bad = spark.read.parquet(good).count(), spark.read.parquet(bad).count()
    assert n_good + n_bad == df.count() and n_bad > 0


def test_ewma_state_survives_batches(spark, tmp_path):
    hours = [(1, f"2024-01-01 {h:02d}:00:00", float(h)) for h in range(6)]
    path = str(tmp_path / "hours")
    for part in (hours[:3], hours[3:]):
        spark.createDataFrame(part, "device_id long, hour_ts string, mean_kw double").withColumn(
            "hour_ts", F.col("hour_ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    stream = streams.open_files(spark, path, "device_id long, hour_ts timestamp, mean_kw double", files_per_batch=1)
    got = [r.ewma_kw for r in streams.run_to_end(streams.ewma(stream, "device_id", "hour_ts", "mean_kw"), "e").orderBy("hour_ts").collect()]
    level, want = None, []
    for h in range(6):
        level = float(h) if level is None else level * 0.5 + h * 0.5
        want.append(level)
    assert got == want


def test_decode_keeps_broken_messages(spark):
    sent = spark.createDataFrame([("a", '{"ghi":500,"temperature":25,"timestamp":"2024-01-17T12:00:00Z"}'), ("b", "{oops"),
                                  ("c", '{"ghi":1,"timestamp":"never"}')], "device string, payload string")
    made = streams.decode(sent, "payload", "device")
    assert {r.device for r in streams.bad_messages(made).collect()} == {"b", "c"}
    good = streams.good_messages(made).collect()
    assert len(good) == 1 and good[0].ghi == 500.0 and good[0].timestamp is not None
