"""Streams over the readings, run to the end of the input and compared with their batch twins.

The table arrives in ``BATCHES`` batches by time, each reading up to ``LATEST`` minutes late, so state, late rows and
repeats cross batches; windows still open at the final watermark stay unwritten, as append mode prescribes, and the
SQL twins leave them out in the same way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import TABLES, VIEWS, view
from ..operators import models
from ..session import scratch_dir
from ..streaming import readings as streams
from .registry import big, query, r


BATCHES = 4
LATEST = 50  # minutes; less than the watermarks' hour, so no reading is too late
FILES = 8


def arrivals(spark, sf) -> str:
    """A folder of the events in order of their arrival: ``FILES`` files for each batch, one batch after the other."""
    events, folder = spark.read.parquet(f"{sf}/events.parquet"), scratch_dir(spark, "arrivals")
    arrival = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(LATEST * 60))
    timed = events.withColumn("_arrival", arrival)
    first, last = timed.agg(F.min("_arrival"), F.max("_arrival")).first()
    step = ((last or 0) - (first or 0)) // BATCHES + 1
    for batch in range(BATCHES):
        part = timed.where(F.coalesce(F.floor((F.col("_arrival") - (first or 0)) / step), F.lit(0)) == batch)
        part.drop("_arrival").repartition(FILES).write.mode("append").parquet(folder)
    return folder


def reading_stream(spark, sf):
    """The ``readings`` view over a stream of the events table."""
    path = f"{sf}/events.parquet"
    source = streams.open_files(spark, arrivals(spark, sf), spark.read.parquet(path).schema, files_per_batch=FILES)
    assert "events" in TABLES
    text = VIEWS["readings"].replace("FROM events", "FROM {events}")
    return streams.event_time(spark.sql(text, events=source), "event_ts")


_CLOSED = "(SELECT max(event_ts) - INTERVAL 1 HOUR FROM readings)"


@query("stream_decode", f"""SELECT device_id, {r('temperature * 10', 'ghi')}, {r('temperature', 'temperature')}, event_ts AS timestamp,
    CAST(NULL AS VARCHAR) AS raw FROM readings WHERE reading_id % 50 <> 0 UNION ALL SELECT device_id, NULL, NULL, NULL, 'broken' FROM readings
    WHERE reading_id % 50 = 0""", "readings")
def _decode(spark, sf):
    when = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct((F.col("temperature") * 10).alias("ghi"), "temperature", when.alias("timestamp")))
    sent = reading_stream(spark, sf).select("device_id", F.when(
        F.col("reading_id") % 50 == 0, "broken").otherwise(body).alias("payload"))
    return streams.run_to_end(streams.decode(sent, "payload", "device_id"), "decode")


@query("stream_dedup", f"""SELECT device_id, event_ts, {r('max(power_kw)', 'power_kw')} FROM readings GROUP BY 1, 2""", "readings")
def _dedup(spark, sf):
    twice = reading_stream(spark, sf).select("device_id", "event_ts", "power_kw", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.run_to_end(streams.dedup(twice.drop("col"), ["device_id"], "event_ts"), "dedup")


_BAD = """(power_kw < 0 OR power_kw > 6 OR voltage < 200 OR voltage > 260 OR current_a < 0 OR current_a > 100
    OR frequency < 49.5 OR frequency > 50.5 OR power_factor < 0.8 OR power_factor > 1)"""


@query("stream_validate", f"""SELECT sink, {big('count(*)', 'rows')}, {r('sum(power_kw)', 'power_sum')} FROM (
    SELECT power_kw, CASE WHEN {_BAD} THEN 'bad' ELSE 'good' END AS sink FROM readings) GROUP BY sink""", "readings")
def _validate(spark, sf):
    base = scratch_dir(spark, "quarantine")
    stream = reading_stream(spark, sf).withColumnRenamed("current_a", "current")
    streams.run_to_end(stream, "validate", each_batch=streams.quarantine_sink(
        f"{base}/good", f"{base}/bad", "solar_generation", 5.0))
    out = None
    for sink in ("good", "bad"):
        part = spark.read.parquet(f"{base}/{sink}").agg(
            F.lit(sink).alias("sink"), F.count("*").alias("rows"), F.sum("power_kw").alias("power_sum"))
        out = part if out is None else out.unionByName(part)
    return out


@query("stream_energy_tumbling", f"""SELECT date_trunc('hour', event_ts) AS hour_ts, device_id, {big('count(*)', 'readings')},
    {r('sum(power_kw) / 60', 'energy_kwh')}, {r('max(power_kw)', 'peak_kw')}, {r('avg(power_kw)', 'mean_kw')},
    {r('count(*) FILTER (WHERE power_kw > 0.01) / 60', 'producing_hours')} FROM readings GROUP BY 1, 2
    HAVING date_trunc('hour', event_ts) + INTERVAL 1 HOUR <= {_CLOSED}""", "readings")
def _tumbling(spark, sf):
    return streams.run_to_end(streams.energy_tumbling(reading_stream(spark, sf), "device_id", "event_ts", "power_kw"), "energy")


@query("stream_rolling_sliding", f"""SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, device_id, {r('avg(power_kw)', 'mean_kw')},
    {big('count(*)', 'readings')} FROM (SELECT device_id, power_kw,
        unnest([date_trunc('hour', event_ts) - to_hours(i) FOR i IN range(6)]) AS w FROM readings)
    GROUP BY w, device_id HAVING w + INTERVAL 6 HOUR <= {_CLOSED}""", "readings")
def _sliding(spark, sf):
    return streams.run_to_end(streams.rolling_sliding(reading_stream(spark, sf), "device_id", "event_ts", "power_kw"), "sliding")


@query("stream_sessions", f"""SELECT min(event_ts) AS session_start, max(event_ts) + INTERVAL 30 MINUTE AS session_end, device_id,
    {big('count(*)', 'readings')}, {r('max(power_kw)', 'peak_kw')} FROM (
      SELECT *, sum(opens) OVER (PARTITION BY device_id ORDER BY event_ts, reading_id) AS spell FROM (
        SELECT *, CASE WHEN event_ts >= lag(event_ts) OVER (PARTITION BY device_id ORDER BY event_ts, reading_id) + INTERVAL 30 MINUTE
                  THEN 1 ELSE 0 END AS opens FROM readings WHERE power_kw > 0.01))
    GROUP BY device_id, spell HAVING max(event_ts) + INTERVAL 30 MINUTE <=
        (SELECT max(event_ts) - INTERVAL 1 HOUR FROM readings WHERE power_kw > 0.01)""", "readings")
def _sessions(spark, sf):
    return streams.run_to_end(streams.sessions(reading_stream(spark, sf), "device_id", "event_ts", "power_kw"), "sessions")


_OUT = "count(*) FILTER (WHERE voltage < 200 OR voltage > 260)"


@query("stream_voltage_alert", f"""SELECT date_trunc('hour', event_ts) AS window_start, device_id, {big(_OUT, 'out_of_range')},
    {big('count(*)', 'readings')}, {r(f'{_OUT} / count(*) * 100', 'percentage')},
    CASE WHEN {_OUT} / count(*) * 100 > 10 THEN 'high' ELSE 'medium' END AS severity FROM readings GROUP BY 1, 2
    HAVING {_OUT} / count(*) * 100 > 5 AND date_trunc('hour', event_ts) + INTERVAL 1 HOUR <= {_CLOSED}""", "readings")
def _alert(spark, sf):
    return streams.run_to_end(streams.voltage_alert(reading_stream(spark, sf), "device_id", "event_ts", "voltage"), "alert")


@query("stream_enrich", f"""SELECT reading_id, device_id, {r('power_kw', 'power_kw')}, {r('capacity_kw', 'capacity_kw')}
    FROM readings JOIN device_registry USING (device_id)""", "readings device_registry")
def _enrich(spark, sf):
    stream = reading_stream(spark, sf).select("reading_id", "device_id", "power_kw")
    registry = view(spark, sf, "device_registry").select("device_id", "capacity_kw")
    return streams.run_to_end(streams.enrich(stream, registry, "device_id"), "enrich")


@query("stream_score", f"""SELECT {big('count(*)', 'rows')}, {big('sum(reading_id)', 'ids')}, true AS as_in_batch, true AS within_bounds
    FROM readings WHERE substr(md5(concat(reading_id, '|42')), 1, 8) < '33333333'""", "readings")
def _score(spark, sf):
    """Readings that the model has not seen, scored as they arrive and all at once."""
    inputs = ["temperature", "humidity", "cloud_cover"]
    table = models.split_train_test(view(spark, sf, "readings"), ["reading_id"])
    path = scratch_dir(spark, "stream-model")
    models.save_model(models.demand_gbt(table.where(~F.col("is_test")), inputs, "power_kw", 2), path)
    model = models.load_model(path)
    stream = models.split_train_test(reading_stream(spark, sf), ["reading_id"]).where("is_test").select("reading_id", *inputs)
    scored = streams.run_to_end(streams.score(stream, model, ["reading_id"]), "score")
    batch = models.predict(model, table.where("is_test").select("reading_id", *inputs)).select(
        "reading_id", F.col("prediction").alias("batch"))
    return scored.join(batch, "reading_id", "full").agg(
        F.count("*").alias("rows"), F.sum("reading_id").alias("ids"), F.bool_and(F.col("prediction").eqNullSafe(F.col("batch"))).alias("as_in_batch"),
        F.bool_and(F.col("prediction") >= 0).alias("within_bounds"))


@query("stream_ewma", f"""SELECT device_id, hour_ts, {r('mean_kw', 'mean_kw')},
    {r("list_reduce(list(mean_kw) OVER (PARTITION BY device_id ORDER BY hour_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: a * 0.5 + x * 0.5)", 'ewma_kw')}
    FROM (SELECT device_id, date_trunc('hour', event_ts) AS hour_ts, avg(power_kw) AS mean_kw FROM readings GROUP BY 1, 2
          HAVING date_trunc('hour', event_ts) + INTERVAL 1 HOUR <= {_CLOSED})""", "readings")
def _ewma(spark, sf):
    hourly = streams.energy_tumbling(reading_stream(spark, sf), "device_id", "event_ts", "power_kw")
    table = streams.run_to_end(hourly, "hours")
    again = streams.open_files(spark, streams.folder_of(table), table.schema)
    return streams.run_to_end(streams.ewma(again, "device_id", "hour_ts", "mean_kw"), "ewma")
