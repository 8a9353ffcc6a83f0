"""Streams of device readings: decode, check, aggregate, enrich, score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import solar
from ..operators import models, rules, validation
from ..session import scratch_dir

TELEMETRY = "ghi DOUBLE, temperature DOUBLE, timestamp STRING"
SESSION_GAP = "30 minutes"


def open_files(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A file stream; other sources (such as a message bus) join at ``decode``."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_to_end(stream: DataFrame, label: str, mode: str = "append",
               each_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Process everything available, exactly once, and return what the sink holds.

    Output, offsets and state live in shared storage, so the query restarts where it stopped.
    """
    spark = stream.sparkSession
    base = scratch_dir(spark, f"stream-{label}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if each_batch is not None:
        writer.foreachBatch(each_batch).start().awaitTermination()
        return None
    writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant, not a wall-clock timestamp."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def decode(messages: DataFrame, payload: str, device: str, schema: str = TELEMETRY) -> DataFrame:
    """JSON messages to typed rows; ``raw`` keeps the text of a message that does not parse."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "raw"}
    parsed = F.from_json(payload, f"{schema}, raw STRING", options)
    rows = messages.select(device, parsed.alias("m")).select(device, "m.*")
    when = F.col("timestamp").try_cast("timestamp")
    return rows.withColumn("raw", F.coalesce(
        "raw", F.when(when.isNull(), F.coalesce("timestamp", F.lit("missing timestamp"))))
    ).withColumn("timestamp", when)


def good_messages(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("raw").isNull()).drop("raw")


def bad_messages(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("raw").isNotNull())


def dedup(df: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of every (device, time) within the watermark."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])
    return df.dropDuplicates([*keys, ts])


def quarantine_sink(good_path: str, bad_path: str, kind: str, capacity_kw: float | None = None):
    """A batch handler that splits rows by the validation rules into two tables.

    Both tables carry the batch number, so a batch that is run again replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        flagged = (validation.row_flags(batch, kind, capacity_kw)
                   .withColumn("broken", F.size("broken_rules") > 0).persist())
        try:
            for path, part in ((good_path, flagged.where(~F.col("broken")).drop("broken_rules")),
                               (bad_path, flagged.where("broken"))):
                part.drop("broken").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            flagged.unpersist()

    return write


def energy_tumbling(df: DataFrame, device: str, ts: str, power: str, delay: str = "1 hour",
                    interval_hours: float = 1 / 60) -> DataFrame:
    """Energy summary per device and clock hour."""
    if df.isStreaming:
        df = df.withWatermark(ts, delay)
    out = rules.energy_summary(df, [F.window(ts, "1 hour").alias("w"), device], power, interval_hours)
    return out.select(F.col("w.start").alias("hour_ts"), device, "readings", "energy_kwh", "peak_kw", "mean_kw",
                      "producing_hours")


def rolling_sliding(df: DataFrame, device: str, ts: str, power: str, delay: str = "1 hour") -> DataFrame:
    """Six-hour mean per device, every hour."""
    if df.isStreaming:
        df = df.withWatermark(ts, delay)
    out = df.groupBy(F.window(ts, "6 hours", "1 hour").alias("w"), device).agg(
        F.avg(power).alias("mean_kw"), F.count("*").alias("readings"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), device,
                      "mean_kw", "readings")


def sessions(df: DataFrame, device: str, ts: str, power: str, gap: str = SESSION_GAP, delay: str = "1 hour") -> DataFrame:
    """Producing spells per device, closed by a quiet gap."""
    producing = df.where(F.col(power) > solar.PRODUCING_ABOVE_KW)
    if df.isStreaming:
        producing = producing.withWatermark(ts, delay)
    out = producing.groupBy(F.session_window(ts, gap).alias("w"), device).agg(
        F.count("*").alias("readings"), F.max(power).alias("peak_kw"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), device,
                      "readings", "peak_kw")


def voltage_alert(df: DataFrame, device: str, ts: str, voltage: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Voltage severity per device and window; only what needs attention."""
    if df.isStreaming:
        df = df.withWatermark(ts, delay)
    out = rules.voltage_anomaly(df, [F.window(ts, window).alias("w"), device], voltage)
    return out.where(F.col("severity") != "low").select(
        F.col("w.start").alias("window_start"), device, "out_of_range", "readings", "percentage", "severity")


def enrich(df: DataFrame, registry: DataFrame, device: str) -> DataFrame:
    """Readings with the registered capacity and place of their device; unknown devices stay."""
    return df.join(registry, device, "left")


def score(df: DataFrame, model: PipelineModel, keep: list[str]) -> DataFrame:
    """Forecasts from a saved model."""
    return models.predict(model, df).select(*keep, "prediction")


def folder_of(sink: DataFrame) -> str:
    """The folder a sink table was written to, for a stream that continues from it."""
    return sink.inputFiles()[0].rsplit("/", 1)[0]


def ewma(hours: DataFrame, device: str, hour: str, value: str, span: int = 3) -> DataFrame:
    """Exponential mean over hourly means, its level carried per device across batches.

    Reads the table of ``energy_tumbling``: a batch hands a device's state its newly closed
    hours, a few rows, never its readings.
    """
    alpha = 2 / (span + 1)

    def carry(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(hour)
        out = []
        for x in rows[value]:
            level = x if level is None else level * (1 - alpha) + x * alpha
            out.append(level)
        state.update((float(level),))
        yield rows.assign(ewma_kw=out)

    types = dict(hours.dtypes)
    schema = f"{device} {types[device]}, {hour} {types[hour]}, {value} double, ewma_kw double"
    return hours.select(device, hour, value).groupBy(device).applyInPandasWithState(
        carry, schema, "level double", "append", GroupStateTimeout.NoTimeout)
