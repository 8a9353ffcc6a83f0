"""Queries over sources and sinks; files are written from the tables first, then read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..fixtures import view
from ..session import scratch_dir
from ..sources import csvfiles, jsonfiles, processed
from .registry import big, query, r


def _forecast_json(spark, sf):
    """One forecast document per device, its hours in time order; every third has no radiation."""
    df = view(spark, sf, "readings")
    hourly = df.groupBy("device_id", F.date_trunc("day", "event_ts").alias("day")).agg(
        F.min("event_ts").alias("event_ts"), F.avg("temperature").alias("t"), F.avg("humidity").alias("h"),
        F.avg("cloud_cover").alias("c"), F.avg("wind_speed").alias("w"), F.avg("power_kw").alias("p"))
    t = F.when(F.dayofmonth("day") % 4 != 0, F.col("t"))
    row = F.struct(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), t.alias("t"), "h", "c", "w", "p")
    docs = hourly.groupBy("device_id").agg(F.array_sort(F.collect_list(row)).alias("x"))  # one row per day
    body = F.struct(F.struct(
        F.col("x.time").alias("time"), F.col("x.t").alias("temperature_2m"), F.col("x.h").alias("relative_humidity_2m"),
        F.col("x.c").alias("cloud_cover"), F.col("x.w").alias("wind_speed_10m"),
        F.when(F.col("device_id") % 3 != 0, F.col("x.p")).alias("direct_radiation")).alias("hourly"))
    return docs.select("device_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("doc"))


_DAYS = """days AS (SELECT device_id, min(event_ts) AS event_ts, CASE WHEN day(min(event_ts)) % 4 <> 0 THEN avg(temperature) END AS t,
    avg(humidity) AS h, avg(cloud_cover) AS c, avg(wind_speed) AS w, avg(power_kw) AS p FROM readings
    GROUP BY device_id, date_trunc('day', event_ts))"""


@query("parse_forecast_json", f"""SELECT device_id, event_ts, {r('''coalesce(
    last_value(t IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY event_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(t IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY event_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))''', 'temperature')},
    {r('h', 'humidity')}, {r('c', 'cloud_cover')}, {r('w', 'wind_speed')},
    {r('CASE WHEN device_id % 3 <> 0 THEN p ELSE 0 END', 'irradiance')} FROM days""", "readings", _DAYS)
def _parse_forecast(spark, sf):
    return jsonfiles.parse_forecast_json(_forecast_json(spark, sf), "device_id", "doc")


@query("parse_irradiance_json", f"""SELECT device_id, strftime(hour_ts, '%Y%m%d%H') AS date, {r('v', 'irradiance_w_m2')} FROM (
    SELECT device_id, date_trunc('hour', event_ts) AS hour_ts, max(ghi) AS v FROM irradiance GROUP BY 1, 2)""", "irradiance")
def _parse_irradiance(spark, sf):
    hours = view(spark, sf, "irradiance").groupBy("device_id", F.date_format("event_ts", "yyyyMMddHH").alias("k")).agg(
        F.max("ghi").alias("v"))
    docs = hours.groupBy("device_id", F.substring("k", 1, 8).alias("day")).agg(  # at most 24 entries
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    body = F.struct(F.struct(F.struct(F.col("m").alias("ALLSKY_SFC_SW_DWN")).alias("parameter")).alias("properties"))
    return jsonfiles.parse_irradiance_json(docs.select("device_id", F.to_json(body).alias("doc")), "device_id", "doc")


@query("flatten_payload", f"""SELECT reading_id, CAST(device_id AS VARCHAR) AS device_id, 'solar_generation' AS measurement_type,
    {r('power_kw', 'value')}, 'kW' AS unit, {r('voltage', 'voltage')}, {r('current_a', 'current')},
    {r('temperature', 'temperature')}, {r('NULL', 'irradiance')} FROM readings""", "readings")
def _flatten_payload(spark, sf):
    df = view(spark, sf, "readings").withColumn("irradiance", F.lit(None).cast("double"))
    sent = jsonfiles.build_payload(df, "device_id", ["reading_id"], "power_kw", {
        "voltage": "voltage", "current": "current_a", "temperature": "temperature", "irradiance": "irradiance"})
    return jsonfiles.flatten_payload(sent, "payload", ["reading_id"])


@query("upsert_users", f"""SELECT user_id, registration_id, registered_at, {r('available_balance', 'available_balance')} FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY registered_at DESC, registration_id DESC) AS k FROM registrations)
    WHERE k = 1""", "registrations")
def _upsert(spark, sf):
    return processed.upsert_users(view(spark, sf, "registrations"), "user_id",
                                  [F.desc("registered_at"), F.desc("registration_id")])


@query("read_write_readings", f"""SELECT kind, {big('count(*)', 'rows')}, {r('sum(power_kw)', 'power_sum')}, {r('max(voltage)', 'max_voltage')}
    FROM readings, (SELECT unnest(['csv', 'json']) AS kind) GROUP BY kind""", "readings")
def _read_write(spark, sf):
    base = scratch_dir(spark, "readings")
    df = view(spark, sf, "readings").select(F.col("event_ts").alias("timestamp"), "power_kw", "voltage")
    schema = "timestamp TIMESTAMP_NTZ, power_kw DOUBLE, voltage DOUBLE"
    out = None
    for kind in ("csv", "json"):
        jsonfiles.write_readings(df, f"{base}/{kind}", kind)
        # lines of objects here; arrays need whole files
        back = (jsonfiles.read_readings(spark, f"{base}/{kind}", schema) if kind == "csv"
                else spark.read.schema(schema).json(f"{base}/{kind}"))
        part = back.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.sum("power_kw").alias("power_sum"),
                        F.max("voltage").alias("max_voltage"))
        out = part if out is None else out.unionByName(part)
    return out


_RUNS = ("20240101_000000", "20240102_000000")


@query("read_latest", f"""SELECT '{_RUNS[1]}' AS run_ts, {big('count(*)', 'rows')}, {r('sum(power_kw * 2)', 'power_sum')}
    FROM readings""", "readings")
def _read_latest(spark, sf):
    base = scratch_dir(spark, "processed")
    df = view(spark, sf, "readings")
    for i, run in enumerate(_RUNS):
        processed.write_processed(df.withColumn("power_kw", F.col("power_kw") * (i + 1)), base, "meter", run)
    back = processed.read_latest(spark, base, "meter")
    return back.groupBy("run_ts").agg(F.count("*").alias("rows"), F.sum("power_kw").alias("power_sum"))


@query("write_processed", f"""SELECT 'meter' AS source, run_ts, {big('count(*)', 'rows')} FROM readings,
    (SELECT unnest(['{_RUNS[0]}', '{_RUNS[1]}']) AS run_ts) GROUP BY run_ts""", "readings")
def _write_processed(spark, sf):
    base = scratch_dir(spark, "processed")
    df = view(spark, sf, "readings")
    for run in _RUNS:
        processed.write_processed(df, base, "meter", run)
    return processed.processed_tables(spark, base).groupBy("source", "run_ts").agg(F.count("*").alias("rows"))


_LEAD = ["Source,Location ID,City", "NSRDB,1234,-"]
_HEAD = ["Year", "Month", "Day", "Hour", "Minute", "GHI", "DNI", "DHI", "Temperature", "Site"]
#: What is wrong with a line: it equals a metadata line, has too many fields, or no time.
_FAULT = """CASE WHEN reading_id % 60 = 11 THEN 'meta' WHEN reading_id % 50 = 7 THEN 'long'
    WHEN reading_id % 40 = 3 THEN 'blank' ELSE 'none' END"""
_SITE = "CASE WHEN device_id % 3 = 0 THEN 'Zürich Süd' ELSE 'Basel' END"


def _text_files(spark, sf, label: str, sep=lambda part: ",", lead: list[str] = (), files: int = 32, dirty: bool = True):
    """Irradiance as delimited text: a folder ``part=n`` with one file for each remainder of the device, half of them Latin-1."""
    base = scratch_dir(spark, label)
    df = view(spark, sf, "irradiance").withColumns({
        "part": F.pmod(F.col("device_id"), F.lit(files)).cast("int"), "fault": F.expr(_FAULT if dirty else "'none'"),
        "site": F.expr(_SITE)})
    times = [F.when(F.col("fault") == "blank", "").otherwise(F.date_format("event_ts", f)) for f in ("yyyy", "MM", "dd", "HH", "mm")]
    fields = F.array(*times, *[F.col(c).cast("string") for c in ("ghi", "dni", "dhi", "temperature", "site")])
    fields = F.when(F.col("fault") == "long", F.concat(fields, F.array(F.lit("1"), F.lit("2")))).otherwise(fields)
    line = F.when(F.col("fault") == "meta", F.lit(_LEAD[1]))
    for mark in sorted({sep(i) for i in range(files)}):
        line = line.when(F.col("part").isin([i for i in range(files) if sep(i) == mark]), F.array_join(fields, mark))
    lines = (df.select("part", line.alias("value")).repartition(files, "part").sortWithinPartitions("part")
             .mapInPandas(_headed({i: [*lead, sep(i).join(_HEAD)] for i in range(files)}), "part int, value string"))
    for encoding, odd in (("UTF-8", 0), ("ISO-8859-1", 1)):
        # one column, written as it is
        (lines.where(F.col("part") % 2 == odd).write.mode("append").partitionBy("part").option("sep", "\x01").option("quote", "")
         .option("escape", "\x02").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("encoding", encoding).csv(base))
    return base


def _headed(leads: dict[int, list[str]]):
    """Puts the head of its file before the first line of each part."""
    def add(batches):
        last = None
        for pdf in batches:
            for part, own in pdf.groupby("part", sort=True):
                if part != last:
                    yield pd.DataFrame({"part": part, "value": leads[part]})
                    last = part
                yield own

    return add


def _read_back(df):
    """What a reader made of the dirty files."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.col("GHI").cast("double")).alias("ghi_sum"),
                  F.avg(F.col("Temperature").cast("double")).alias("mean_temperature"),
                  F.count_if(F.col("Minute").try_cast("int").isNull()).alias("without_time"),
                  F.count_if(F.col("Site") == "Zürich Süd").alias("umlauts"))


_READ_BACK = f"""SELECT {big("count(*) FILTER (fault <> 'long')", 'rows')}, {r("sum(ghi) FILTER (fault IN ('none', 'blank'))", 'ghi_sum')},
    {r("avg(temperature) FILTER (fault IN ('none', 'blank'))", 'mean_temperature')},
    {big("count(*) FILTER (fault IN ('meta', 'blank'))", 'without_time')},
    {big("count(*) FILTER (fault IN ('none', 'blank') AND device_id % 3 = 0)", 'umlauts')}
    FROM (SELECT *, {_FAULT} AS fault FROM irradiance)"""


@query("read_csv_tolerant", _READ_BACK, "irradiance")
def _read_csv(spark, sf):
    path = _text_files(spark, sf, "csv", lambda part: ",;\t|"[part % 4])
    return _read_back(csvfiles.read_csv_tolerant(spark, path))


@query("read_nsrdb", _READ_BACK, "irradiance")
def _read_nsrdb(spark, sf):
    return _read_back(csvfiles.read_nsrdb(spark, _text_files(spark, sf, "nsrdb", lead=_LEAD)))


@query("detect_delimiter", f"""SELECT substring(',;|', 1 + device_id % 32 % 3, 1) AS delimiter, {big('count(DISTINCT device_id % 32)', 'files')}
    FROM irradiance GROUP BY 1""", "irradiance")
def _detect_delimiter(spark, sf):
    path = _text_files(spark, sf, "delimiter", lambda part: ",;|"[part % 3], dirty=False)
    return csvfiles.detect_delimiter(spark, path).groupBy("delimiter").agg(F.count("*").alias("files"))


@query("batch_preprocess", f"""SELECT 'nsrdb' AS source, 'success' AS status, {big('count(*)', 'rows_input')}, {big('count(*)', 'rows_output')},
    {big('0', 'rows_removed')}, CAST(NULL AS VARCHAR) AS error FROM irradiance GROUP BY device_id % 8
    UNION ALL SELECT source, 'error', 0, 0, 0, error FROM
    (VALUES ('nsrdb', 'no data rows'), ('unknown', 'no readable line')) v(source, error) WHERE EXISTS (FROM irradiance)""", "irradiance")
def _batch_preprocess(spark, sf):
    path = _text_files(spark, sf, "raw", lead=_LEAD, files=8, dirty=False)
    head = spark.createDataFrame([("\n".join([*_LEAD, ",".join(_HEAD)]),)], "value string").coalesce(1)
    for name in ("head", "broken"):  # a file of nothing but its head, and one that says it is compressed but is not
        head.write.text(f"{path}/part={name}")
    _rename_only_file(spark, f"{path}/part=broken", "year.csv.gz")
    summary = processed.batch_preprocess(spark, f"{path}/*", scratch_dir(spark, "out"), "20240101_000000")
    return summary.drop("file")


def _rename_only_file(spark, folder: str, name: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(where):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(where, name))
