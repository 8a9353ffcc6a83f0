"""Processed tables: written under source and run, read back by newest run; user upserts."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning, validation
from ..operators.series import SeriesOrder, top_k_per_key
from ..plans import pipelines
from ..session import delete_folder, materialize, scratch_dir
from .csvfiles import TextTables, file_layouts


def _folder(path: str, source: str, run_ts: str) -> str:
    """Where a run of a source lies; characters that paths reserve are escaped as partition folders do it."""
    escaped = (re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", v) for v in (source, run_ts))
    return "{}/source={}/run_ts={}".format(path, *escaped)


def write_processed(df: DataFrame, path: str, source: str, run_ts: str, kind: str = "parquet") -> None:
    """One folder per source and run; earlier runs stay, a rerun replaces its own, also by no rows."""
    df.drop("source", "run_ts").write.mode("overwrite").option("header", True).format(kind).save(_folder(path, source, run_ts))


def processed_tables(spark: SparkSession, path: str) -> DataFrame:
    """All runs of all sources; ``source`` and ``run_ts`` as they were written, whatever they look like."""
    found = spark.read.option("basePath", path).option("mergeSchema", True).parquet(path)
    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("source", "run_ts") else f for f in found.schema])
    return spark.read.schema(text).option("basePath", path).parquet(path)


def newest(df: DataFrame, run: str = "run_ts") -> DataFrame:
    """Rows of the newest run. On a partition column only its folder is read."""
    return df.where(F.col(run) == df.agg(F.max(run)).scalar())


def read_latest(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Newest processed table of a source."""
    return newest(processed_tables(spark, path).where(F.col("source") == source))


def upsert_users(registrations: DataFrame, user: str, latest_first: list[Column]) -> DataFrame:
    """The last registration of every user."""
    return top_k_per_key(registrations, [user], latest_first, 1)


def _typed(df: DataFrame, kind: str) -> DataFrame:
    """Text columns of a contract as their declared types; canonical names."""
    df = validation.canonicalize_columns(df, kind)
    target = {"datetime": "timestamp_ntz", "int": "bigint"}
    casts = {n: F.col(f"`{n}`").try_cast(target.get(t, "double"))
             for n, t, *_ in validation.CONTRACTS.get(kind, []) if n in df.columns}
    return df.withColumns(casts) if casts else df


def _prepared(df: DataFrame, kind: str, capacity_kw: float, columns: list[str] | None) -> DataFrame:
    ts = "event_ts" if kind == "nsrdb" else "timestamp"
    if kind not in ("nsrdb", "meter") or ts not in df.columns:
        return df
    order = SeriesOrder(("source_file",), ts)
    numbers = cleaning.numeric_columns(df)
    chosen = numbers if columns is None else [c for c in numbers if c.lower() in {x.lower() for x in columns}]
    if kind == "nsrdb":
        return pipelines.solar_pipeline(df, order, capacity_kw, columns=chosen)[0]
    return pipelines.consumption_pipeline(df, order, columns=chosen)[0]


def _listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, bytes) of every file of the glob, empty ones too; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    sized = files.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("bytes"))
    # scans leave empty files out; the driver's own listing names them
    names = spark.createDataFrame([(re.sub("^file:///", "file:/", f),) for f in files.inputFiles()], "source_file string")
    return names.join(sized, "source_file", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).strip().splitlines()[0] if str(error).strip() else ''}"[:300]


def _process(tables: TextTables, kind: str, output: str, run_ts: str, capacity_kw: float,
             columns: list[str] | None) -> DataFrame:
    """(source_file, source, rows_input, rows_output) of the files of one kind, which is written on the way."""
    spark = tables.spark
    raw = tables.irradiance() if kind == "nsrdb" else tables.read([kind])
    place = scratch_dir(spark, f"raw-{kind}")
    try:
        _typed(raw, kind).write.parquet(place)
        table = spark.read.parquet(place)
        write_processed(_prepared(table, kind, capacity_kw, columns), output, kind, run_ts)
        seen = table.groupBy("source_file").agg(F.count("*").alias("rows_input"))
        own = spark.read.parquet(_folder(output, kind, run_ts))
        done = own.groupBy("source_file").agg(F.count("*").alias("rows_output"))
        counts = seen.join(done, "source_file", "left").withColumn("rows_output", F.coalesce("rows_output", F.lit(0)))
        return materialize(counts.withColumn("source", F.lit(kind)), "counts")
    finally:
        delete_folder(spark, place)


def _tables_of(spark: SparkSession, files: list[str], layouts: DataFrame) -> TextTables:
    """Named files alone; the names are escaped as in a URI."""
    return TextTables(spark, [unquote(f) for f in files], True, layouts.where(F.col("file").isin(files)))


def _faulty(spark: SparkSession, files: list[str], layouts: DataFrame, trial) -> list[tuple[str, str]]:
    """(file, message) of the files that fail on their own, found by halving the list."""
    try:
        trial(_tables_of(spark, files, layouts))
        return []
    except Exception as error:  # noqa: BLE001 - the ledger holds it
        if len(files) == 1:
            return [(files[0], _reason(error))]
    half = len(files) // 2
    return _faulty(spark, files[:half], layouts, trial) + _faulty(spark, files[half:], layouts, trial)


def batch_preprocess(spark: SparkSession, path: str | list[str], output: str, run_ts: str, capacity_kw: float = 5.0,
                     columns: list[str] | None = None) -> DataFrame:
    """Read, prepare and write all files of a glob; one summary row per file, whatever became of it.

    Files of one kind are one table keyed by file, so parallelism follows the data, not the
    number of files. The scaler is fitted on the whole table. ``columns`` names the numeric columns to prepare (all by
    default); for files of thousands of columns it keeps the plan small, and the others pass unchanged.

    Nothing that goes wrong ends the batch. A file without a readable line or without data rows is an error of its own, and
    one that cannot be decompressed keeps the lines before the fault, if any. When a kind fails as a whole, halving the
    list of its files finds those that fail on their own; they carry their message, the others are written together.
    """
    layouts = materialize(file_layouts(spark, path, tolerant=True), "layouts")
    tables = TextTables(spark, path, True, layouts)
    kinds = materialize(_kinds_of_files(spark, layouts, tables), "kinds")
    counted, failed = [], []
    for kind in tables.kinds:
        try:
            counted.append(_process(tables, kind, output, run_ts, capacity_kw, columns))
        except Exception as error:  # noqa: BLE001 - the ledger holds it
            place = scratch_dir(spark, f"trial-{kind}")
            files = sorted(r[0] for r in kinds.where(F.col("source") == kind).select("source_file").collect())
            wrong = _faulty(spark, files, layouts, lambda t: _process(t, kind, place, run_ts, capacity_kw, columns))
            delete_folder(spark, place)
            good = sorted(set(files) - {f for f, _ in wrong})
            try:
                if not wrong:  # only together they fail
                    raise error
                failed += wrong
                if good:
                    counted.append(_process(_tables_of(spark, good, layouts), kind, output, run_ts, capacity_kw, columns))
            except Exception as together:  # noqa: BLE001
                failed += [(f, _reason(together)) for f in good]
    empty = "source_file string, rows_input long, rows_output long, source string"
    counts = spark.createDataFrame([], empty)
    for part in counted:
        counts = counts.unionByName(part)
    errors = spark.createDataFrame(failed, "source_file string, message string")
    listed = _listing(spark, path)
    ledger = (listed.join(kinds, "source_file", "left").join(counts.drop("source"), "source_file", "left")
              .join(errors, "source_file", "left"))
    rows_in, rows_out = F.coalesce("rows_input", F.lit(0)), F.coalesce("rows_output", F.lit(0))
    return ledger.select(
        F.element_at(F.split("source_file", "/"), -1).alias("file"), F.coalesce("source", F.lit("unknown")).alias("source"),
        F.when(rows_in > 0, "success").otherwise("error").alias("status"),
        rows_in.alias("rows_input"), rows_out.alias("rows_output"), (rows_in - rows_out).alias("rows_removed"),
        F.coalesce("message", F.when(rows_in > 0, None).when(F.col("bytes") == 0, "empty file")
                   .when(F.col("source").isNull(), "no readable line").otherwise("no data rows")).alias("error"))


def _kinds_of_files(spark: SparkSession, layouts: DataFrame, tables: TextTables) -> DataFrame:
    """(source_file, source) of every file with a header."""
    kinds = spark.createDataFrame([(x.number, x.kind) for x in tables.layouts], "layout int, source string")
    return (tables.numbered_files.join(F.broadcast(kinds), "layout")
            .select(F.col("_file").alias("source_file"), "source"))
