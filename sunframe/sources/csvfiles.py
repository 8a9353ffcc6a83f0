"""Delimited text files of unknown dialect, read as one distributed table per kind.

One pass finds the layout of every file: where its header is, its delimiter, its encoding. The next one reads
lines, drops those up to the header by their place in the file, and takes fields apart. Both number lines inside the
split they come from, so nothing is sorted and it does not matter how files are split. Layouts are one short row per
file; only the distinct ones, as many as there are different headers, come to the driver.

Lines end with a line feed, with or without a carriage return before it; quoted fields stay on their line.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
DELIMITERS = [",", ";", "\t", "|"]
SAMPLE_LINES = 5
HEADER_SCAN = 25
HEADER_MARK = "year,month,day,hour,minute"
TIME_FIELDS = ["Year", "Month", "Day", "Hour", "Minute"]

#: The header is looked for in lines that begin this many bytes into a file at most.
HEAD_BYTES = 64 << 20


def _lines(spark: SparkSession, path: str | list[str], tolerant: bool = False) -> DataFrame:
    """(file, block, raw): lines as bytes, in order inside each split (block: where it begins in the file)."""
    text = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", tolerant).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("value"))


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """(start, end) of the consecutive rows of one split."""
    if not batch.num_rows:
        return []
    files = batch.column(0).dictionary_encode().indices.to_numpy()
    blocks = batch.column(1).to_numpy()
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    return list(zip(edges, edges[1:]))


def _numbered(batches):
    """Adds the place of each line in its split."""
    last, upto = None, 0
    for batch in batches:
        places = np.arange(batch.num_rows)
        for start, end in _runs(batch):
            split = batch.column(0)[start].as_py(), batch.column(1)[start].as_py()
            first = upto if split == last else 0
            places[start:end] += first - start
            last, upto = split, first + end - start
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], names=[*batch.schema.names, "place"])


def _split_heads(batches):
    """One row per split: its first lines, and whether all its text is UTF-8."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lines", pa.list_(pa.binary())), ("utf8", pa.bool_())])
    held = None

    def out():
        return pa.RecordBatch.from_pylist([held], schema=schema)

    for batch in batches:
        valid = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool)
        for start, end in _runs(batch):
            split = batch.column(0)[start].as_py(), batch.column(1)[start].as_py()
            if held is None or split != (held["file"], held["block"]):
                if held is not None:
                    yield out()
                held = {"file": split[0], "block": split[1], "lines": [], "utf8": True}
            held["utf8"] &= bool(valid[start:end].all())
            more = HEADER_SCAN + 1 - len(held["lines"])
            if more > 0 and split[1] < HEAD_BYTES:
                held["lines"] += batch.column(2)[start:min(end, start + more)].to_pylist()
    if held is not None:
        yield out()


def file_heads(spark: SparkSession, path: str | list[str], tolerant: bool = False) -> DataFrame:
    """(file, utf8, lines, offsets): the first 26 lines of every file that has any, and the bytes before each."""
    text = _lines(spark, path, tolerant).select("file", "block", F.col("value").cast("binary").alias("raw"),
                                                F.is_valid_utf8("value").alias("utf8"))
    splits = text.mapInArrow(_split_heads, "file string, block long, lines array<binary>, utf8 boolean")
    per_file = splits.groupBy("file").agg(F.bool_and("utf8").alias("utf8"), F.array_sort(F.collect_list(
        F.when(F.size("lines") > 0, F.struct("block", "lines")))).alias("parts"))
    raw = F.slice(F.flatten(F.transform("parts", lambda p: p.lines)), 1, HEADER_SCAN + 1)
    widths = F.transform("raw", lambda x: F.length(x).cast("long") + 1)
    before = F.transform(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: F.aggregate(
        F.slice(widths, 1, i), F.lit(0).cast("long"), lambda s, x: s + x))
    return per_file.withColumn("raw", raw).select(
        "file", "utf8", F.transform("raw", lambda x: _decoded(x, F.col("utf8"))).alias("lines"), before.alias("offsets"))


def _decoded(raw: Column, utf8: Column) -> Column:
    """Bytes of a line as text: UTF-8, or Latin-1 (which fits any bytes) if its file is not."""
    text = F.when(utf8, raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿|\r$", "")


def _occurrences(lines: Column, mark: str) -> Column:
    return F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))


def _best_delimiter(lines: Column) -> Column:
    """The candidate found in most of the sampled lines, and there most evenly, wins."""
    choice, best = F.lit(","), F.lit(0.0)
    for d in DELIMITERS:
        counts = _occurrences(lines, d)
        usual = F.array_max(counts)
        even = F.size(F.filter(counts, lambda n: (n == usual) & (n > 0))) / F.size(counts)
        choice = F.when(even > best, d).otherwise(choice)
        best = F.greatest(best, even)
    return choice


def detect_delimiter(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, delimiter) from the first five lines of each file; a comma when nothing fits."""
    return file_heads(spark, path).select("file", _best_delimiter(F.slice("lines", 1, SAMPLE_LINES)).alias("delimiter"))


def file_layouts(spark: SparkSession, path: str | list[str], tolerant: bool = False) -> DataFrame:
    """(file, utf8, delimiter, header, is_nsrdb, head_offsets): where the real header of each file is.

    It is the line with the five time columns, or else the first one that is not blank. ``head_offsets`` are the bytes
    before each line up to the header.
    """
    heads = file_heads(spark, path, tolerant)
    places = F.sequence(F.lit(0), F.size("lines") - 1)

    def first(test) -> Column:
        return F.get(F.filter(places, lambda i: test(F.element_at("lines", i + 1))), F.lit(0))

    marked = first(lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("")).contains(HEADER_MARK)
                   | F.replace(F.translate(F.lower(x), ";\t|", ",,,"), F.lit(" "), F.lit("")).contains(HEADER_MARK))
    found = heads.withColumn("marked", marked).withColumn(
        "at", F.coalesce("marked", first(lambda x: F.trim(x) != ""), F.lit(0)))
    sample = F.slice("lines", F.col("at") + 1, F.lit(SAMPLE_LINES))
    return found.select("file", "utf8", _best_delimiter(sample).alias("delimiter"),
                        F.trim(F.element_at("lines", F.col("at") + 1)).alias("header"),
                        F.col("marked").isNotNull().alias("is_nsrdb"),
                        F.slice("offsets", F.lit(1), F.col("at") + 1).alias("head_offsets"))


def column_names(header: str, delimiter: str) -> list[str | None]:
    """Names by position; None for columns without one. Repeated names are numbered."""
    fields = next(csv.reader([header], delimiter=delimiter), [])
    names, seen = [], {}
    for field in (f.strip().strip('"') for f in fields):
        at = seen[field.lower()] = seen.get(field.lower(), -1) + 1
        names.append((f"{field}.{at}" if at else field) if field else None)
    return names


class _Layout:
    def __init__(self, number: int, delimiter: str, header: str, is_nsrdb: bool):
        self.number, self.delimiter, self.names = number, delimiter, column_names(header, delimiter)
        self.kind = "nsrdb" if is_nsrdb else detect_source([n for n in self.names if n])
        self.is_nsrdb = is_nsrdb


class TextTables:
    """The files of a glob by kind (nsrdb, meter, weather, unknown). Reading a kind scans the files of the glob once."""

    def __init__(self, spark: SparkSession, path: str | list[str], tolerant: bool = False, layouts: DataFrame | None = None):
        self.spark, self.path, self.tolerant = spark, path, tolerant
        self.files = file_layouts(spark, path, tolerant) if layouts is None else layouts
        dialect = ["delimiter", "header", "is_nsrdb"]
        distinct = sorted(tuple(r) for r in self.files.select(*dialect).distinct().collect())  # one row per header in use
        self.layouts = [_Layout(i, *d) for i, d in enumerate(distinct)]
        numbered = spark.createDataFrame([(*d, i) for i, d in enumerate(distinct)],
                                         "delimiter string, header string, is_nsrdb boolean, layout int")
        self.numbered_files = self.files.join(F.broadcast(numbered), dialect).select(
            F.col("file").alias("_file"), "utf8", "head_offsets", "layout")

    @property
    def kinds(self) -> list[str]:
        return sorted({x.kind for x in self.layouts})

    def read(self, kinds: list[str] | None = None) -> DataFrame:
        """Lines of the kinds (all by default) as one table of strings and ``source_file``; names meet whatever their case.

        Rows with more fields than their header are skipped, short ones padded.
        """
        chosen = [x for x in self.layouts if kinds is None or x.kind in kinds]
        lines = (_lines(self.spark, self.path, self.tolerant)
                 .select("file", "block", F.col("value").cast("binary").alias("raw"))
                 .mapInArrow(_numbered, "file string, block long, raw binary, place long"))
        # one short row per file: as many as the listing that the driver holds for any read
        told = lines.join(F.broadcast(self.numbered_files), F.col("file") == F.col("_file"))
        # of a split's lines, those that belong to the head begin after its start (its first line is the first to do so)
        heads = F.size(F.filter("head_offsets", lambda o: (F.col("block") == 0) | (o > F.col("block"))))
        text = _decoded(F.col("raw"), F.col("utf8"))
        data = (told.where(F.col("layout").isin([x.number for x in chosen]) & (F.col("place") >= heads))
                .select(F.col("file").alias("source_file"), "layout", text.alias("line")).where(F.trim("line") != ""))
        width = max((len(x.names) for x in chosen), default=1)
        bare = F.regexp_replace("line", '"[^"]*"', "")
        parsed = fields = most = None
        for d in sorted({x.delimiter for x in chosen}):
            own = [x for x in chosen if x.delimiter == d]
            here = F.col("layout").isin([x.number for x in own])
            struct = F.from_csv("line", ", ".join(f"c{i} STRING" for i in range(width)), {"sep": d})
            count = F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) + 1
            parsed = F.when(here, struct) if parsed is None else parsed.when(here, struct)
            fields = F.when(here, count) if fields is None else fields.when(here, count)
        for x in chosen:
            here = F.col("layout") == x.number
            most = F.when(here, len(x.names)) if most is None else most.when(here, len(x.names))
        if not chosen:
            return data.where(F.lit(False)).select("source_file")
        rows = data.where(fields <= most).withColumn("c", parsed)
        columns: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        for x in chosen:
            for at, name in enumerate(x.names):
                if name:
                    columns.setdefault(name.lower(), (name, []))[1].append((x.number, at))
        out = []
        for name, places in columns.values():
            by_place: dict[int, list[int]] = {}
            for number, at in places:
                by_place.setdefault(at, []).append(number)
            value = None
            for at, numbers in by_place.items():
                here = F.col("layout").isin(numbers)
                value = F.when(here, F.col(f"c.c{at}")) if value is None else value.when(here, F.col(f"c.c{at}"))
            out.append(value.alias(name))
        return rows.select(*out, "source_file")

    def irradiance(self) -> DataFrame:
        """The nsrdb kind with ``event_ts``; columns whose every value is a number are doubles, others stay text."""
        text = self.read(["nsrdb"])
        have = {c.lower(): c for c in text.columns}
        times = [have[c.lower()] for c in TIME_FIELDS if c.lower() in have]
        rest = [c for c in text.columns if c not in times and c != "source_file"]
        odd = text.agg(*[F.count_if((F.trim(F.col(f"`{c}`")) != "") & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"n{i}")
                         for i, c in enumerate(rest)]).first() if rest else []
        numbers = {c for c, n in zip(rest, odd) if not n}
        typed = text.withColumns({c: F.col(f"`{c}`").try_cast("int" if c in times else "double")
                                  for c in text.columns if c in times or c in numbers})
        if len(times) < len(TIME_FIELDS):  # a table without its own time columns: the regular grid is the caller's choice
            return typed
        # the columns of the parts may come as 2020.0
        parts = [F.coalesce(F.col(f"`{c}`"), F.lit(None).cast("int")) for c in times]
        return typed.withColumn("event_ts", F.try_make_timestamp_ntz(*parts, F.lit(0)))


def read_tables(spark: SparkSession, path: str | list[str], tolerant: bool = False, layouts: DataFrame | None = None) -> dict[str, DataFrame]:
    """All files of a glob by kind (nsrdb, meter, weather, unknown), each with ``source_file``."""
    tables = TextTables(spark, path, tolerant, layouts)
    if not tables.layouts:
        raise FileNotFoundError(path)
    return {kind: tables.irradiance() if kind == "nsrdb" else tables.read([kind]) for kind in tables.kinds}


def read_csv_tolerant(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All files of a glob as strings plus ``source_file``.

    Delimiter and header are found per file; rows with too many fields are skipped, short rows
    padded; files that are not UTF-8 are read as Latin-1.
    """
    return TextTables(spark, path).read()


def read_nsrdb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Irradiance files with metadata lines before the header; adds ``event_ts`` and ``source_file``."""
    tables = TextTables(spark, path)
    if not any(x.is_nsrdb for x in tables.layouts):
        raise ValueError(f"no file with a {HEADER_MARK} header in {path}")
    return tables.irradiance()


def detect_source(columns: list[str]) -> str:
    """Kind of a table by its column names."""
    have = {c.lower() for c in columns}
    if have & {"ghi", "dni", "dhi", "clearsky_ghi"}:
        return "nsrdb"
    if have & {"active_power_kw", "active_energy_kwh", "power_kw"}:
        return "meter"
    if {"temperature", "humidity", "wind_speed"} <= have:
        return "weather"
    return "unknown"
