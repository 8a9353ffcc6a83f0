from pyspark.sql import functions as F

from sunframe.sources import csvfiles, jsonfiles, processed


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


METER = "timestamp;active_power_kw;voltage_v\n"


def test_tolerant_reader(spark, tmp_path):
    put(tmp_path / "in/a.csv", METER + "2024-01-01 00:00:00;1.5;230\n2024-01-01 01:00:00;2.5;231;extra;more\n2024-01-01 02:00:00;3.5\n")
    put(tmp_path / "in/b.csv", "timestamp,active_power_kw,site\n2024-01-01 00:00:00,9,\"Zürich, Süd\"\n", "latin-1")
    got = {(r.source_file.split("/")[-1], r.timestamp): r for r in csvfiles.read_csv_tolerant(spark, str(tmp_path / "in")).collect()}
    assert len(got) == 3  # the row with too many fields is skipped, the short one stays
    assert got[("a.csv", "2024-01-01 02:00:00")].voltage_v is None
    assert got[("b.csv", "2024-01-01 00:00:00")].site == "Zürich, Süd"
    found = {r.file.split("/")[-1]: r.delimiter for r in csvfiles.detect_delimiter(spark, str(tmp_path / "in")).collect()}
    assert found == {"a.csv": ";", "b.csv": ","}


def nsrdb(n):
    lines = ["Source,Location ID,City", "NSRDB,42,-", "Year,Month,Day,Hour,Minute,GHI,DNI,DHI,Air Temperature"]
    lines += [f"2020,1,{1 + i // 24},{i % 24},30,{i % 7 * 100},{i % 5 * 90},{i % 3 * 50},{10 + i % 9}" for i in range(n)]
    return "\n".join(lines) + "\n"


def test_nsrdb_reader_skips_metadata(spark, tmp_path):
    put(tmp_path / "in/a.csv", nsrdb(48))
    df = csvfiles.read_nsrdb(spark, str(tmp_path / "in"))
    assert df.count() == 48 and dict(df.dtypes)["GHI"] == "double"
    assert str(df.agg(F.max("event_ts")).first()[0]) == "2020-01-02 23:30:00"


def test_batch_preprocess_mixes_kinds(spark, tmp_path):
    put(tmp_path / "in/sun.csv", nsrdb(60))
    put(tmp_path / "in/meter.csv", "timestamp,active_power_kw,voltage_v\n" + "".join(
        f"2024-01-01 {h:02d}:00:00,{'' if h == 3 else h},{220 + h}\n" for h in range(24)))
    put(tmp_path / "in/other.csv", "a,b\n1,2\n")
    put(tmp_path / "in/empty.csv", "timestamp,active_power_kw\n")
    out = processed.batch_preprocess(spark, str(tmp_path / "in"), str(tmp_path / "out"), "r1")
    got = {r.file: (r.source, r.status, r.rows_input, r.rows_output) for r in out.collect()}
    assert got["sun.csv"] == ("nsrdb", "success", 60, 60)
    assert got["meter.csv"] == ("meter", "success", 24, 24)
    assert got["other.csv"] == ("unknown", "success", 1, 1)
    assert got["empty.csv"][1:3] == ("error", 0)


def test_latest_run_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)], "u long, at long, x double")
    for run in ("r1", "r2"):
        processed.write_processed(df.withColumn("x", F.col("x") * int(run[1])), str(tmp_path / "p"), "meter", run)
    assert processed.read_latest(spark, str(tmp_path / "p"), "meter").agg(F.sum("x")).first()[0] == 12.0
    assert {(r.u, r.x) for r in processed.upsert_users(df, "u", [F.desc("at")]).collect()} == {(1, 2.0), (2, 3.0)}


def test_readings_as_json_array(spark, tmp_path):
    put(tmp_path / "x.json", '[{"timestamp": "2024-01-01T00:00:00", "power_kw": 1.5}, {"timestamp": "2024-01-01T01:00:00", "power_kw": 2.0}]')
    df = jsonfiles.read_readings(spark, str(tmp_path / "x.json"))
    assert df.agg(F.sum("power_kw")).first()[0] == 3.5


def test_detect_source():
    assert csvfiles.detect_source(["GHI", "x"]) == "nsrdb"
    assert csvfiles.detect_source(["Power_kW"]) == "meter"
    assert csvfiles.detect_source(["temperature", "humidity", "wind_speed"]) == "weather"
    assert csvfiles.detect_source(["temperature"]) == "unknown"


def _nsrdb(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    head = "Source,Location ID\nX,1\nYear,Month,Day,Hour,Minute,GHI\n"
    path.write_text(head + "".join(rows))


def test_rows_do_not_depend_on_splits(spark, tmp_path):
    rows = [f"2020,1,{1 + i % 28},{i % 24},0,{i}\n" if i % 10 else f",,,,,{i}\n" for i in range(4000)]
    rows[7] = "2020,1,1,1,0,5,6,7\n"  # too long: skipped
    _nsrdb(tmp_path / "in" / "a.csv", rows)
    counts = []
    for size in ("128m", "20000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = csvfiles.read_nsrdb(spark, str(tmp_path / "in"))
            counts.append((df.count(), df.where("event_ts is null").count()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert counts == [(3999, 400)] * 2


def test_batch_counts_by_path_and_own_run(spark, tmp_path):
    for folder, n in (("s1", 30), ("s2", 20)):
        _nsrdb(tmp_path / "in" / folder / "year.csv", [f"2020,1,1,{i % 24},{i},{i}\n" for i in range(n)])
    for run in ("r2", "r2", "r1"):
        out = processed.batch_preprocess(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), run).collect()
        assert sorted((r.file, r.rows_input, r.rows_output) for r in out) == [("year.csv", 20, 20), ("year.csv", 30, 30)]


def dirty_file(lead, n, encoding):
    """A file, and what its rows are: text, blank times, too many fields, a row that equals a metadata line, CRLF ends."""
    lines, want = [*lead, "Year,Month,Day,Hour,Minute,GHI,Site"], []
    for i in range(n):
        if i % 9 == 4 and lead:
            lines.append(lead[1])
            want.append((None, None, None))
        elif i % 7 == 3:
            lines.append(f"2020,1,1,1,1,{i},x,y,z")
        elif i % 5 == 2:
            lines.append(f",,,,,{i},Zürich {i}")
            want.append((None, float(i), f"Zürich {i}"))
        else:
            lines.append(f"2020,2,{1 + i % 28},{i % 24},30,{i},\"Köln, {i}\"")
            want.append((f"2020-02-{1 + i % 28:02d} {i % 24:02d}:30:00", float(i), f"Köln, {i}"))
    return "\r\n".join(lines).encode(encoding) + b"\r\n", want


def test_dirty_irradiance_files_under_two_split_sizes(spark, tmp_path):
    want = []
    for name, lead, encoding in (("a.csv", ["Source,Location", "NSRDB,42", "", "Zürich,notes"], "utf-8"),
                                 ("b.csv", ["Source,Location", "NSRDB,43", "x,y"], "latin-1"), ("c.csv", [], "latin-1")):
        data, rows = dirty_file(lead, 70, encoding)
        (tmp_path / name).write_bytes(data)
        want += [(name, *r) for r in rows]
    for size in ("128m", "900", "37"):  # the smallest cuts the heads themselves
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = csvfiles.read_nsrdb(spark, str(tmp_path))
            assert dict(df.dtypes)["Site"] == "string" and dict(df.dtypes)["GHI"] == "double"
            got = [(r.source_file.rsplit("/", 1)[-1], r.event_ts and str(r.event_ts), r.GHI, r.Site) for r in df.collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        # a data row that equals a metadata line stays, as a row without numbers
        assert sorted(got, key=repr) == sorted(want, key=repr), size


def test_names_meet_across_layouts(spark, tmp_path):
    put(tmp_path / "a.csv", "GHI;Note;;GHI\n1;x;skip;2\n")
    put(tmp_path / "b.csv", "note|ghi\ny|3\n\n")
    put(tmp_path / "c.csv", "")
    got = csvfiles.read_csv_tolerant(spark, str(tmp_path)).drop("source_file")
    assert sorted(tuple(r.asDict()[c] for c in ("GHI", "Note", "GHI.1")) for r in got.collect()) == [("1", "x", "2"), ("3", "y", None)]


def test_ledger_lists_every_file(spark, tmp_path, monkeypatch):
    for i in range(8):
        put(tmp_path / f"in/sun{i}.csv", nsrdb(30 + i))
    put(tmp_path / "in/empty.csv", "")
    put(tmp_path / "in/head.csv", nsrdb(0))
    put(tmp_path / "in/broken.csv.gz", "this is not compressed\n")
    real = processed._prepared

    def fails_on_one(df, kind, *args):
        if df.where(F.col("source_file").endswith("sun3.csv")).count():
            raise ArithmeticError("sun3 breaks the pipeline")
        return real(df, kind, *args)

    monkeypatch.setattr(processed, "_prepared", fails_on_one)
    out = processed.batch_preprocess(spark, str(tmp_path / "in"), str(tmp_path / "out"), "01").collect()
    got = {r.file: (r.source, r.status, r.rows_input, r.rows_output, r.error) for r in out}
    want = {f"sun{i}.csv": ("nsrdb", "success", 30 + i, 30 + i, None) for i in range(8) if i != 3}
    want |= {"sun3.csv": ("nsrdb", "error", 0, 0, "ArithmeticError: sun3 breaks the pipeline"),
             "empty.csv": ("unknown", "error", 0, 0, "empty file"), "head.csv": ("nsrdb", "error", 0, 0, "no data rows"),
             "broken.csv.gz": ("unknown", "error", 0, 0, "no readable line")}
    assert got == want
    back = processed.read_latest(spark, str(tmp_path / "out"), "nsrdb")
    assert back.count() == sum(30 + i for i in range(8) if i != 3) and back.select("run_ts").first()[0] == "01"


def test_rerun_without_rows_replaces_its_run(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0)], "u long, x double")
    for rows in (df, df.where("false")):
        processed.write_processed(rows, str(tmp_path / "p"), "meter", "2024-01-01 00:00:00")
    assert processed.processed_tables(spark, str(tmp_path / "p")).count() == 0


def test_named_columns_of_a_wide_file(spark, tmp_path):
    head = "timestamp,active_power_kw," + ",".join(f"x{i}" for i in range(300))
    put(tmp_path / "in/wide.csv", head + "\n" + "".join(
        f"2024-01-01 {h:02d}:00:00,{h}," + ",".join(str(i + h) for i in range(300)) + "\n" for h in range(24)))
    out = processed.batch_preprocess(spark, str(tmp_path / "in"), str(tmp_path / "out"), "r", columns=["active_power_kw"])
    assert [(r.status, r.rows_output) for r in out.collect()] == [("success", 24)]
