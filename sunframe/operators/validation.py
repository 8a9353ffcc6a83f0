"""Data contracts and validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import SeriesOrder

# Fixed values: (column, type, unit, minimum, maximum) of each data contract.
CONTRACTS: dict[str, list[tuple[str, str, str, float | None, float | None]]] = {
    "nsrdb": [
        ("Year", "int", "year", 1998, 2023), ("Month", "int", "month", 1, 12),
        ("Day", "int", "day", 1, 31), ("Hour", "int", "hour", 0, 23), ("Minute", "int", "minute", 0, 59),
        ("Latitude", "float", "degrees", -90, 90), ("Longitude", "float", "degrees", -180, 180),
        ("Elevation", "float", "meters", -300, 8850),
        ("GHI", "float", "W/m2", 0, 1500), ("DNI", "float", "W/m2", 0, 1500),
        ("DHI", "float", "W/m2", 0, 1500), ("GHIUncertainty", "float", "percent", 0, 100),
        ("DNIUncertainty", "float", "percent", 0, 100), ("DHIUncertainty", "float", "percent", 0, 100),
        ("POA_Global", "float", "W/m2", 0, 1500), ("POA_Direct", "float", "W/m2", 0, 1500),
        ("POA_Diffuse", "float", "W/m2", 0, 1500), ("Temperature", "float", "degC", -40, 60),
        ("Pressure", "float", "mb", 800, 1100), ("RelativeHumidity", "float", "percent", 0, 100),
        ("Precipitable Water", "float", "cm", 0, 10), ("WindSpeed", "float", "m/s", 0, 30),
        ("WindDirection", "float", "degrees", 0, 360), ("ClearSky GHI", "float", "W/m2", 0, 1500),
        ("ClearSky DNI", "float", "W/m2", 0, 1500), ("ClearSky DHI", "float", "W/m2", 0, 1500),
        ("Dew Point", "float", "degC", -40, 40), ("Solar Zenith Angle", "float", "degrees", 0, 180),
    ],
    "meter": [
        ("timestamp", "datetime", "", None, None), ("active_energy_kwh", "float", "kWh", 0, 1000),
        ("active_power_kw", "float", "kW", 0, 100), ("reactive_power_kvar", "float", "kVAR", 0, 100),
        ("apparent_power_kva", "float", "kVA", 0, 100), ("power_factor", "float", "", 0, 1),
        ("voltage_v", "float", "V", 190, 260), ("current_a", "float", "A", 0, 100),
        ("frequency_hz", "float", "Hz", 49.5, 50.5), ("data_quality_flag", "int", "", 0, 1),
        ("estimated_flag", "int", "", 0, 1),
    ],
    "weather": [
        ("timestamp", "datetime", "", None, None), ("temperature_c", "float", "degC", -40, 60),
        ("humidity_percent", "float", "percent", 0, 100), ("wind_speed_ms", "float", "m/s", 0, 50),
        ("pressure_mb", "float", "mb", 800, 1100), ("cloud_cover_percent", "float", "percent", 0, 100),
    ],
}

# Other header spellings of the solar contract columns, in order of preference.
ALIASES: dict[str, list[str]] = {
    "GHI": ["Global Horizontal Irradiance", "ghi"],
    "DNI": ["Direct Normal Irradiance", "dni"],
    "DHI": ["Diffuse Horizontal Irradiance", "dhi"],
    "Temperature": ["Air Temperature", "temp", "temperature_c"],
    "Pressure": ["Atmospheric Pressure", "press"],
    "RelativeHumidity": ["Relative Humidity", "humidity", "rh"],
    "WindSpeed": ["Wind Speed", "wind_speed", "ws"],
    "WindDirection": ["Wind Direction", "wind_dir"],
}

# Fixed values: (minimum, maximum) per field and kind of data.
RULES: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "solar_generation": {
        "power_kw": (0, None), "energy_kwh": (0, None), "voltage": (200, 260), "current": (0, 100),
        "frequency": (49.5, 50.5), "power_factor": (0.8, 1.0), "temperature": (-20, 60),
    },
    "consumption": {
        "power_kw": (0, 50), "energy_kwh": (0, None), "voltage": (200, 260), "current": (0, 100),
        "frequency": (49.5, 50.5), "power_factor": (0.8, 1.0),
    },
    "weather": {
        "temperature": (-20, 60), "humidity": (0, 100), "wind_speed": (0, 50),
        "irradiance": (0, 1400), "cloud_cover": (0, 100),
    },
}
CAPACITY_OVERAGE = 1.2
NIGHT_POWER_KW = 0.1

_SPARK_TYPE = {"int": T.LongType(), "float": T.DoubleType(), "datetime": T.TimestampType(),
               "string": T.StringType()}
_ACCEPTS = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType, T.IntegerType, T.LongType),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "string": (T.StringType,),
}


def contract_schema(source: str) -> T.StructType:
    """The contract as a Spark schema; unit and range sit in the field metadata."""
    return T.StructType([
        T.StructField(n, _SPARK_TYPE[t], True, {"unit": u, "min": lo, "max": hi, "required": True})
        for n, t, u, lo, hi in CONTRACTS[source]])


def check_columns(df: DataFrame, source: str, skip_missing: bool = False) -> DataFrame:
    """One row per column of the contract or the table: ok, missing or extra, and whether it fails."""
    wanted = [c[0] for c in CONTRACTS[source]]
    have = set(df.columns)
    rows = [(c, "ok" if c in have else "missing", c not in have and not skip_missing) for c in wanted]
    rows += [(c, "extra", False) for c in df.columns if c not in wanted]
    return df.sparkSession.createDataFrame(rows, "column_name string, status string, is_error boolean")


def check_types(df: DataFrame, source: str) -> DataFrame:
    """Per contract column present as text: how many values do not parse as the declared type;
    for typed columns whether the type fits; a missing field is reported as such."""
    types = {f.name: f.dataType for f in df.schema}
    counted, fixed = {}, []
    for name, kind, *_ in CONTRACTS[source]:
        if name not in types:
            fixed.append((name, kind, "missing", 0))
        elif kind != "string" and isinstance(types[name], T.StringType):
            parsed = F.col(f"`{name}`").try_cast(_SPARK_TYPE[kind])
            counted[name] = (kind, F.count_if(parsed.isNull() & F.col(f"`{name}`").isNotNull()))
        else:
            fits = isinstance(types[name], _ACCEPTS[kind])
            fixed.append((name, kind, "ok" if fits else "wrong type", 0))
    spark = df.sparkSession
    schema = "column_name string, expected string, status string, bad_values long"
    out = spark.createDataFrame(fixed, schema)
    if counted:
        wide = df.agg(*[expr.alias(n) for n, (_, expr) in counted.items()])
        rows = F.explode(F.array(*[F.struct(
            F.lit(n).alias("column_name"), F.lit(kind).alias("expected"),
            F.when(F.col(f"`{n}`") > 0, "wrong type").otherwise("ok").alias("status"),
            F.col(f"`{n}`").alias("bad_values")) for n, (kind, _) in counted.items()]))
        out = out.unionByName(wide.select(rows.alias("r")).select("r.*"))
    return out


def range_counts(df: DataFrame, limits: dict[str, tuple[float | None, float | Column | None]],
                 by: list[str] | None = None) -> DataFrame:
    """Values below and above the limits per column, from one aggregate over one scan."""
    by = by or []
    cols = [c for c in limits if c in df.columns]
    aggs = []
    for i, c in enumerate(cols):
        low, high = limits[c]
        x = F.col(f"`{c}`")
        aggs.append((F.count_if(x < low) if low is not None else F.lit(0).cast("long")).alias(f"b{i}"))
        aggs.append((F.count_if(x > high) if high is not None else F.lit(0).cast("long")).alias(f"a{i}"))
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    cells = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"b{i}").alias("below_min"),
        F.col(f"a{i}").alias("above_max")) for i, c in enumerate(cols)]))
    return wide.select(*by, cells.alias("r")).select(*by, "r.*")


def contract_ranges(df: DataFrame, source: str) -> DataFrame:
    """Range violations against a contract; missing values do not count."""
    return range_counts(df, {n: (lo, hi) for n, _, _, lo, hi in CONTRACTS[source]
                             if lo is not None or hi is not None})


def rule_limits(kind: str, capacity_kw: float | None = None) -> dict[str, tuple]:
    limits = dict(RULES[kind])
    if kind == "solar_generation" and capacity_kw:
        limits["power_kw"] = (limits["power_kw"][0], capacity_kw * CAPACITY_OVERAGE)
    return limits


def validate_ranges(df: DataFrame, kind: str, capacity_kw: float | None = None,
                    by: list[str] | None = None) -> DataFrame:
    """Violations of the validation rules; a given capacity caps solar power at 1.2 times it."""
    return range_counts(df, rule_limits(kind, capacity_kw), by)


def canonicalize_columns(df: DataFrame, source: str = "nsrdb") -> DataFrame:
    """Rename known header variations to contract names, ignoring case."""
    if source.lower() != "nsrdb":
        return df
    lower = {c.lower(): c for c in df.columns}
    renames = {}
    for name, others in ALIASES.items():
        hit = next((lower[a.lower()] for a in [name, *others] if a.lower() in lower), None)
        if hit is not None:
            renames[hit] = name
    return df.withColumnsRenamed(renames)


def validate_temporal(df: DataFrame, order: SeriesOrder, arrival: str) -> DataFrame:
    """Per series: rows older than the row that arrived before them, and repeated timestamps."""
    if order.resolve(df).long:
        steps = _arrival_steps(df, order, arrival)
    else:
        w = Window.partitionBy(*order.keys).orderBy(arrival)
        steps = df.select(*order.keys, (F.col(order.ts) < F.lag(order.ts).over(w)).alias("back"))
        steps = steps.groupBy(*order.keys).agg(F.count_if("back").alias("order_violations"))
    # one row per (key, timestamp) first, so a hot key is combined before it is counted
    distinct = (df.groupBy(*order.keys, order.ts).count()
                .groupBy(*order.keys).agg(F.sum(F.col("count") - 1).alias("duplicate_timestamps")))
    match = [steps[k].eqNullSafe(distinct[k]) for k in order.keys]
    return steps.join(distinct, match).select(
        *[steps[k] for k in order.keys], "order_violations", "duplicate_timestamps")


def _arrival_steps(df: DataFrame, order: SeriesOrder, arrival: str) -> DataFrame:
    """Backward steps of long series, compared inside arrival ranges and across their borders."""
    block = F.floor(F.col(arrival) / order.block_rows).alias("_block")
    part = df.select(*order.keys, arrival, order.ts, block)
    w = SeriesOrder((*order.keys, "_block"), arrival).plain_window()
    inner = (part.select(*order.keys, (F.col(order.ts) < F.lag(order.ts).over(w)).alias("back"))
             .groupBy(*order.keys).agg(F.count_if("back").alias("n")))
    edges = part.groupBy(*order.keys, "_block").agg(
        F.min_by(order.ts, arrival).alias("first"), F.max_by(order.ts, arrival).alias("last"))
    wb = SeriesOrder(order.keys, "_block").plain_window()
    outer = (edges.select(*order.keys, (F.col("first") < F.lag("last").over(wb)).alias("back"))
             .groupBy(*order.keys).agg(F.count_if("back").alias("n")))
    return inner.unionByName(outer).groupBy(*order.keys).agg(F.sum("n").alias("order_violations"))


def night_generation(df: DataFrame, ts: str, power: str, sunrise: float = 6, sunset: float = 18,
                     by: list[str] | None = None) -> DataFrame:
    """Readings over 0.1 kW more than an hour outside daylight."""
    hour = F.hour(ts)
    dark = ((hour < sunrise - 1) | (hour > sunset + 1)) & (F.col(power) > NIGHT_POWER_KW)
    return df.groupBy(*(by or [])).agg(F.count_if(dark).alias("suspicious_readings"))


def row_flags(df: DataFrame, kind: str, capacity_kw: float | None = None) -> DataFrame:
    """Adds ``broken_rules``: names of the rules a row breaks, empty for a good row."""
    checks = []
    for c, (low, high) in rule_limits(kind, capacity_kw).items():
        if c in df.columns:
            if low is not None:
                checks.append(F.when(F.col(c) < low, F.lit(f"{c} below minimum")))
            if high is not None:
                checks.append(F.when(F.col(c) > high, F.lit(f"{c} above maximum")))
    return df.withColumn("broken_rules", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def good_bad_share(flagged: DataFrame, by: list[str] | None = None, escalate_over: float = 0.5) -> DataFrame:
    """Good and bad rows and whether the bad share calls for escalation."""
    bad = F.size("broken_rules") > 0
    return flagged.groupBy(*(by or [])).agg(
        F.count_if(~bad).alias("good_rows"), F.count_if(bad).alias("bad_rows"),
    ).withColumn("bad_share", F.col("bad_rows") / (F.col("good_rows") + F.col("bad_rows"))
                 ).withColumn("escalate", F.col("bad_share") > escalate_over)


REQUIRED_IRRADIANCE = ("Temperature", "GHI", "DNI", "DHI")


class MissingColumns(ValueError):
    """Raised when a table lacks columns a job cannot do without."""


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED_IRRADIANCE) -> DataFrame:
    missing = tuple(c for c in required if c not in df.columns)
    if missing:
        raise MissingColumns(f"missing required columns: {', '.join(missing)}")
    return df
