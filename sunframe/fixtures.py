"""Solar views over the driver tables. Every view is plain SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_RATING = ("CASE {k} % 4 WHEN 0 THEN 'excellent' WHEN 1 THEN 'good' "
           "WHEN 2 THEN 'fair' ELSE 'poor' END")
_SCORE = "GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(100 AS DOUBLE), {b} / 100))"

VIEWS: dict[str, str] = {
    "readings": """
        SELECT event_id AS reading_id, user_id AS device_id, ts AS event_ts,
               value / 47 AS power_kw,
               CAST(15 + event_id % 30 AS DOUBLE) AS temperature,
               CAST(195 + (event_id * 7) % 70 AS DOUBLE) AS voltage,
               CAST((event_id * 3) % 110 AS DOUBLE) AS current_a,
               CAST(494 + (event_id * 5) % 13 AS DOUBLE) / 10 AS frequency,
               CAST(75 + event_id % 26 AS DOUBLE) / 100 AS power_factor,
               CAST((event_id * 11) % 101 AS DOUBLE) AS humidity,
               CAST((event_id * 13) % 120 AS DOUBLE) / 10 AS wind_speed,
               CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS cloud_cover,
               CASE event_type WHEN 'view' THEN 'Clear sky' WHEN 'click' THEN 'Partly cloudy'
                    WHEN 'purchase' THEN 'Light rain' WHEN 'error' THEN 'Drizzle'
                    ELSE 'Sunny' END AS description
        FROM events""",
    "readings_gappy": """
        SELECT event_id AS reading_id, user_id AS device_id, ts AS event_ts,
               CASE WHEN event_id % 11 = 0 OR (event_id % 360) < 40 THEN NULL
                    ELSE value / 47 END AS power_kw,
               CASE WHEN event_id % 13 = 0 THEN NULL
                    ELSE CAST(15 + event_id % 30 AS DOUBLE) END AS temperature
        FROM events""",
    "side_readings": """
        SELECT event_id AS reading_id, user_id % 2 AS device_id, ts AS event_ts, value / 47 AS power_kw,
               CAST(15 + event_id % 30 AS DOUBLE) AS temperature
        FROM events""",
    "side_gappy": """
        SELECT event_id AS reading_id, user_id % 2 AS device_id, ts AS event_ts,
               CASE WHEN event_id % 11 = 0 OR (event_id % 360) < 40 THEN NULL
                    ELSE value / 47 END AS power_kw,
               CASE WHEN event_id % 13 = 0 THEN NULL
                    ELSE CAST(15 + event_id % 30 AS DOUBLE) END AS temperature
        FROM events""",
    "device_registry": """
        SELECT user_id AS device_id, CAST(3 + user_id % 8 AS DOUBLE) AS capacity_kw,
               CAST(user_id % 12 AS DOUBLE) AS panel_age_years,
               CAST(15 + user_id % 6 AS DOUBLE) / 100 AS panel_efficiency,
               12.5 + CAST((user_id * 37) % 1000 AS DOUBLE) / 1000 AS latitude,
               77.1 + CAST((user_id * 53) % 1000 AS DOUBLE) / 1000 AS longitude
        FROM events GROUP BY user_id""",
    "irradiance": """
        SELECT event_id AS reading_id, user_id AS device_id, ts AS event_ts,
               CAST(15 + event_id % 30 AS DOUBLE) AS temperature,
               CAST((event_id * 17) % 1001 AS DOUBLE) AS ghi,
               CAST((event_id * 29) % 901 AS DOUBLE) AS dni,
               CAST((event_id * 31) % 401 AS DOUBLE) AS dhi,
               CAST(event_id % 10 AS DOUBLE) AS cloud_type,
               CAST((event_id * 7) % 90 AS DOUBLE) AS zenith_angle
        FROM events""",
    "hourly_balance": """
        SELECT date_trunc('hour', ts) AS hour_ts,
               SUM(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS supply_kwh,
               SUM(CASE WHEN user_id % 2 = 1 THEN value ELSE 0 END) AS demand_kwh
        FROM events GROUP BY date_trunc('hour', ts)""",
    "sellers": f"""
        SELECT s_suppkey AS seller_id,
               12.5 + CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 1000 AS latitude,
               77.1 + CAST((s_suppkey * 53) % 1000 AS DOUBLE) / 1000 AS longitude,
               CASE WHEN s_suppkey % 23 = 7 THEN NULL
                    ELSE CAST(3 + s_suppkey % 15 AS DOUBLE) END AS capacity_kw,
               CAST(s_suppkey % 12 AS DOUBLE) AS system_age_years,
               CAST(70 + s_suppkey % 25 AS DOUBLE) AS system_efficiency,
               {_SCORE.format(b='s_acctbal')} AS financial_score,
               {_RATING.format(k='s_nationkey')} AS credit_rating
        FROM supplier""",
    "buyers": f"""
        SELECT c_custkey AS buyer_id,
               12.5 + CAST((c_custkey * 41) % 1000 AS DOUBLE) / 1000 AS latitude,
               77.1 + CAST((c_custkey * 59) % 1000 AS DOUBLE) / 1000 AS longitude,
               CAST(3 + c_custkey % 17 AS DOUBLE) AS demand_kw,
               (c_acctbal + 1000) * 150 AS budget_rupees,
               (c_acctbal + 1000) * 80 AS available_balance,
               CAST(10 + c_custkey % 30 AS DOUBLE) AS willing_to_travel_km,
               {_SCORE.format(b='c_acctbal')} AS financial_score,
               {_RATING.format(k='c_nationkey')} AS credit_rating
        FROM customer""",
    "investors": f"""
        SELECT c_custkey AS investor_id,
               12.5 + CAST((c_custkey * 41) % 1000 AS DOUBLE) / 1000 AS latitude,
               77.1 + CAST((c_custkey * 59) % 1000 AS DOUBLE) / 1000 AS longitude,
               (c_acctbal + 1000) * 200 AS available_balance,
               (c_acctbal + 1000) * 180 AS max_investment,
               CAST(8 + c_custkey % 10 AS DOUBLE) AS roi_expectation,
               CAST(50 AS DOUBLE) AS willing_to_travel_km,
               {_SCORE.format(b='c_acctbal')} AS financial_score,
               {_RATING.format(k='c_nationkey')} AS credit_rating
        FROM customer""",
    "host_spaces": """
        SELECT s_suppkey AS id, s_suppkey AS host_id, s_name AS host_name, n_name AS city,
               r_name AS state,
               12.5 + CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 1000 AS latitude,
               77.1 + CAST((s_suppkey * 53) % 1000 AS DOUBLE) / 1000 AS longitude,
               CAST(2 + s_suppkey % 30 AS DOUBLE) AS available_capacity_kw,
               CAST(100 + (s_suppkey * 7) % 200 AS DOUBLE) AS monthly_rent_per_kw,
               s_suppkey % 3 = 0 AS has_structural_certificate,
               CAST(30 + s_suppkey % 21 AS DOUBLE) / 10 AS host_rating,
               s_suppkey % 2 = 0 AS is_near_industry,
               split(concat('front-', s_suppkey, ',roof-', s_suppkey), ',') AS property_images
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey""",
    "industries": """
        SELECT p_partkey AS id, p_name AS company_name,
               CAST(p_size * 40 AS DOUBLE) AS daily_energy_demand_kwh,
               CAST(60 + p_partkey % 50 AS DOUBLE) / 10 AS max_price_per_kwh,
               12.5 + CAST((p_partkey * 43) % 1000 AS DOUBLE) / 1000 AS latitude,
               77.1 + CAST((p_partkey * 61) % 1000 AS DOUBLE) / 1000 AS longitude
        FROM part""",
    "space_buyers": """
        SELECT c_custkey AS buyer_id, (c_acctbal + 1000) * 1500 AS budget,
               n_name AS city, r_name AS state,
               CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END
                   AS risk_tolerance
        FROM customer JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey""",
    "energy_hosts": """
        SELECT s_suppkey AS host_id,
               12.4 + CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 1000 AS latitude,
               77.0 + CAST((s_suppkey * 53) % 1000 AS DOUBLE) / 1000 AS longitude,
               4 + CAST((s_suppkey * 7) % 80 AS DOUBLE) / 10 AS price_per_kwh,
               CAST(5 + (s_suppkey * 11) % 46 AS DOUBLE) AS available_kwh,
               CAST(30 + s_suppkey % 21 AS DOUBLE) / 10 AS rating,
               s_suppkey % 5 < 3 AS renewable_cert
        FROM supplier""",
    "energy_buyers": """
        SELECT c_custkey AS buyer_id,
               12.6 + CAST((c_custkey * 41) % 600 AS DOUBLE) / 1000 AS latitude,
               77.2 + CAST((c_custkey * 59) % 600 AS DOUBLE) / 1000 AS longitude,
               3 + CAST(c_custkey % 120 AS DOUBLE) / 10 AS max_price,
               CAST(2 + c_custkey % 19 AS DOUBLE) AS required_kwh,
               c_custkey % 5 < 2 AS renewable_pref
        FROM customer""",
    "predictions": """
        SELECT event_id AS row_id,
               CASE WHEN user_id % 2 = 0 THEN 'model_a' ELSE 'model_b' END AS model_name,
               CASE WHEN event_id % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE value / 47 END AS y_true,
               value / 47 + (CAST(event_id % 21 AS DOUBLE) - 10) / 20 AS y_pred
        FROM events""",
    "class_predictions": """
        SELECT doc_id AS row_id, quality + toxic AS y_label,
               CASE WHEN doc_id % 4 = 0 THEN toxic ELSE quality + toxic END AS y_hat,
               CAST((doc_id * 7) % 10 AS DOUBLE) / 10 + CAST(quality AS DOUBLE) / 5 AS score
        FROM labels""",
    "registrations": """
        SELECT o_custkey AS user_id, o_orderkey AS registration_id, o_orderdate AS registered_at,
               o_totalprice AS available_balance
        FROM orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame over the driver tables."""
    text = VIEWS[name]
    used = {t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)}
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    df = spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
    if name == "hourly_balance":
        df = df.withColumn("hour_ts", df.hour_ts.cast("timestamp_ntz"))
    return df


def ctes(*names: str) -> str:
    """The same views as a WITH list for the SQL oracle."""
    return ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
