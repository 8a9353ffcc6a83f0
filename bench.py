"""Headline queries on the driver tables; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sunframe.plans.all_queries import QUERIES  # noqa: E402
from sunframe.session import build_session  # noqa: E402

HEADLINE = [
    "validate_ranges", "energy_summary", "fill_linear", "outliers_iqr", "lag_features", "rolling_features",
    "solar_pipeline", "consumption_pipeline", "match_seller_to_buyers", "match_buyer_to_sellers",
    "match_investor_to_sellers", "nearby_sellers", "find_opportunities", "price_match", "trading_hours",
    "voltage_anomaly", "regression_report", "auc_roc_readings", "isolation_forest", "solar_gbt",
    "seasonal_forecast", "stream_energy_tumbling",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().collect()  # warm the JVM
    only = sys.argv[1:] or HEADLINE
    times = {}
    for name in only:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
