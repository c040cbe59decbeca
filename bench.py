"""Time the headline queries: ``BENCH_SF_DIR`` (data), ``BENCH_CPUS`` (cores). Prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from episode_mart.checks.queries import QUERIES
from episode_mart.session import configure

HEADLINE = [
    "episodes", "profile_nulls", "name_parse", "id_tx_normalize", "tx_remaining_balance",
    "mart_patients", "denial_assign_episode", "csv_round_trip", "episode_balance", "top_payers",
    "tx_assign_episode", "enrich_referrals", "enrich_transactions", "clean_transactions",
    "mart_billing", "surrogate_key", "ingest_all", "refresh",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("episode_mart bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    configure(spark)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
