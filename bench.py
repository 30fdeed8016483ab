"""Benchmark: run the headline queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional), BENCH_WARM=1 to also time a second run.
Each query is executed completely with the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "forest_features", "urban_features", "weekly_weather", "drought_indicators", "alert_scoring",
    "state_matching", "urban_location_scoring", "message_intents", "event_top3", "weather_payload_environment",
    "npk_by_state", "seasonal_yield", "classification_report", "stream_weekly_weather", "forest_effects_full",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    warm = os.environ.get("BENCH_WARM", "0") == "1"
    from terrapulse.plans.catalog import load_all
    from terrapulse.session import build_session
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    reg = load_all()
    # JVM / codegen warm-up on a tiny unrelated scan (not timed; no data is cached)
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_regionkey").count().write.format("noop") \
        .mode("overwrite").save()
    timings: dict[str, float] = {}
    warm_t: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[n] = round(time.perf_counter() - t0, 3)
        if warm:
            t0 = time.perf_counter()
            reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            warm_t[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus, "spark": spark.version}
    if warm:
        out["warm"] = warm_t
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
