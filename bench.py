"""Seconds for the headline queries on $BENCH_SF_DIR, on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from hazardspark.plans import registry

HEADLINE = [
    "a1_monthly_occurrences", "w1_w6_history_features", "w7_w8_context_features", "t2_negative_sample", "w_a_dataset", "p11_p13_derived", "m14_m15_requested_features",
    "a4_a5_p18_monthly_climate", "j4_j5_station_match", "j6_j7_fallback_spread", "w9_w10_known_climate", "v2_v4_counters", "v8_cleaning", "t3_stratified_split",
    "m8_measures_summary", "p21_shaped_scores", "o9_auc", "o2_o8_odds_ratios", "m2_m13_forest_scores", "p14_normalise_text",
]


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g")).config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, taken = registry.queries(), {}
    found["a1_monthly_occurrences"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
