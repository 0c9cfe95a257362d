"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalog import spark_queries as S  # noqa: E402

HEADLINES = [
    "resample_per_user", "interpolate_per_user", "clean_minutes", "rolling_features", "rolling_features_wide",
    "standard_scaled", "row_positions", "histogram_by_flag", "box_by_flag", "correlation_matrix", "describe_lines",
    "score_quantiles", "ensemble_votes", "rates_by_split", "threshold_sweep", "forecast_every_channel",
    "forest_nodes", "forest_flags", "window_model_scores", "embedding_reconstruction", "stream_scoring", "full_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("vitalstream-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    # Stored tables that queries share are derived before the clock starts for them.
    for what in ("grid15", "clean15", "features", "merged", "forest"):
        start = time.perf_counter()
        S._stored(spark, sf_dir, what)
        times[f"prepare_{what}"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        S.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "vitalstream_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
