"""Times the headline queries; prints one JSON line.

Each query runs twice on a warmed session and its better time counts. Results are
consumed in full by a no-op sink, so nothing but the query itself is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "kpi_summary_sales", "kpi_summary_filtered", "breakdown_category", "breakdown_with_group_total",
    "multi_breakdown", "custom_kpi_rate", "custom_kpi_percent_of_total", "formula_metric", "what_if_grid",
    "benchmark_periods", "timeseries_month", "growth_latest", "headline_driver", "forecast_total",
    "forecast_by_product", "anomalies", "anomaly_root_causes", "insight_pareto", "insights_worded", "geo_breakdown",
    "profile_numeric", "duplicate_rows", "type_roles_sales", "clean_currency", "clean_fill_median", "quality_score",
    "iqr_outliers_many", "universal_search", "record_page", "dashboard_data",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("metricloom-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             # Column call sites are recorded for error messages only; that costs driver time per expression.
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from metricloom.catalog import CATALOG

    chosen = sys.argv[1:] or list(HEADLINE)
    CATALOG["breakdown_category"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in chosen:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
