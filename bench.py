"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tablescope.plans.storage import drop_stored  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (os.environ.get("BENCH_QUERIES") or "").split() or [
    "descriptive_stats",
    "outlier_summary",
    "correlation_matrix",
    "spearman",
    "anova_test",
    "chi_square_test",
    "normalise_table",
    "build_schema",
    "profile_dataset",
    "clean_table",
    "engineer_features",
    "trend_per_customer",
    "daily_series",
    "seasonal_decompose",
    "holt_winters_forecast",
    "histogram",
    "kde",
    "box_stats_many_groups",
    "ecdf",
    "hierarchy",
    "domain_scores",
    "isolation_forest",
    "pca_loadings",
    "kmeans",
    "detect_anomalies",
    "spearman_matrix",
    "violin",
    "full_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tablescope-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    drop_stored(spark)
    spark.stop()


if __name__ == "__main__":
    main()
