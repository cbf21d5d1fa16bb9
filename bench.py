"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with the times."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from scrubline.catalog import registry  # noqa: E402

HEADLINE = [
    "profile_numeric_lineitem",
    "profile_table",
    "profile_table_lineitem",
    "convert_numeric",
    "parse_dates",
    "fill_median",
    "fill_ffill",
    "outlier_cap",
    "dedup_first",
    "dup_groups_documents",
    "auto_standardize",
    "target_encode",
    "label_encode",
    "standard_scale",
    "bin_quantile",
    "power_yj",
    "fe_analyze",
    "drop_correlated",
    "run_plan",
    "run_fe_plan",
    "validation_report",
    "src_csv",
    "fuzzy_dup_groups",
    "fuzzy_dedup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = sys.argv[1:] or HEADLINE
    if wanted == ["all"]:
        wanted = list(queries)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
