"""Times the engine's headline queries and prints one line of JSON.

BENCH_SF_DIR: the tables' folder; BENCH_CPUS: the number of threads. Results are computed whole and thrown away.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ("contract_grain", "cleaned_rows", "vintage_category_region", "vintage_overall", "supplier_prior_count", "feature_table", "quality_register", "rule_outcomes", "rule_calibration", "outcome_by_year", "amount_distribution", "fiscal_year_coverage", "region_coverage", "auc", "threshold_table", "rules_only_cohorts")


def main() -> None:
    from awardlens.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # the session is up before the clock starts
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
