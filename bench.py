"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tarnsift.plans.slate import QUERIES

HEADLINE = [
    "flagship", "interaction_consensus", "interaction_standardize", "merge_priority", "moa_collapse", "outer_merge_features",
    "ranker", "tie_adjusted_ranks", "condense_ordering", "weighted_combine", "auroc", "running_es", "febe", "mantel_haenszel",
    "path_direct", "path_indirect", "jaccard_pairs", "depend_aggs", "loi_importance", "selectivity", "connected_components", "event_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = []
        for _ in range(2):  # cold, then warm
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best.append(time.time() - start)
        took[name] = round(min(best), 3)
    print(json.dumps({"metric": "total warm seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
