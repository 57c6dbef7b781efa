"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from gladeline.catalog.queries import QUERIES
from gladeline.session import local_session

HEADLINE = (
    "mosaic", "zonal_sum", "defo_pct", "ring_features", "parcel_context", "nearest_loss", "nearest_loss_excluding_own",
    "masked_distance", "connected_components", "build_parcels", "polygonize_parcels", "clip", "resample",
    "list_farms", "early_warning", "class_stats", "stats_document", "describe", "roc_auc", "classification_report",
    "stratified_folds", "model_frame", "forest_scores", "regression_scores", "distance_band", "page_directory",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executors
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        # the noop sink computes every column of every row
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
