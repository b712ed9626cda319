"""Time the headline queries and print one JSON line.

Each query is written to the ``noop`` sink, so all columns and rows are computed. One warm-up
run of the cheapest query starts the session; every query then runs once.
"""

from __future__ import annotations

import json
import os
import time

from fleetcast.queries import registered
from fleetcast.session import build_session

HEADLINE = (
    "segments",
    "labels_multi_horizon",
    "history_features",
    "rolling_stats",
    "interpolate",
    "gold_matrix",
    "gold_metrics",
    "measurement_long",
    "dedup_first",
    "describe",
    "iqr_outliers",
    "flag_saturation",
    "unit_consistency",
    "corr_pearson",
    "corr_spearman",
    "daily_mean",
    "histogram",
    "enrich_incident",
    "chi2_machine_type",
    "kruskal_machine",
    "star_join",
    "fk_lookup",
    "reading_header",
    "split_smd",
    "fold_smd",
    "average_precision",
    "roc_auc",
    "pr_curve",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        f"local[{cpus}]",
        "fleetcast-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registered()
    found["chrono_split"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
