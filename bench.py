"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores; ``BENCH_ALL=1`` times every registered query.
Each query runs once to warm up and is then timed; results go to Spark's no-op sink, so all rows are computed.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = [
    "rice_roadmap", "drift_table", "drift_brief", "kpi_counts", "type_mix", "review_queue", "theme_drilldown",
    "data_sanity", "ingest_filter", "ingest_normalize", "ingest_dedup", "ingest_counts", "reply_validate",
    "label_run_events", "keyword_labels", "hooked_labels", "error_classes", "current_state", "unlabeled_items",
    "golden_sample", "judge_certify", "sampled_accuracy", "cache_misses", "theme_names", "nearest_centroid",
    "evidence_top30", "siblings", "citation_check", "review_report", "quote_check", "theme_pack", "review_pack",
]
#: Timed once with ``BENCH_FURTHER=1``, apart from the headline queries' sum: whole runs, streams and clustering.
FURTHER = [
    "batch_runs", "filtered_imports", "retry_run", "bucketed_state", "kmeans_themes", "theme_run", "stream_ingest",
    "stream_daily_counts", "drift_by_deltas", "theme_document_run", "review_document_run", "citation_report",
]
REPEATS = 3


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    timings = {}
    for name in names:
        seconds(name)
        timings[name] = round(statistics.median(seconds(name) for _ in range(REPEATS)), 3)
    total = round(sum(timings.values()), 3)
    further = {name: round(seconds(name), 3) for name in FURTHER if os.environ.get("BENCH_FURTHER") and name not in timings}
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "further": further,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
