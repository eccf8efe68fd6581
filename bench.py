"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line. Each query is fully executed into Spark's ``noop``
sink (the whole plan runs, nothing is collected to the driver).

A warm-up pass runs the same queries once on the smallest test tables
(JIT compilation, Python worker start-up) before the timed pass, so the
timings measure steady-state work at the benchmark scale."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulseframe.plans.catalog import REGISTRY  # noqa: E402
from pulseframe.session import get_spark  # noqa: E402

HEADLINE = [
    "top_queries", "outlier_flags", "assign_labels", "label_load_profile", "metric_p95",
    "activity_per_minute_filled", "io_by_context", "io_by_backend", "latest_snapshot",
    "parse_activity_line", "decode_messages", "snapshot_diff", "backfill", "query_duration_profile",
    "encode_query_codes", "tfidf", "document_sentiment", "fk_orphans", "check_not_null",
    "centroid_outliers", "isolation_forest", "stream_minute_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in names:
            REGISTRY[name].build(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        df = REGISTRY[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
