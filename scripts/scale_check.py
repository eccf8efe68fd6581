"""Scale check: copy `events` N times (new ids, shifted times) into a fresh
scratch folder once, then run the event-based queries of the registry on it
through bench.py.

usage: python scripts/scale_check.py [copies=100] [source=/root/testdata/sf0.1]
"""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from pulseframe.session import get_spark  # noqa: E402

EVENT_QUERIES = ["top_queries", "metric_p95", "outlier_flags", "assign_labels", "query_duration_profile",
                 "io_wait_count", "backfill", "activity_per_minute_filled", "encode_query_codes", "tfidf",
                 "lexicon_score", "centroid_outliers", "duration_histogram", "isolation_forest",
                 "stream_minute_counts"]


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    src = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    out = tempfile.mkdtemp(prefix="run-")
    spark = get_spark("local[8]", shuffle_partitions=16)
    e = spark.read.parquet(f"{src}/events.parquet")
    span = e.agg(F.max("event_id") + 1).collect()[0][0]
    # every source row once per copy: explode a copy number per row
    big = e.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        (F.col("event_id") + F.col("r") * span).alias("event_id"),
        (F.col("ts") + F.col("r") * F.expr("INTERVAL 7 MINUTES")).alias("ts"),
        ((F.col("user_id") * 7 + F.col("r")) % 15000).alias("user_id"), "event_type", "value", "props")
    big.repartition(32).write.parquet(f"{out}/events.parquet")
    spark.stop()
    env = dict(os.environ, BENCH_SF_DIR=out)
    bench = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "bench.py")
    subprocess.run([sys.executable, bench, *EVENT_QUERIES], env=env, check=True)


if __name__ == "__main__":
    main()
