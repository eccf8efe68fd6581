import os
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pulseframe.sources.fixtures import apply_fixture, fixture
from pulseframe.streaming import dedup_events, minute_rollup, run_available


def _split_by_day(sf, out):
    t = pq.read_table(f"{sf}/events.parquet").to_pandas()
    days = t["ts"].dt.floor("D")
    for i, d in enumerate(sorted(days.unique())):
        t[days == d].to_parquet(os.path.join(out, f"day{i:03d}.parquet"), index=False)


def test_stream_equals_batch(spark, sf_small):
    src = tempfile.mkdtemp(prefix="pf-stream-")
    _split_by_day(sf_small, src)
    schema = spark.read.parquet(f"{sf_small}/events.parquet").schema
    s = apply_fixture(spark.readStream.schema(schema).option("maxFilesPerTrigger", 5).parquet(src), "activity")
    got = run_available(minute_rollup(s, "datetimeutc"), "append", "test-minutes")
    batch = fixture(spark, sf_small, "activity")
    mx = batch.agg(F.max("datetimeutc")).collect()[0][0]
    want = (batch.groupBy(F.date_trunc("minute", "datetimeutc").alias("m")).count()
            .where(F.col("m") + F.expr("INTERVAL 11 MINUTES") <= F.lit(mx)))
    g = {(r["minute"].replace(tzinfo=None), r["query_count"]) for r in got.collect()}
    w = {(r["m"], r["count"]) for r in want.collect()}
    assert w <= g and len(g) >= len(w)


def test_dedup_within_watermark(spark, sf_small):
    path = f"{sf_small}/events.parquet"
    schema = spark.read.parquet(path).schema
    glob = path[:-1] + "[t]"
    both = spark.readStream.schema(schema).parquet(glob).union(spark.readStream.schema(schema).parquet(glob))
    out = run_available(dedup_events(both, ["event_id"], "ts"), "append", "test-dedup")
    assert out.count() == spark.read.parquet(path).count()
