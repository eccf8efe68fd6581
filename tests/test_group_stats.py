import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from pulseframe.plans.features import base_features, duration_profile
from pulseframe.sources.fixtures import fixture
from pulseframe.streaming import GroupStatistics, run_available, stream_io_wait_count
from pulseframe.streaming.group_stats import versions

SCHEMA = "id long, datetimeutc timestamp, io_wait string"
T0 = dt.datetime(2024, 1, 1)
ROWS = [(i, T0 + dt.timedelta(minutes=i // 4) if i != 50 else None, "Y" if i % 3 == 0 else "N") for i in range(400)]


def streamed(spark, parts, per_trigger=1):
    path = tempfile.mkdtemp(prefix="pf-groups-") + "/in"
    for k in sorted(set(parts)):
        spark.createDataFrame([r for r, p in zip(ROWS, parts) if p == k], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


@pytest.mark.parametrize("parts", [[0] * 400, [min(2, (i + i % 2 * 8) // 140) for i in range(400)], [i % 4 if i < 12 else 4 for i in range(400)]])
def test_wait_counts_are_those_of_the_whole_time(spark, parts):
    out = run_available(stream_io_wait_count(streamed(spark, parts), watermark="5 minutes"), "append", "test-waits")
    got = {r["id"]: r["avg_io_wait_time"] for r in out.collect()}
    want = {i: None if t is None else sum(u == t and f == "Y" for _, u, f in ROWS) for i, t, _ in ROWS}
    # Minutes up to the watermark, 94, are complete.
    assert got == {i: w for i, w in want.items() if i < 380}


def test_profile_is_the_same_in_any_split(spark, sf_small):
    a = fixture(spark, sf_small, "activity").limit(300)
    p = duration_profile().fit(a.where("event_id % 2 = 0"))
    a = a.withColumn("avg_io_wait_time", F.lit(1).cast("long"))
    whole = {r["event_id"]: r for r in base_features(a, profile=p).collect()}
    for part in (a.where("event_id % 7 = 3"), a.orderBy("event_id").limit(1)):
        for r in base_features(part, profile=p).collect():
            assert r == whole[r["event_id"]]


def test_profile_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", None), (None, 4.0)], "query string, duration double")
    p = duration_profile().fit(df)
    rows = spark.createDataFrame([("a", 2.0, 7), ("b", 3.0, 7), ("new", 5.0, 7), (None, 6.0, 7)], "query string, duration double, max_query_duration int")
    got = {r["query"]: (r["avg_query_duration"], r["max_query_duration"]) for r in p.transform(rows).collect()}
    assert got == {"a": (5.0, 9.0), "b": (3.0, 3.0), "new": (5.0, 5.0), None: (None, None)}
    assert p.transform(rows.limit(0)).count() == 0


def test_versions_replay_and_incomplete_ones(spark, tmp_path):
    path = str(tmp_path / "v")
    batches = [[("a", 1.0)], [("a", 5.0), ("b", 2.0)], [("b", 4.0)]]
    make = lambda rows: spark.createDataFrame(rows, "query string, duration double")
    p = duration_profile().fit(make([]))
    p.save(path, 0)
    for b in (0, 1, 1, 2):  # batch 1 runs twice
        at = GroupStatistics("query", "duration", "m", "x").load(spark, path, b)
        at.state = at.merged(at.state, at.partial(make(batches[b])))
        at.save(path, b + 1)
    (tmp_path / "v" / "v=9").mkdir()  # without marker
    assert versions(spark, path) == [0, 1, 2, 3]
    got = {r["key"]: (r["n"], r["total"], r["top"]) for r in duration_profile().load(spark, path).state.collect()}
    assert got == {"a": (2, 6.0, 5.0), "b": (2, 6.0, 4.0)}
    with pytest.raises(FileNotFoundError):
        duration_profile().load(spark, path, 9)
