import pandas as pd
from pyspark.sql import functions as F

from pulseframe.operators.encoding import CategoryEncoder, align_features, category_codes
from pulseframe.operators.rollups import latest_snapshot, per_minute, top_queries
from pulseframe.operators.windows import attach_group_stats, backfill


def test_backfill_blocked_equals_pandas(spark):
    rows = []
    for i in range(400):
        v = None if (i % 3 == 0 or 120 <= i < 260) else float(i)
        rows.append((i, "hot" if i % 5 else "cold", v))
    df = spark.createDataFrame(rows, "id long, k string, v double")
    got = backfill(df, ["v"], ["k"], ["id"], block=F.floor(F.col("id") / 16)).orderBy("id").toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "k", "v"]).sort_values("id")
    pdf["v"] = pdf.groupby("k")["v"].bfill()
    assert got["v"].fillna(-1).tolist() == pdf["v"].fillna(-1).tolist()
    plain = backfill(df, ["v"], ["k"], ["id"]).orderBy("id").toPandas()
    assert plain["v"].fillna(-1).tolist() == pdf["v"].fillna(-1).tolist()


def test_group_stats_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, x double")
    r = attach_group_stats(df, ["k"], {"m": F.avg("x")}).orderBy("x").collect()
    assert [x["m"] for x in r] == [2.0, 2.0, None]


def test_per_minute_fill_gaps(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", "q1"), ("2024-01-01 00:00:20", "q1"),
                                ("2024-01-01 00:03:00", "q2")], "t string, query string")
    df = df.withColumn("query_start", F.col("t").cast("timestamp"))
    r = per_minute(df, fill_gaps=True).orderBy("minute").collect()
    assert [x["query_count"] for x in r] == [2, 0, 0, 1]
    assert r[0]["queries"] == "q1 (x2)" and r[1]["queries"] == ""


def test_top_queries_imputes_and_sums_memory(spark):
    df = spark.createDataFrame([("SELECT a FROM t", 10.0, 1.0, 1.0, 1.0), ("SELECT a FROM u", None, 2.0, 1.0, 1.0),
                                ("INSERT x", 1.0, 4.0, 1.0, 1.0)],
                               "query string, cpu double, memory double, read_io double, write_io double")
    r = top_queries(df).collect()
    assert r[0]["query"] == "SELECT a F" and r[0]["cpu"] == (10.0 + 5.5) / 2 and r[0]["memory"] == 3.0


def test_latest_snapshot(spark):
    df = spark.createDataFrame([("t1", 1, "a"), ("t1", 3, "b"), ("t2", 2, "c")], "k string, ts int, v string")
    r = sorted(tuple(x) for x in latest_snapshot(df, ["k"], "ts").collect())
    assert r == [("t1", 3, "b"), ("t2", 2, "c")]


def test_category_codes_sorted_and_unseen(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", None]], "c string")
    codes = {r["value"]: r["code"] for r in category_codes(df, "c", num_partitions=3).collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}
    enc = CategoryEncoder(["c"]).fit(df)
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    got = {r["c"]: r["c_code"] for r in enc.transform(new).collect()}
    assert got == {"a": 0, "z": 3, None: None}


def test_align_features(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    r = align_features(df, ["b", "x", "b", "a"])
    assert r.columns == ["b", "x", "a"] and tuple(r.collect()[0]) == (2.0, 0, 1.0)


def test_active_queries_display(spark):
    from pulseframe.operators.rollups import active_queries_display
    df = spark.createDataFrame([("q1", "active", 1.5), ("q2", "idle", 2.0)], "query string, state string, duration double")
    r = [tuple(x) for x in active_queries_display(df).collect()]
    assert r == [("q1", "Running", "1.5 second")]


def test_run_named_sources(spark, sf_small):
    from pulseframe.plans.catalog import REGISTRY
    from pulseframe.sources.sinks import run_named
    out = run_named({n: REGISTRY[n].build for n in ["io_by_context", "io_by_backend", "latest_snapshot"]},
                    spark, sf_small)
    assert set(out) == {"io_by_context", "io_by_backend", "latest_snapshot"}
    assert out["io_by_context"].count() == 3 and out["io_by_backend"].count() == 2
