import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pulseframe.operators.checks import list_base_tables, table_exists, truncate
from pulseframe.plans.detector import AnomalyDetector
from pulseframe.sources.fixtures import fixture, fixture_stream
from pulseframe.sources.sinks import append_csv
from pulseframe.streaming import refit_every


def test_detector_save_load_same_scores(spark, sf_small):
    a = fixture(spark, sf_small, "activity")
    det = AnomalyDetector(max_labelled_rows=600, trees=10, rf_trees=(10,)).fit(a)
    path = os.path.join(tempfile.mkdtemp(prefix="pf-bundle-"), "det")
    det.save(spark, path)
    with pytest.raises(FileExistsError):
        det.save(spark, path)
    back = AnomalyDetector.load(spark, path)
    cols = ["event_id", "isolation_forest", "one_class_svm", "autoencoder", "anomaly_scores", "predicted_label"]
    x = det.transform(a).select(*cols).orderBy("event_id").collect()
    y = back.transform(a).select(*cols).orderBy("event_id").collect()
    assert x == y
    assert det.summary(spark).count() > 10
    # A crash in save leaves no marker: the folder is neither read nor picked.
    from pulseframe.streaming.refit import latest_version
    half = os.path.join(os.path.dirname(path), "models", "v=3")
    spark.createDataFrame([("id_col", "x")], "key string, value string").write.parquet(half + "/params")
    assert latest_version(spark, os.path.dirname(half)) is None
    with pytest.raises(FileNotFoundError):
        AnomalyDetector.load(spark, half)


def test_counts_of_a_replayed_batch(spark):
    from pulseframe.streaming.activity_stream import count_before, write_count
    from pulseframe.streaming.refit import batch_state
    path = os.path.join(tempfile.mkdtemp(prefix="pf-count-"), "counter")
    assert count_before(spark, path, 0) == 0
    write_count(spark, path, 0, 400)
    write_count(spark, path, 1, 900)
    assert (count_before(spark, path, 1), count_before(spark, path, 2)) == (400, 900)
    assert batch_state(spark, path, 1, 4) == (4, 400)
    assert batch_state(spark, path, 1, 5) == (4, 400)  # a replay keeps the version


def test_append_csv_header_once_per_file(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="pf-csv-"), "snap")
    df = spark.createDataFrame([("normal", 1.0)], "context string, total double")
    append_csv(df, out)
    append_csv(df, out)
    back = spark.read.option("header", True).schema("context string, total double").csv(out)
    assert back.count() == 2


def test_catalog_checks(spark):
    loc = tempfile.mkdtemp(prefix="pf-db-")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS pf_test LOCATION '{loc}'")
    spark.createDataFrame([(1, "a")], "id int, v string").write.mode("overwrite").saveAsTable("pf_test.users")
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("pf_view")
    assert table_exists(spark, "pf_test.users")
    assert "users" in list_base_tables(spark, "pf_test")
    truncate(spark, "pf_test.users")
    assert spark.table("pf_test.users").count() == 0


def test_refit_every(spark, sf_small):
    calls = []
    s = fixture_stream(spark, sf_small, "activity").select("event_id")
    ckpt = os.path.join(tempfile.mkdtemp(prefix="pf-refit-"), "ckpt")
    q = refit_every(s, 400, lambda df, total: calls.append(total), ckpt, trigger={"availableNow": True})
    q.awaitTermination()
    assert calls == [1000]
    counter = spark.read.parquet(ckpt + "_rowcount").collect()[0]
    assert counter["n"] == 1000


def test_publish_and_stream_to_table(spark, sf_small):
    from pulseframe.sources.sinks import publish
    from pulseframe.streaming import stream_to_table
    loc = tempfile.mkdtemp(prefix="pf-pub-")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS pf_pub LOCATION '{loc}'")
    df = fixture(spark, sf_small, "stat_io").groupBy("context").agg(F.sum("reads").alias("r"))
    publish(df, "pf_pub.io_ctx")
    assert spark.table("pf_pub.io_ctx").count() == df.count()
    base = tempfile.mkdtemp(prefix="pf-sink-")
    s = fixture_stream(spark, sf_small, "activity").select("event_id", "query")
    q = stream_to_table(s, base + "/out", base + "/ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    assert spark.read.parquet(base + "/out").count() == fixture(spark, sf_small, "activity").count()


def test_score_and_refit_versions(spark, sf_small):
    from pulseframe.streaming.refit import latest_version, score_and_refit
    base = tempfile.mkdtemp(prefix="pf-refit-")
    a = fixture(spark, sf_small, "activity")
    make = lambda: AnomalyDetector(max_labelled_rows=500, trees=5, rf_trees=(5,))
    make().fit(a.orderBy("event_id").limit(300)).save(spark, base + "/models/v=0")
    s = fixture_stream(spark, sf_small, "activity")
    q = score_and_refit(s, base + "/models", base + "/history", base + "/out", base + "/ckpt",
                        every_rows=600, make_detector=make, trigger={"availableNow": True})
    q.awaitTermination()
    assert latest_version(spark, base + "/models") == 1
    out = spark.read.parquet(base + "/out")
    assert out.count() == a.count() and "predicted_label" in out.columns
