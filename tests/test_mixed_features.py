import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions.text import normalize_query
from pulseframe.operators.encoding import category_codes
from pulseframe.operators.models import PcaError
from pulseframe.operators.svd import TruncatedSvd
from pulseframe.operators.textfeatures import Tfidf
from pulseframe.operators.vocabulary import StoredTfidf, term_columns
from pulseframe.plans.detector import AnomalyDetector
from pulseframe.sources.fixtures import fixture
from pulseframe.streaming import run_available, score_batches


def sparse_rows(spark, x):
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, idx array<int>, val array<double>").repartition(5)


def low_rank(rng, n, d, k, noise=0.01):
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, d)) + noise * rng.normal(size=(n, d))
    x[rng.random(x.shape) < 0.3] = 0.0
    return x


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = low_rank(rng, 300, 30, 4)
    x[7] = 0.0  # a row without entries
    m = TruncatedSvd(30, 5).fit(sparse_rows(spark, x))
    s, vt = np.linalg.svd(x, full_matrices=False)[1:]
    assert np.allclose(m.s, s[:5], rtol=1e-3) and np.isclose(m.total, (x * x).sum())
    got = {r["id"]: r["err"] for r in m.error(sparse_rows(spark, x), "err").collect()}
    want = ((x - x @ vt[:5].T @ vt[:5]) ** 2).mean(axis=1)
    assert np.allclose([got[i] for i in range(300)], want, rtol=0.05, atol=1e-3) and got[7] == 0.0


def test_svd_share_outlier_and_bounds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 40))
    x[11] = 0.0
    x[11, 5] = 9.0  # off the three directions
    m = TruncatedSvd(40, 20, share=0.9).fit(sparse_rows(spark, x))
    assert m.k <= 3
    err = {r["id"]: r["err"] for r in m.error(sparse_rows(spark, x), "err").collect()}
    assert max(err, key=err.get) == 11 or m.k < 3
    for k in (0, 40, 64):
        with pytest.raises(ValueError):
            TruncatedSvd(40, k)
    with pytest.raises(ValueError):
        PcaError(list("abcd"), k=4)
    empty = sparse_rows(spark, x).limit(0)
    assert m.error(empty, "err").count() == 0 and TruncatedSvd(40, 2).fit(empty).total == 0.0


def test_stored_terms_against_tfidf(spark, sf_small):
    a = fixture(spark, sf_small, "activity").limit(200)
    t = StoredTfidf("query", preprocess=normalize_query).fit(a)
    want = {(r["event_id"], r["term"]): r["weight"] for r in Tfidf("event_id", "query", preprocess=normalize_query).fit_transform(a).collect()}
    names = {r["at"]: r["term"] for r in t.terms.collect()}
    assert sorted(names) == list(range(t.size))
    got = {(r["event_id"], names[i]): w for r in t.transform(a).collect() for i, w in zip(r["idx"], r["val"])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # The term of most rows comes first, and is a column.
    first = a.select(F.explode(F.array_distinct(F.split(normalize_query(F.col("query")), " "))).alias("w")).groupBy("w").count()
    top = first.where("length(w) >= 2").agg(F.max("count")).first()[0]
    cols = t.transform(a).withColumns(term_columns("idx", "val", 3)).where("term_0 > 0").count()
    assert cols == top


def test_stored_terms_on_a_stream(spark, tmp_path):
    schema = "id long, query string"
    t = StoredTfidf("query").fit(spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, None)], schema))
    t.save(str(tmp_path / "terms"))
    back = StoredTfidf("query").load(spark, str(tmp_path / "terms"))
    rows = [(10, "beta unseen"), (11, "unseen only"), (12, None), (13, "alpha beta"), (14, "")]
    whole = {r["id"]: (r["idx"], r["val"]) for r in back.transform(spark.createDataFrame(rows, schema)).collect()}
    assert whole[10][1] == [1.0] and whole[11] == whole[12] == whole[14] == ([], [])
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_batches(s, back.transform, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True}).awaitTermination()
    assert {r["id"]: (r["idx"], r["val"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == whole


def test_most_frequent_terms_only(spark):
    df = spark.createDataFrame([("aa bb",), ("aa cc",), ("aa bb dd",)], "query string")
    t = StoredTfidf("query", max_terms=2).fit(df)
    assert [(r["at"], r["term"]) for r in t.terms.orderBy("at").collect()] == [(0, "aa"), (1, "bb")]
    assert StoredTfidf("query").fit(df.limit(0)).size == 0


@pytest.mark.parametrize("n", [1, 3, 17])
def test_codes_at_any_partition_count(spark, n):
    df = spark.createDataFrame([(v,) for v in ["b", None, "a", "é", "b", "Z", "zz"]], "c string")
    assert {r["value"]: r["code"] for r in category_codes(df, "c", n).collect()} == {"Z": 0, "a": 1, "b": 2, "zz": 3, "é": 4}


def lexicon(spark):
    return spark.createDataFrame([("select", 1.0), ("insert", -2.0)], "term string, weight double")


def test_detector_mixed_features(spark, sf_small):
    a = fixture(spark, sf_small, "activity").limit(400)
    gaps = a.withColumns({"memory": F.when(F.col("event_id") % 50 != 0, F.col("memory")), "x__extra": F.lit(1)})
    det = AnomalyDetector(max_labelled_rows=300, trees=10, rf_trees=(5,), lexicon=lexicon(spark), leading_terms=6).fit(gaps)
    assert {"compound", "appname_code", "term_0", "term_5"} <= set(det.cols) and det.svd.k < det.svd.width
    waits = gaps.withColumn("avg_io_wait_time", F.lit(1).cast("long"))
    cols = ["event_id", "memory", "autoencoder", "isolation_forest", "one_class_svm", "anomaly_scores", "is_anomaly", "predicted_label", "type_anomalie"]
    whole = {r["event_id"]: r for r in det.transform(waits).select(*cols).collect()}
    assert len(whole) == 400 and sum(r["autoencoder"] > 0 for r in whole.values()) == 400
    assert sum(r["memory"] is None for r in whole.values()) == gaps.where("memory is null").count()
    # The same in any split, unseen texts and values included.
    path = os.path.join(tempfile.mkdtemp(prefix="pf-mixed-"), "det")
    det.save(spark, path)
    back = AnomalyDetector.load(spark, path)
    for part in (waits.where("event_id % 9 = 4"),):
        for r in back.transform(part).select(*cols).collect():
            # Sums of matrix products may differ in the last digits.
            assert all(x == y or isinstance(x, float) and abs(x - y) < 1e-9 for x, y in zip(r, whole[r["event_id"]]))
    odd = waits.limit(1).withColumns({"query": F.lit("never seen words here"), "client": F.lit("new"), "cpu": F.lit(1e6)})
    r = back.transform(odd).first()
    assert r["autoencoder"] > max(x["autoencoder"] for x in whole.values())


def test_run_available_reads_back(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run_available(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), "append", "t").count() == 3


def test_detector_learns_from_every_row(spark, sf_small, monkeypatch):
    from pulseframe.operators.models import split_flag
    from pulseframe.plans import detector
    a = fixture(spark, sf_small, "activity").limit(300)
    seen = {}
    train, trees = detector.train_vote_models, detector.RuleTrees.fit
    monkeypatch.setattr(detector, "train_vote_models", lambda df, *args, **more: (seen.update(vote=df.count()), train(df, *args, **more))[1])
    monkeypatch.setattr(detector.RuleTrees, "fit", lambda self, df: (seen.update(rules=df.count()), trees(self, df))[1])
    det = AnomalyDetector(max_labelled_rows=50, trees=3, rf_trees=(3,)).fit(a)
    n = a.where(split_flag("event_id", 80)).count()
    assert n > 200 and seen == {"vote": n, "rules": 300} and det.knn.n == n
