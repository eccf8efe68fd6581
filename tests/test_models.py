import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseframe.operators.models import (IsolationForest, KnnVote, OneClassScore, PcaError, Standardizer,
                                         binary_metrics, majority_vote, weighted_metrics, _knn_votes)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(2000, 4))
    X[:10] += 8.0  # planted outliers, ids 0..9
    pdf = pd.DataFrame(X, columns=["a", "b", "c", "d"])
    pdf.insert(0, "id", np.arange(len(pdf)))
    return spark.createDataFrame(pdf)


def _top_ids(df, col, n=10):
    return {r["id"] for r in df.orderBy(F.desc(col)).limit(n).collect()}


def test_isolation_forest_finds_planted(spark, planted):
    cols = ["a", "b", "c", "d"]
    out = IsolationForest(cols, "id", trees=50).fit(planted).transform(planted)
    assert len(_top_ids(out, "isolation_forest") & set(range(10))) >= 9


def test_one_class_finds_planted(spark, planted):
    cols = ["a", "b", "c", "d"]
    out = OneClassScore(cols).fit(planted).transform(planted)
    assert len(_top_ids(out, "one_class_svm") & set(range(10))) >= 9
    # the nu share of rows scores above zero
    share = out.agg(F.avg((F.col("one_class_svm") > 0).cast("double"))).collect()[0][0]
    assert share == pytest.approx(0.05, abs=0.01)


def test_pca_error_finds_planted(spark):
    rng = np.random.default_rng(5)
    t = rng.normal(size=2000)
    X = np.stack([t, 2 * t, -t, 0.5 * t], axis=1) + rng.normal(scale=0.01, size=(2000, 4))
    X[:10, 1] = -X[:10, 1]  # break the correlation
    pdf = pd.DataFrame(X, columns=list("abcd"))
    pdf.insert(0, "id", np.arange(len(pdf)))
    df = spark.createDataFrame(pdf)
    out = PcaError(list("abcd"), k=1).fit(df).transform(df)
    assert len(_top_ids(out, "autoencoder") & set(range(10))) >= 9


def test_standardizer_population_sd(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    r = [x[0] for x in Standardizer(["x"]).fit(df).transform(df).orderBy("x").collect()]
    assert r == [-1.0, 1.0]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    R = rng.normal(size=(300, 3))
    y = (R[:, 0] + R[:, 1] > 0).astype(int)
    Q = rng.normal(size=(50, 3))
    got = _knn_votes(Q, R, y, [5])[5]
    d = ((Q[:, None, :] - R[None]) ** 2).sum(axis=2)
    want = []
    for row in d:
        near = np.argsort(row, kind="stable")[:5]
        want.append(int(np.bincount(y[near], minlength=2).argmax()))
    assert got.tolist() == want
    train = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "a": R[:, 0], "b": R[:, 1],
                                                "c": R[:, 2], "label": y}))
    m = KnnVote(["a", "b", "c"], "label").fit(train, "id")
    assert 1 <= m.k <= 24
    q = spark.createDataFrame(pd.DataFrame({"a": Q[:, 0], "b": Q[:, 1], "c": Q[:, 2]}))
    pred = [r["p_knn"] for r in m.transform(q).collect()]
    assert pred == _knn_votes(Q, R, y, [m.k])[m.k].tolist()


def test_knn_beyond_max_reference_uses_every_row(spark):
    rng = np.random.default_rng(12)
    R, Q = rng.integers(0, 12, (500, 3)).astype(float), rng.integers(0, 12, (90, 3)).astype(float)
    y = ((R[:, 0] + R[:, 1] > 11) ^ (rng.random(500) < 0.1)).astype(int)
    train = spark.createDataFrame(pd.DataFrame({"id": np.arange(500), "a": R[:, 0], "b": R[:, 1], "c": R[:, 2], "label": y}))
    q = spark.createDataFrame(pd.DataFrame({"q": np.arange(90), "a": Q[:, 0], "b": Q[:, 1], "c": Q[:, 2]}))
    whole = KnnVote(["a", "b", "c"], "label").fit(train, "id")
    blocks = KnnVote(["a", "b", "c"], "label", max_reference=100, block_rows=70).fit(train, "id")
    assert len(whole.y) == 500 and blocks.R is None and blocks.k == whole.k
    pred = {r["q"]: r["p_knn"] for r in blocks.transform(q).collect()}
    assert [pred[i] for i in range(90)] == _knn_votes(Q, R, y, [whole.k])[whole.k].tolist()


def test_knn_vote_k5_keeps_the_reference_set_of_its_sql(spark):
    from pulseframe.plans import catalog
    sf = "/root/testdata/sf0.1"
    a = catalog.fx(spark, sf, "activity").selectExpr("event_id", "datetimeutc", *catalog._KNN_COLS, "CASE WHEN io_wait = 'Y' THEN 1 ELSE 0 END AS label")
    a = a.toPandas().sort_values("event_id")
    train = a[a["datetimeutc"] < catalog._KNN_SPLIT]
    assert len(train) > 10_000
    train, asked = train[:10_000], a[(a["datetimeutc"] >= catalog._KNN_SPLIT) & (a["event_id"] % 40 == 0)]
    want = _knn_votes(asked[["x1", "x2", "x3"]].to_numpy(float), train[["x1", "x2", "x3"]].to_numpy(float), train["label"].to_numpy(), [5])[5]
    got = {r["event_id"]: r["p_knn"] for r in catalog.q_knn_vote_k5(spark, sf).where("event_id % 40 = 0").collect()}
    assert got == dict(zip(asked["event_id"].tolist(), want.tolist()))


def test_vote_and_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (0, 0, 1, 0), (1, 1, 1, 1), (0, 1, 0, 0)],
                               "p1 int, p2 int, p3 int, y int")
    v = df.withColumn("vote", majority_vote("p1", "p2", "p3"))
    assert [r["vote"] for r in v.collect()] == [1, 0, 1, 0]
    m = binary_metrics(v, "y", "p2").collect()[0]
    assert (m["tp"], m["fp"], m["fn"]) == (2, 1, 0)
    assert m["precision"] == pytest.approx(2 / 3, abs=1e-6) and m["recall"] == 1.0
    w = weighted_metrics(v, "y", "p2").collect()[0]
    # class 1: prec 2/3 rec 1; class 0: prec 0 (0 of 1 predicted), rec 1/2 -> 0? tp0 = 1 (row2)
    assert w["recall"] == pytest.approx(0.75, abs=1e-6)
