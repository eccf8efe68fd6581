import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators.models import weighted_metrics
from pulseframe.operators.one_class import OneClassSvm
from pulseframe.operators.rule_trees import RuleTrees


def labelled(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    x[:, 2] = 1.0
    names = lambda v: [r for r, f in (("A", v[0] > 0.7), ("B", v[1] > 0.8), ("Never", False), ("Always", v[2] > 0)) if f]
    rows = [(i, *map(float, v), ", ".join(names(v))) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, type_anomalie string")


def test_unseen_combinations_are_predicted(spark, tmp_path):
    df = labelled(spark)
    fit = df.where("not (type_anomalie like '%A, B%')")  # A and B never together
    t = RuleTrees(["a", "b", "c"], ["A", "B", "Never", "Always"]).fit(fit)
    assert t.labels == ["A", "B", "Always"] and t.always == ["Always"]
    out = t.transform(df)
    assert out.columns == [*df.columns, "predicted_label"]
    assert out.where("predicted_label = type_anomalie").count() >= 0.97 * 600
    assert out.where("predicted_label = 'A, B, Always'").count() > 0
    t.save(str(tmp_path / "trees"))
    back = RuleTrees(["a", "b", "c"], t.rules).load(str(tmp_path / "trees"), list(t.trees), t.always)
    assert back.transform(df).collect() == out.collect()


def test_no_rule_and_no_rows(spark):
    df = labelled(spark).withColumn("type_anomalie", F.lit("Normal"))
    t = RuleTrees(["a"], ["A", "B"]).fit(df)
    assert t.labels == [] and {r["predicted_label"] for r in t.transform(df).collect()} == {"Normal"}
    assert RuleTrees(["a"], ["A"]).fit(df.limit(0)).transform(df.limit(0)).count() == 0


def exact_one_class(z, nu, steps=20000):
    """Frank-Wolfe on the exact dual of a small table."""
    n = len(z)
    a = np.full(n, 1 / n)
    for _ in range(steps):
        w = a @ z
        s = z @ w
        v, left = np.zeros(n), 1.0
        for i in np.argsort(s, kind="stable"):
            v[i] = min(1 / (nu * n), left)
            left -= v[i]
            if left <= 1e-15:
                break
        d = w - v @ z
        if w @ d < 1e-9:
            break
        a = a + min(1.0, (w @ d) / (d @ d)) * (v - a)
    return a @ z


def ranks(x):
    return np.argsort(np.argsort(x))


def test_one_class_against_exact_dual(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(180, 2)), rng.normal(size=(20, 2)) * 4])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double").repartition(3)
    m = OneClassSvm(["a", "b"], nu=0.1, gamma=0.3, dims=64, steps=40).fit(df)
    z = math.sqrt(2 / 64) * np.cos(x @ m.W + m.b)
    w = exact_one_class(z, 0.1, 3000)
    assert m.w @ m.w <= 1.05 * (w @ w)
    got = {r["id"]: r["one_class_svm"] for r in m.transform(df).collect()}
    score = np.array([got[i] for i in range(200)])
    assert np.allclose(score, m.rho - z @ m.w)
    assert np.corrcoef(ranks(score), ranks(-(z @ w)))[0, 1] > 0.98
    assert abs((score > 0).mean() - 0.1) <= 0.03  # the nu share lies outside
    # A point far from all others scores high.
    far = spark.createDataFrame([(1, 50.0, -50.0), (2, 0.0, 0.0), (3, None, float("nan"))], "id long, a double, b double")
    s = {r["id"]: r["one_class_svm"] for r in m.transform(far).collect()}
    assert s[1] > s[2] and s[3] == pytest.approx(s[2])


def test_one_class_empty_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 20, "a double, b double")
    m = OneClassSvm(["a", "b"], dims=16, scale=True).fit(df)
    assert len({round(r["one_class_svm"], 9) for r in m.transform(df).collect()}) == 1
    assert OneClassSvm(["a", "b"], dims=16).fit(df.limit(0)).transform(df.limit(0)).count() == 0


def test_one_class_with_empty_partitions(spark):
    rows = [(float(i), float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double")
    spread = spark.createDataFrame(spark.sparkContext.parallelize(rows, 60), "a double, b double")
    assert any(n == 0 for n in spread.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())
    m, whole = (OneClassSvm(["a", "b"], dims=16, scale=True).fit(x) for x in (spread, df.coalesce(1)))
    assert m.rho == pytest.approx(whole.rho) and np.allclose(m.w, whole.w)


def test_weighted_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 7), (2, None)], "y int, p int")
    r = weighted_metrics(df, "y", "p").first()
    # Class 0: 1, 1/2; class 1: 2/3, 1; class 2: 0, 0; two rows of each.
    assert [r["precision"], r["recall"]] == [pytest.approx((1 + 2 / 3) / 3, abs=1e-6), pytest.approx(0.5)]
    plan = weighted_metrics(df, "y", "p")._jdf.queryExecution().toString()
    assert "Join" not in plan.split("== Physical Plan ==")[1]


def test_rows_of_one_partition_are_spread(spark):
    from pulseframe.operators.models import spread
    df = spark.range(0, 1000, 1, 1)
    out = spread(df, task_rows=100)
    assert out.rdd.getNumPartitions() == 10 and sorted(r["id"] for r in out.collect()) == list(range(1000))
    assert spread(df.where("id < 0")).count() == 0
