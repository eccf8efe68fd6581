import numpy as np
import pandas as pd
import pytest

from pulseframe.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_matches_pandas(spark, p):
    rng = np.random.default_rng(1)
    a = rng.normal(size=3000)
    b = rng.integers(0, 5, size=3000).astype(float)  # heavy ties
    c = np.where(rng.random(3000) < 0.3, np.nan, rng.exponential(size=3000))  # nulls
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, ["a", "b", "c"], p)
    narrowed = exact_quantiles(df, ["a", "b", "c"], p, buckets=2)
    for col in "abc":
        assert got[col] == pytest.approx(pdf[col].quantile(p), rel=1e-12, abs=1e-12)
        assert narrowed[col] == pytest.approx(pdf[col].quantile(p), rel=1e-12, abs=1e-12)


def test_narrowing_rounds(spark):
    """Few buckets make many rounds."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.normal(size=20000), "y": rng.integers(0, 3, size=20000).astype(float)})
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, ["x", "y"], 0.95, buckets=16)
    assert got["x"] == pytest.approx(pdf["x"].quantile(0.95), rel=1e-12)
    assert got["y"] == pytest.approx(pdf["y"].quantile(0.95), rel=1e-12)


def test_all_null_and_single(spark):
    df = spark.createDataFrame([(None, 3.0)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], 0.95)
    assert got == {"a": None, "b": 3.0}


def test_infinities_and_hot_value(spark):
    vals = [float("-inf")] * 5 + [1.0] * 3000 + list(np.linspace(0, 10, 500)) + [float("inf")] * 7
    pdf = pd.DataFrame({"x": vals})
    df = spark.createDataFrame(pdf)
    for p in (0.3, 0.5, 0.95):
        got = exact_quantiles(df, ["x"], p, buckets=8)["x"]
        assert got == pytest.approx(pdf["x"].quantile(p), rel=1e-12)
    assert exact_quantiles(df, ["x"], 0.999, buckets=8)["x"] == float("inf")


def test_heavy_tail_constant_and_signs(spark):
    rng = np.random.default_rng(3)
    n = 20000
    pdf = pd.DataFrame({"tail": np.where(np.arange(n) == 7, 1e300, rng.random(n)), "one": np.full(n, 0.1),
                        "both": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n), "tiny": rng.random(n) * 5e-324 * 9,
                        "close": 1.0 + rng.integers(0, 9, n) * 2.0 ** -52})
    df = spark.createDataFrame(pdf)
    for p in (0.0, 0.03, 0.5, 0.95, 1.0):
        got = exact_quantiles(df, list(pdf.columns), p)
        for c in pdf.columns:
            assert got[c] == pytest.approx(pdf[c].quantile(p), rel=1e-12, abs=0.0)
