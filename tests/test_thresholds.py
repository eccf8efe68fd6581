import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseframe.operators.thresholds import OutlierThresholds, SigmaLimit, sigma_flags


@pytest.fixture(scope="module")
def metrics(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"cpu": rng.exponential(10, 2000), "duration": rng.uniform(0, 10, 2000)})
    pdf.loc[::97, "cpu"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def test_outlier_flags_exact_and_approx(spark, metrics):
    pdf, df = metrics
    flags = {"is_high_cpu": "cpu", "is_long_query": "duration"}
    t = OutlierThresholds(flags).fit(df)
    assert t.limits["cpu"] == pytest.approx(pdf["cpu"].quantile(0.95))
    out = t.transform(df).toPandas()
    want = (pdf["cpu"] > pdf["cpu"].quantile(0.95)).astype(int)
    assert out["is_high_cpu"].tolist() == want.tolist()
    assert out["is_long_query"].dtype == bool
    approx = OutlierThresholds(flags, approx=True).fit(df)
    assert approx.limits["cpu"] == pytest.approx(pdf["cpu"].quantile(0.95), rel=0.05)
    back = OutlierThresholds.from_df(t.to_df(spark), flags)
    assert back.limits == pytest.approx(t.limits)


def test_sigma_limit_fitted_and_lazy(spark, metrics):
    pdf, df = metrics
    lim = pdf["cpu"].mean() + 3 * pdf["cpu"].std()
    s = SigmaLimit("cpu").fit(df)
    assert s.limit == pytest.approx(lim)
    a = [r[0] for r in s.transform(df).select("is_anomaly").collect()]
    b = [r[0] for r in sigma_flags(df, "cpu").select("is_anomaly").collect()]
    want = ((pdf["cpu"] >= lim) & pdf["cpu"].notna()).astype(int).tolist()
    assert a == want and b == want
