"""Fitted outlier thresholds: exact 95th percentiles and mean + 3 sd.

``fit`` runs the aggregate once and keeps the limits (one number per metric)
on the driver; ``transform`` compares with literals, so it is a projection
that works on batch and streaming DataFrames alike and folds into the scan's
code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators.quantiles import exact_quantiles

# Flag column -> metric it tests (strictly above the limit).
OUTLIER_FLAGS = {
    "is_long_query": "duration",
    "is_high_cpu": "cpu",
    "is_high_memory": "memory",
    "is_high_read": "read_io",
    "is_high_write": "write_io",
    "is_high_cpu_memory_ratio": "cpu_memory_ratio",
    "is_high_read_write_ratio": "read_write_ratio",
    "is_high_cpu_duration_ratio": "cpu_duration_ratio",
    "is_high_memory_duration_ratio": "memory_duration_ratio",
    "is_high_system_load": "system_load",
}
BOOLEAN_FLAGS = {"is_long_query"}


class OutlierThresholds:
    """``flag = metric > quantile(metric, q)`` for each flag; ``approx``
    replaces the exact quantile by the sketch."""

    def __init__(self, flags: dict | None = None, q: float = 0.95, approx: bool = False):
        self.flags = dict(flags or OUTLIER_FLAGS)
        self.q = q
        self.approx = approx
        self.limits: dict | None = None

    def fit(self, df: DataFrame) -> "OutlierThresholds":
        metrics = sorted(set(self.flags.values()))
        if self.approx:
            row = df.agg(*[F.percentile_approx(m, self.q, 10000).cast("double").alias(m)
                           for m in metrics]).collect()[0]
            self.limits = {m: row[m] for m in metrics}
        else:
            self.limits = exact_quantiles(df, metrics, self.q)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.limits is None:
            raise RuntimeError("fit first")
        out = {}
        for flag, m in self.flags.items():
            lim = self.limits[m]
            above = F.lit(False) if lim is None else F.coalesce(F.col(m) > F.lit(lim), F.lit(False))
            out[flag] = above if flag in BOOLEAN_FLAGS else above.cast("int")
        return df.withColumns(out)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.limits.items()), "metric string, limit double")

    @classmethod
    def from_df(cls, df: DataFrame, flags: dict | None = None, q: float = 0.95) -> "OutlierThresholds":
        t = cls(flags, q)
        t.limits = {r["metric"]: r["limit"] for r in df.collect()}
        return t


class SigmaLimit:
    """``flag = score >= mean + k * sample sd`` with fitted mean and sd."""

    def __init__(self, col: str, k: float = 3.0, out: str = "is_anomaly"):
        self.col, self.k, self.out = col, k, out
        self.limit = None

    def fit(self, df: DataFrame) -> "SigmaLimit":
        r = df.agg(F.avg(self.col).alias("m"), F.stddev_samp(self.col).alias("s")).collect()[0]
        self.mean, self.sd = r["m"], r["s"]
        self.limit = None if r["m"] is None or r["s"] is None else r["m"] + self.k * r["s"]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.limit is None:
            flag = F.lit(0)
        else:
            flag = F.coalesce(F.col(self.col) >= F.lit(self.limit), F.lit(False)).cast("int")
        return df.withColumn(self.out, flag)


def sigma_flags(df: DataFrame, col: str, k: float = 3.0, out: str = "is_anomaly") -> DataFrame:
    """Lazy form: the limit is a scalar subquery, evaluated with the query."""
    lim = df.select(F.avg(col) + F.lit(k) * F.stddev_samp(col)).scalar()
    return df.withColumn(out, F.coalesce(F.col(col) >= lim, F.lit(False)).cast("int"))
