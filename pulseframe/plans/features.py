"""The activity feature set: time parts, query shape, ratios, flags, group
statistics and fitted outlier thresholds, then rule labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.labels import anomaly_labels
from pulseframe.functions.metrics import metric_ratios, time_features, wait_flags
from pulseframe.functions.text import query_shape
from pulseframe.operators.thresholds import OutlierThresholds
from pulseframe.operators.windows import io_wait_count
from pulseframe.streaming.group_stats import GroupStatistics


WAITS = "avg_io_wait_time"


def duration_profile() -> GroupStatistics:
    """Mean and maximum duration of a query text, to be fitted."""
    return GroupStatistics("query", "duration", "avg_query_duration", "max_query_duration")


def base_features(df: DataFrame, ts: str = "datetimeutc", q: str = "query", profile: GroupStatistics | None = None) -> DataFrame:
    """Row-local and group features.

    The shape features of a query text (length, keyword flags, JOIN count,
    complexity) are computed on one per-text table and joined back once: the
    regexes run per distinct text, not per row. Mean and maximum duration of the
    text come from the same table, or from a fitted ``profile``: a row then has the same
    features in any batch. So has the count of waits of the sample time where ``df`` brings
    it along (``streaming.stream_io_wait_count``); otherwise it is that of the rows of ``df``."""
    if WAITS not in df.columns:
        df = io_wait_count(df, ts)
    if profile is None:
        per_text = df.groupBy(q).agg(F.avg("duration").alias("avg_query_duration"), F.max("duration").alias("max_query_duration"))
    else:
        df = profile.transform(df)
        per_text = df.select(q).distinct()
    per_text = query_shape(per_text, q)
    df = time_features(df, ts)
    df = df.join(per_text, df[q] == per_text[q], "left").select(
        df["*"], *[per_text[c] for c in per_text.columns if c != q])
    df = wait_flags(df)
    return metric_ratios(df)


def labelled(df: DataFrame, thresholds: OutlierThresholds | None = None,
             profile: GroupStatistics | None = None) -> tuple[DataFrame, OutlierThresholds]:
    """Features, outlier flags (fitted on ``df`` unless given) and the rule
    label text ``type_anomalie``."""
    feats = base_features(df, profile=profile)
    if thresholds is None:
        # The thresholds need only the metrics and their ratios: fit on
        # those columns alone, so no quantile pass recomputes the joins.
        thresholds = OutlierThresholds().fit(metric_ratios(df))
    out = thresholds.transform(feats).withColumn("type_anomalie", anomaly_labels())
    return out, thresholds
