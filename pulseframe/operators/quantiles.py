"""Exact quantiles with linear interpolation, computed without gathering a
column into one task.

Spark's ``percentile`` is exact but keeps every distinct value of the column
in one aggregation buffer; ``percentile_approx`` is bounded but does not
equal pandas' ``quantile``. This module narrows by counting, in the same way
at every size and for all columns at once. Each round is one hash aggregate
(metric, bucket) -> count, smallest and largest value, and keeps the bucket
holding the wanted rank:

1. the first round's buckets are the sign and the logarithm of the value in
   steps of 1/16 octave, so a heavy tail shares no bucket with the rest;
2. later rounds cut the range between the bucket's smallest and largest value
   in equal parts.

A rank is found when its bucket holds one distinct value, or when the rank
and the next one fall in two buckets (the largest value of the one and the
smallest of the other). Every round separates the smallest from the largest
value, so rounds end by themselves. After the first round the bucket's rows
are kept as (metric, value, count): a constant or hot value is one row. The
driver sees at most one row per metric and bucket.

The quantile of ``n`` non-null values at ``p`` is
``v[k] + (v[k+1] - v[k]) * f`` where ``h = (n - 1) * p``, ``k = floor(h)``,
``f = h - k`` and ``v`` is sorted ascending (pandas' and DuckDB's
``quantile_cont`` definition). NaN counts as null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10000
BUCKETS = 4096          # equal parts of a later round
PER_OCTAVE = 16         # buckets of the first round
_BEYOND = 1 << 20       # bucket of the infinities


def to_long(df: DataFrame, cols) -> DataFrame:
    """(metric, v) rows: one per non-null, non-NaN value of each column;
    ``metric`` is the column's position."""
    arr = F.array(*[F.struct(F.lit(i).alias("metric"), F.col(c).cast("double").alias("v"))
                    for i, c in enumerate(cols)])
    long = df.select(F.inline(arr))
    return long.where(F.col("v").isNotNull() & ~F.isnan("v"))


def _log_bucket() -> Column:
    v = F.col("v")
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + F.lit(1 << 16)
    return (F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v) * _BEYOND)
            .otherwise(F.signum(v) * size).cast("int"))


def _counted(rows: DataFrame, bucket: Column, n: Column) -> dict:
    """{metric: [(count, smallest, largest)] in bucket order}."""
    found = rows.groupBy("metric", bucket.alias("b")).agg(
        F.sum(n).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    out: dict = {}
    for r in sorted(found, key=lambda r: r["lo"]):
        out.setdefault(r["metric"], []).append((r["n"], r["lo"], r["hi"]))
    return out


def _locate(buckets: list, k: int):
    """Rank ``k`` within its bucket, the bucket, and the smallest value of the next one."""
    for i, b in enumerate(buckets):
        if k < b[0]:
            return k, b, buckets[i + 1][1] if i + 1 < len(buckets) else None
        k -= b[0]
    raise AssertionError("rank beyond the counted rows")


def exact_quantiles(df: DataFrame, cols, p: float, buckets: int = BUCKETS) -> dict:
    """{column: exact p-quantile} (None for an all-null column)."""
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must lie in [0, 1]")
    if buckets < 2:
        raise ValueError("a round needs two buckets")
    cols = list(cols)
    long = to_long(df, cols)
    per = _counted(long, _log_bucket(), F.lit(1))
    result = {c: None for c in cols}
    state = {}  # metric -> (rank in the bucket, smallest, largest, share of the next rank, value after the bucket)

    def narrow(i: int, counted: list, k: int, f: float, after) -> None:
        k, (n, lo, hi), following = _locate(counted, k)
        after = following if following is not None else after
        if k == n - 1:
            v, nxt = hi, after
        elif lo == hi:
            v, nxt = lo, lo
        else:
            state[i] = (k, lo, hi, f, after)
            return
        state.pop(i, None)
        result[cols[i]] = v if nxt is None or f == 0 or nxt == v else v + (nxt - v) * f

    for i, counted in per.items():
        h = (sum(b[0] for b in counted) - 1) * p
        narrow(i, counted, int(math.floor(h)), h - math.floor(h), None)
    if not state:
        return result
    inside = None
    for i, (_, lo, hi, _, _) in state.items():
        one = (F.col("metric") == i) & F.col("v").between(lo, hi)
        inside = one if inside is None else inside | one
    cells = long.where(inside).groupBy("metric", "v").agg(F.count("*").alias("n")).persist()
    try:
        while state:
            inside, bucket = F.lit(False), F.lit(0)
            for i, (_, lo, hi, _, _) in state.items():
                mine = F.col("metric") == i
                inside = inside | (mine & F.col("v").between(lo, hi))
                part = F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * buckets)
                bucket = F.when(mine, F.least(part, F.lit(buckets - 1)).cast("int")).otherwise(bucket)
            per = _counted(cells.where(inside), bucket, F.col("n"))
            for i, (k, _, _, f, after) in list(state.items()):
                narrow(i, per[i], k, f, after)
    finally:
        cells.unpersist()
    return result


def quantile_table(df: DataFrame, cols, p: float, approx: bool = False,
                   accuracy: int = ACCURACY) -> DataFrame:
    """(metric, quantile) DataFrame; ``approx`` uses the sketch only."""
    cols = list(cols)
    if approx:
        row = df.select(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(p), accuracy).alias(str(i))
                          for i, c in enumerate(cols)]).first()
        vals = dict(zip(cols, row))
    else:
        vals = exact_quantiles(df, cols, p)
    return df.sparkSession.createDataFrame([(c, vals[c]) for c in cols], "metric string, quantile double")
