"""Group statistics attached to rows, back fill, latest row per key.

Statistics of a group are computed with a ``groupBy`` (partial aggregation
on the map side) and joined back on the key. A window partitioned by the key
would send every row of a hot key to one task; the join does not: AQE turns
it into a broadcast join when the statistics table is measured small at run
time, and otherwise splits a skewed key's partition (skew join).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.session import scratch_path


def attach_group_stats(df: DataFrame, keys, aggs: dict[str, Column]) -> DataFrame:
    """Add one column per aggregate of the row's group. Rows with a null key
    get nulls (the key matches no group), as pandas' ``transform`` does."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    cond = [df[k] == stats[k] for k in keys]
    joined = df.join(stats, cond, "left")
    return joined.select(df["*"], *[stats[n] for n in aggs])


def io_wait_count(df: DataFrame, ts: str = "datetimeutc", flag: str = "io_wait",
                  name: str = "avg_io_wait_time") -> DataFrame:
    """Number of rows with ``flag = 'Y'`` at the same sample time, on each row.

    A sample time has few rows, so the per-time table is about as large as
    the data: this is a shuffle join on the time (one exchange of the rows),
    never a broadcast, and a hot time is split by the skew join."""
    return attach_group_stats(df, [ts], {name: F.count_if(F.col(flag) == "Y")})


def query_duration_profile(df: DataFrame, q: str = "query", x: str = "duration") -> DataFrame:
    """Mean and max duration of the same query text, on each row."""
    return attach_group_stats(df, [q], {"avg_query_duration": F.avg(x),
                                        "max_query_duration": F.max(x)})


def backfill(df: DataFrame, cols, partition_by, order_by, block: Column | None = None) -> DataFrame:
    """Each null takes the next non-null value of its partition in
    ``order_by`` order (pandas ``bfill``); trailing nulls stay null.

    ``partition_by`` is required: an unpartitioned ordered window runs in one
    task. ``block`` (a column monotone in ``order_by``, e.g. the hour of a
    time or ``floor(id / 10000)``) splits each partition further, so a hot
    partition key is filled in many tasks: nulls are first filled inside
    (partition, block); the first non-null value of every block is then
    carried back across blocks on the small per-block table, and joined in
    (null partition keys included). Where no block width suits the density
    of the ordering key, ``backfill_ranges`` cuts by row count.
    """
    cols = list(cols)
    pk = list(partition_by)
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    if block is None:
        w = (Window.partitionBy(*pk).orderBy(*[o.desc() for o in order])
             .rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    d = df.withColumn("_blk", block)
    keys = pk + ["_blk"]
    w_in = (Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
            .rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({c: F.last(c, ignorenulls=True).over(w_in) for c in cols})
    # first non-null value of each block: min_by over the ordering key
    okey = F.struct(*order)
    firsts = d.groupBy(*keys).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias("_f_" + c) for c in cols])
    w_blk = (Window.partitionBy(*pk).orderBy(F.col("_blk").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    carry = firsts.select(*keys, *[F.last("_f_" + c, ignorenulls=True).over(w_blk).alias("_n_" + c)
                                   for c in cols])
    out = _null_safe_left(d, carry, keys)
    return out.withColumns({c: F.coalesce(F.col(c), F.col("_n_" + c)) for c in cols}).drop(
        "_blk", *["_n_" + c for c in cols])


def _null_safe_left(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left join on ``keys``, null matching null."""
    other = right.withColumnsRenamed({k: "_k_" + k for k in keys})
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col("_k_" + k))
        cond = one if cond is None else cond & one
    return left.join(other, cond, "left").drop(*["_k_" + k for k in keys])


def backfill_ranges(df: DataFrame, cols, partition_by, order_by, ranges: int | None = None) -> DataFrame:
    """``backfill`` as a segmented scan: rows are dealt to ``ranges`` of about
    equal row counts by (partition, order), whatever the density of the ordering
    key, and written once. Nulls are filled inside each piece (the rows of one
    partition key in one range); the first value of every piece is carried back over the
    pieces of its key on a small table (a row per range and key), and joined in.

    A hot key is so filled in as many tasks as its rows have ranges. Null
    partition keys are a partition of their own, as in the plain form. ``order_by`` must tell
    the rows of a key apart for a defined result; null order values come first."""
    cols, pk = list(cols), list(partition_by)
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.repartitionByRange(n, *pk, *order).sortWithinPartitions(*pk, *order)
             .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    path = scratch_path(spark, f"backfill-{uuid.uuid4().hex}")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    keys = ["_part", *pk]
    inside = Window.partitionBy(*keys).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    # The carry is made from the rows as they are, so neither side waits for the other.
    firsts = dealt.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias("_f_" + c) for c in cols])
    after = Window.partitionBy(*pk).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = firsts.select(*keys, *[F.last("_f_" + c, ignorenulls=True).over(after).alias("_n_" + c) for c in cols])
    filled = dealt.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in cols})
    out = _null_safe_left(filled, carry, keys)
    return out.select(*[F.coalesce(F.col(c), F.col("_n_" + c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys, ts: str) -> DataFrame:
    """Newest row per key (see ``rollups.latest_snapshot`` for the aggregate form)."""
    from pulseframe.operators.rollups import latest_snapshot
    return latest_snapshot(df, keys, ts)
