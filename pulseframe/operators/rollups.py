"""Roll-ups by query, client, user, backend, context, minute and size.

All are ``groupBy`` aggregates: Spark aggregates partially on the map side,
so a hot group key costs one small row per task before the shuffle. Global
totals are one-row scalar subqueries (``DataFrame.scalar()``), never an
unpartitioned window.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from pulseframe.functions.sizes import parse_size_mb


def _r(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def impute_mean(df: DataFrame, cols) -> DataFrame:
    """Nulls take the column mean (one scalar aggregate for all columns)."""
    means = df.select(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in cols})


def top_queries(df: DataFrame, n: int = 10, prefix: int = 10, impute: bool = True,
                digits: int | None = None) -> DataFrame:
    """Per query prefix: mean cpu, write and read, summed memory; the ``n``
    prefixes with the highest mean cpu (ties by prefix)."""
    metrics = ["cpu", "memory", "read_io", "write_io"]
    if impute:
        df = impute_mean(df, metrics)
    g = (df.withColumn("query", F.substring(F.col("query").cast("string"), 1, prefix))
         .groupBy("query")
         .agg(F.avg("cpu").alias("cpu"), F.avg("write_io").alias("write_io"),
              F.avg("read_io").alias("read_io"), F.sum("memory").alias("memory")))
    top = g.orderBy(F.desc("cpu"), F.asc("query")).limit(n)
    return top.select("query", *(_r(F.col(c), digits).alias(c) for c in ("cpu", "write_io", "read_io", "memory")))


def _epoch_bound(epoch: int, dtype) -> Column:
    """Epoch seconds as a literal of the column's type. For zone-less
    columns the wall clock is the UTC one, built as text so that the
    session time zone plays no part; the literal folds into the scan
    filter."""
    if dtype.typeName() == "timestamp_ntz":
        text = _dt.datetime.fromtimestamp(epoch, _dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        return F.lit(text).cast("timestamp_ntz")
    return F.timestamp_seconds(F.lit(epoch))


def duration_over_time(df: DataFrame, start_epoch=None, end_epoch=None,
                       digits: int | None = None) -> DataFrame:
    """Mean duration per (query, sample time), optionally inside a closed
    range of epoch seconds. The range filter is on a group key, so it is
    applied before the aggregate and reaches the scan."""
    t = F.col("datetimeutc")
    if start_epoch is not None:
        df = df.where(t >= _epoch_bound(start_epoch, df.schema["datetimeutc"].dataType))
    if end_epoch is not None:
        df = df.where(t <= _epoch_bound(end_epoch, df.schema["datetimeutc"].dataType))
    return df.groupBy("query", "datetimeutc").agg(_r(F.avg("duration"), digits).alias("duration"))


def label_load_profile(df: DataFrame, label: str = "predicted_label", n: int = 10,
                       prefix: int = 10, digits: int | None = None) -> DataFrame:
    """Mean cpu, memory, write, read per (query prefix, info text, label);
    the first ``n`` groups in key order."""
    info = F.concat(F.lit("Duration: "), F.col("duration").cast("string"), F.lit("s, Wait: "),
                    F.col("wait").cast("string"), F.lit("s"))
    g = (df.na.drop(subset=["cpu", "memory", "read_io", "write_io", "query"])
         .withColumn("query", F.substring("query", 1, prefix))
         .withColumn("info", info)
         .groupBy("query", "info", label)
         .agg(*[_r(F.avg(c), digits).alias(c) for c in ("cpu", "memory", "write_io", "read_io")]))
    return g.orderBy("query", "info", label).limit(n)


def count_by(df: DataFrame, keys, name: str = "count", drop_null_keys: bool = True) -> DataFrame:
    """Row count per key tuple; rows with a null key are left out by
    default (pandas group-by rule)."""
    keys = list(keys)
    if drop_null_keys:
        df = df.na.drop(subset=keys)
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def per_minute(df: DataFrame, ts: str = "query_start", text: str = "query",
               fill_gaps: bool = False, sep: str = "<br>") -> DataFrame:
    """Per minute: row count and the query texts of the minute.

    The text is built from (text, count) pairs -- ``q (xN)`` joined by
    ``sep`` in text order -- so a minute's string grows with its distinct
    texts, not with its rows: rows are first counted per (minute, text) with
    a map-side partial aggregate. With ``fill_gaps`` every minute between the
    first and the last appears, with count 0 and empty text.
    """
    m = df.where(F.col(ts).isNotNull()).withColumn("minute", trunc_time("minute", df, ts))
    pairs = m.groupBy("minute", text).agg(F.count("*").alias("n"))
    item = F.concat(F.col(text), F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))
    sep_sql = sep.replace("'", "''")
    out = pairs.withColumn("_item", item).groupBy("minute").agg(
        F.sum("n").cast("bigint").alias("query_count"),
        F.expr(f"listagg(_item, '{sep_sql}') WITHIN GROUP (ORDER BY `{text}`)").alias("queries"))
    if not fill_gaps:
        return out
    # The minute grid is built in two steps so that no single task expands
    # the whole time span: hours first (a small table, spread round-robin
    # over the shuffle partitions), then each hour's minutes in parallel.
    bounds = m.agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    hour0 = F.date_trunc("hour", F.col("a")).cast(m.schema["minute"].dataType)
    hours = bounds.select("a", "b", F.explode(F.sequence(hour0, F.col("b"), F.expr("INTERVAL 1 HOUR"))).alias("h"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = hours.repartition(parts).select(F.explode(F.sequence(
        F.greatest("h", "a"), F.least(F.col("h") + F.expr("INTERVAL 59 MINUTES"), F.col("b")),
        F.expr("INTERVAL 1 MINUTE"))).alias("minute"))
    return (grid.join(out, "minute", "left")
            .select("minute", F.coalesce("query_count", F.lit(0).cast("bigint")).alias("query_count"),
                    F.coalesce("queries", F.lit("")).alias("queries")))


def trunc_time(unit: str, df: DataFrame, ts: str) -> Column:
    """``date_trunc`` that keeps a zone-less column zone-less (Spark's
    ``date_trunc`` returns a zoned TIMESTAMP)."""
    t = F.date_trunc(unit, F.col(ts))
    return t.cast("timestamp_ntz") if df.schema[ts].dataType.typeName() == "timestamp_ntz" else t


def time_bounds(df: DataFrame, ts: str = "datetimeutc") -> DataFrame:
    """Min and max sample time, and the same as epoch seconds (zone-less
    times are read as UTC wall clock, whatever the session zone)."""
    b = df.agg(F.min(ts).alias("t_min"), F.max(ts).alias("t_max"))
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        ep = lambda c: F.timestamp_diff("SECOND", origin, F.col(c))
    else:
        ep = lambda c: F.unix_timestamp(F.col(c))
    return b.withColumns({"epoch_min": ep("t_min"), "epoch_max": ep("t_max")})


def day_marks(df: DataFrame, ts: str = "datetimeutc") -> DataFrame:
    """Marks every day from the first sample time up to the last (the first
    mark is the minimum itself, then +1 day while not past the maximum)."""
    b = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return b.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("mark"))


def io_by_context(df: DataFrame) -> DataFrame:
    return df.groupBy("context").agg(
        F.sum("reads").alias("total_reads"), F.sum("writes").alias("total_writes"),
        F.sum("writebacks").alias("total_writebacks"))


def io_by_backend(df: DataFrame) -> DataFrame:
    """Sum of reads + writes + writebacks; a row with any null adds nothing."""
    return df.groupBy("backend_type").agg(
        F.sum(F.col("reads") + F.col("writes") + F.col("writebacks")).alias("total_io_operations"))


def io_melt(df: DataFrame) -> DataFrame:
    """Wide-to-long: one row per (context, operation)."""
    return df.unpivot(["context"], ["total_reads", "total_writes", "total_writebacks"],
                      "operation", "total_operations")


def tables_by_size(df: DataFrame, size_col: str = "total_size") -> DataFrame:
    """Parse the size text to MB, then order by it, largest first."""
    return (df.select("table_name", "schemaname", parse_size_mb(size_col).alias(size_col))
            .orderBy(F.desc(size_col), "table_name", "schemaname"))


def latest_snapshot(df: DataFrame, keys, ts: str) -> DataFrame:
    """The newest row per key, with all its columns. A max aggregate: partial per
    task, so a key with many snapshots never gathers in one task. A row without
    time is older than any; of rows with the same time the one with the
    largest other values counts, compared in column order (nulls smallest). Null
    keys form a group of their own."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    # Null sorts below every value in a struct.
    packed = F.struct(F.col(ts).alias("_ts"), *[F.col(c) for c in others])
    g = df.groupBy(*keys).agg(F.max(packed).alias("_row"))
    return g.select(*keys, *[F.col("_row." + c).alias(c) for c in others])


def table_size_share(df: DataFrame, size_col: str = "total_size", limit_mb: float = 200.0,
                     digits: int | None = None) -> DataFrame:
    """Tables above ``limit_mb`` with their size and share of the total, in %.
    Uses the latest snapshot per table; the total is a scalar subquery."""
    sized = df.select("table_name", parse_size_mb(size_col).alias("size_mb"))
    total = sized.select(F.sum("size_mb")).scalar()
    return (sized.where(F.col("size_mb") > limit_mb)
            .select("table_name", "size_mb",
                    _r(F.col("size_mb") / total * 100, digits).alias("share_pct")))


def duration_histogram(df: DataFrame, x: str = "duration", group: str = "query",
                       bins: int | None = None) -> DataFrame:
    """Counts per (group, bin) over equal-width bins between min and max;
    ``bins`` defaults to ceil(sqrt(n))."""
    stats = df.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"),
                               F.count(x).alias("n")).alias("s")).scalar()
    k = F.lit(bins) if bins else F.ceil(F.sqrt(stats["n"])).cast("bigint")
    width = (stats["hi"] - stats["lo"]) / k
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col(x) - stats["lo"]) / width) + 1, k)).cast("bigint")
    return (df.where(F.col(x).isNotNull()).withColumn("bin", b)
            .groupBy(group, "bin").agg(F.count("*").alias("count")))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Key values that occur more than once, with their count."""
    keys = list(keys)
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def running_share(df: DataFrame, value: str, key: str) -> DataFrame:
    """Share of ``value`` in the grand total (scalar subquery)."""
    total = df.select(F.sum(value)).scalar()
    return df.select(key, value, (F.col(value) / total).alias("share"))


def active_queries(df: DataFrame) -> DataFrame:
    """Currently active queries: text, state and duration."""
    return df.where(F.col("state") == "active").select("query", "state", "duration")


def active_queries_display(df: DataFrame) -> DataFrame:
    """Display form: duration with a unit suffix, state ``Running``."""
    return active_queries(df).select(
        "query", F.lit("Running").alias("state"),
        F.concat(F.col("duration").cast("string"), F.lit(" second")).alias("duration"))


def head_slice(df: DataFrame, n: int, order_by) -> DataFrame:
    """The first ``n`` rows in a stable order (a training slice)."""
    return df.orderBy(*order_by).limit(n)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "F")]
