"""Registry of the queries behind ``__spark_entry__``.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with the
equal SQL for DuckDB (or ``None`` where no SQL form exists). Both read the
same fixtures (``sources.fixtures``); every computed column has the same
alias on both sides, and float aggregates are rounded to ``D`` digits where
engines may sum in a different order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.sources.fixtures import base_table, fixture, with_fixtures

D = 6  # digits kept of float aggregates in compared results


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, ops: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def fx(spark, sf, name):
    return fixture(spark, sf, name)


# --------------------------------------------------------------------------
# Roll-ups, projections, filters
# --------------------------------------------------------------------------

_IMPUTED = """
imp AS (
  SELECT *, coalesce(cpu, avg(cpu) OVER ()) AS cpu_i, coalesce(memory, avg(memory) OVER ()) AS memory_i,
         coalesce(read_io, avg(read_io) OVER ()) AS read_i, coalesce(write_io, avg(write_io) OVER ()) AS write_i
  FROM activity
)
"""


@register("top_queries", with_fixtures("activity") + "," + _IMPUTED + f"""
SELECT substring(query, 1, 10) AS query, round(avg(cpu_i), {D}) AS cpu,
       round(avg(write_i), {D}) AS write_io, round(avg(read_i), {D}) AS read_io,
       round(sum(memory_i), {D}) AS memory
FROM imp GROUP BY substring(query, 1, 10)
ORDER BY avg(cpu_i) DESC, substring(query, 1, 10) LIMIT 10
""", "A3 T1 F7 F19")
def q_top_queries(spark, sf):
    from pulseframe.operators.rollups import top_queries
    return top_queries(fx(spark, sf, "activity"), digits=D)


@register("active_queries", with_fixtures("activity") + """
SELECT query, state, duration FROM activity WHERE state = 'active'
""", "P1 P2")
def q_active_queries(spark, sf):
    from pulseframe.operators.rollups import active_queries
    return active_queries(fx(spark, sf, "activity"))


# 2024-01-03 00:00:00 .. 2024-01-09 12:00:00 UTC as epoch seconds
RANGE_START, RANGE_END = 1704240000, 1704801600


@register("duration_in_range", with_fixtures("activity") + f"""
SELECT query, datetimeutc, round(avg(duration), {D}) AS duration FROM activity
WHERE datetimeutc >= cast(to_timestamp({RANGE_START}) AS timestamp)
  AND datetimeutc <= cast(to_timestamp({RANGE_END}) AS timestamp)
GROUP BY query, datetimeutc
""", "P4 A4")
def q_duration_in_range(spark, sf):
    from pulseframe.operators.rollups import duration_over_time
    return duration_over_time(fx(spark, sf, "activity"), RANGE_START, RANGE_END, digits=D)


@register("query_duration_over_time", with_fixtures("activity") + f"""
SELECT query, datetimeutc, round(avg(duration), {D}) AS duration FROM activity
GROUP BY query, datetimeutc
""", "A4")
def q_duration_over_time(spark, sf):
    from pulseframe.operators.rollups import duration_over_time
    return duration_over_time(fx(spark, sf, "activity"), digits=D)


_SIZE_CASE = """CASE WHEN {x} IS NULL OR {x} = '' THEN 0.0
     WHEN upper(trim({x})) LIKE '%MB' THEN coalesce(try_cast(replace(upper(trim({x})), 'MB', '') AS double), 0.0)
     WHEN upper(trim({x})) LIKE '%KB' THEN coalesce(try_cast(replace(upper(trim({x})), 'KB', '') AS double) * (1.0 / 1024), 0.0)
     WHEN upper(trim({x})) LIKE '%GB' THEN coalesce(try_cast(replace(upper(trim({x})), 'GB', '') AS double) * 1024.0, 0.0)
     WHEN upper(trim({x})) LIKE '%BYTES' THEN coalesce(try_cast(replace(upper(trim({x})), 'BYTES', '') AS double) * (1.0 / 1048576), 0.0)
     ELSE coalesce(try_cast(upper(trim({x})) AS double), 0.0) END"""


def size_sql(x: str) -> str:
    return _SIZE_CASE.format(x=x)


@register("parse_sizes", with_fixtures("user_tables") + f"""
SELECT snapshot_id, total_size, {size_sql('total_size')} AS total_mb,
       {size_sql('table_size')} AS table_mb, {size_sql('indexes_size')} AS indexes_mb
FROM user_tables
""", "F17")
def q_parse_sizes(spark, sf):
    from pulseframe.functions.sizes import parse_size_mb
    return fx(spark, sf, "user_tables").select(
        "snapshot_id", "total_size", parse_size_mb("total_size").alias("total_mb"),
        parse_size_mb("table_size").alias("table_mb"), parse_size_mb("indexes_size").alias("indexes_mb"))


@register("tables_by_size", with_fixtures("user_tables") + f"""
SELECT table_name, schemaname, {size_sql('total_size')} AS total_size
FROM user_tables
""", "T2 T3")
def q_tables_by_size(spark, sf):
    from pulseframe.operators.rollups import tables_by_size
    return tables_by_size(fx(spark, sf, "user_tables"))


_LATEST = """
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY snapshot_id DESC) AS rn
    FROM user_tables) t WHERE rn = 1
)
"""


@register("latest_snapshot", with_fixtures("user_tables") + "," + _LATEST + """
SELECT table_name, snapshot_id, schemaname, total_size, table_size, indexes_size,
       sequential_scans, index_scans FROM latest
""", "W5")
def q_latest_snapshot(spark, sf):
    from pulseframe.operators.rollups import latest_snapshot
    return latest_snapshot(fx(spark, sf, "user_tables"), ["table_name"], "snapshot_id")


@register("oversized_tables", with_fixtures("user_tables") + "," + _LATEST + f""",
sized AS (SELECT table_name, {size_sql('total_size')} AS size_mb FROM latest)
SELECT table_name, size_mb, round(size_mb / (SELECT sum(size_mb) FROM sized) * 100, {D}) AS share_pct
FROM sized WHERE size_mb > 200
""", "P5 J5 A17")
def q_oversized_tables(spark, sf):
    from pulseframe.operators.rollups import latest_snapshot, table_size_share
    latest = latest_snapshot(fx(spark, sf, "user_tables"), ["table_name"], "snapshot_id")
    return table_size_share(latest, digits=D)


@register("table_size_share", with_fixtures("user_tables") + f""",
sized AS (SELECT table_name, {size_sql('total_size')} AS size_mb FROM user_tables)
SELECT table_name, size_mb, round(size_mb / (SELECT sum(size_mb) FROM sized) * 100, {D}) AS share_pct
FROM sized WHERE size_mb > 200
""", "A17")
def q_table_size_share(spark, sf):
    from pulseframe.operators.rollups import table_size_share
    return table_size_share(fx(spark, sf, "user_tables"), digits=D)


@register("drop_incomplete", with_fixtures("stat_activity") + """
SELECT event_id, client_addr, usename, query FROM stat_activity
WHERE client_addr IS NOT NULL AND usename IS NOT NULL
""", "P6")
def q_drop_incomplete(spark, sf):
    return fx(spark, sf, "stat_activity").na.drop(subset=["client_addr", "usename"]).select(
        "event_id", "client_addr", "usename", "query")


@register("drop_any_null", with_fixtures("stat_io") + """
SELECT * FROM stat_io
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND context IS NOT NULL
  AND backend_type IS NOT NULL AND reads IS NOT NULL AND writes IS NOT NULL AND writebacks IS NOT NULL
""", "P7")
def q_drop_any_null(spark, sf):
    return fx(spark, sf, "stat_io").na.drop("any")


@register("io_by_context", with_fixtures("stat_io") + f"""
SELECT context, round(sum(reads), {D}) AS total_reads, round(sum(writes), {D}) AS total_writes,
       round(sum(writebacks), {D}) AS total_writebacks
FROM stat_io GROUP BY context
""", "A1")
def q_io_by_context(spark, sf):
    from pulseframe.operators.rollups import io_by_context
    return io_by_context(fx(spark, sf, "stat_io")).select(
        "context", *[F.round(c, D).alias(c) for c in ("total_reads", "total_writes", "total_writebacks")])


@register("io_by_backend", with_fixtures("stat_io") + f"""
SELECT backend_type, round(sum(reads + writes + writebacks), {D}) AS total_io_operations
FROM stat_io GROUP BY backend_type
""", "A2")
def q_io_by_backend(spark, sf):
    from pulseframe.operators.rollups import io_by_backend
    return io_by_backend(fx(spark, sf, "stat_io")).select(
        "backend_type", F.round("total_io_operations", D).alias("total_io_operations"))


@register("io_melt", with_fixtures("stat_io") + f""",
ctx AS (SELECT context, round(sum(reads), {D}) AS total_reads, round(sum(writes), {D}) AS total_writes,
        round(sum(writebacks), {D}) AS total_writebacks FROM stat_io GROUP BY context)
SELECT context, 'total_reads' AS operation, total_reads AS total_operations FROM ctx
UNION ALL SELECT context, 'total_writes', total_writes FROM ctx
UNION ALL SELECT context, 'total_writebacks', total_writebacks FROM ctx
""", "P15")
def q_io_melt(spark, sf):
    from pulseframe.operators.rollups import io_melt
    return io_melt(q_io_by_context(spark, sf))


@register("queries_by_client", with_fixtures("stat_activity") + """
SELECT client_addr, query, count(*) AS count FROM stat_activity
WHERE client_addr IS NOT NULL AND query IS NOT NULL GROUP BY client_addr, query
""", "A6")
def q_queries_by_client(spark, sf):
    from pulseframe.operators.rollups import count_by
    return count_by(fx(spark, sf, "stat_activity"), ["client_addr", "query"])


@register("queries_by_user_backend", with_fixtures("stat_activity") + """
SELECT backend_type, usename, count(*) AS query_count FROM stat_activity
WHERE backend_type IS NOT NULL AND usename IS NOT NULL GROUP BY backend_type, usename
""", "A7")
def q_queries_by_user_backend(spark, sf):
    from pulseframe.operators.rollups import count_by
    return count_by(fx(spark, sf, "stat_activity"), ["backend_type", "usename"], "query_count")


_PER_MINUTE = """,
pairs AS (SELECT date_trunc('minute', query_start) AS minute, query, count(*) AS n
          FROM stat_activity WHERE query_start IS NOT NULL GROUP BY 1, 2),
pm AS (SELECT minute, cast(sum(n) AS bigint) AS query_count,
              string_agg(concat(query, ' (x', cast(n AS varchar), ')'), '<br>' ORDER BY query) AS queries
       FROM pairs GROUP BY minute)
"""


@register("activity_per_minute", with_fixtures("stat_activity") + _PER_MINUTE + """
SELECT minute, query_count, queries FROM pm
""", "A8 X4")
def q_activity_per_minute(spark, sf):
    from pulseframe.operators.rollups import per_minute
    return per_minute(fx(spark, sf, "stat_activity"))


@register("activity_per_minute_filled", with_fixtures("stat_activity") + _PER_MINUTE + """,
grid AS (SELECT unnest(generate_series((SELECT min(minute) FROM pm), (SELECT max(minute) FROM pm),
                                       INTERVAL 1 MINUTE)) AS minute)
SELECT g.minute, coalesce(pm.query_count, 0) AS query_count, coalesce(pm.queries, '') AS queries
FROM grid g LEFT JOIN pm ON g.minute = pm.minute
""", "A8")
def q_activity_per_minute_filled(spark, sf):
    from pulseframe.operators.rollups import per_minute
    return per_minute(fx(spark, sf, "stat_activity"), fill_gaps=True)


@register("impute_mean", with_fixtures("activity_raw") + f""",
c AS (SELECT event_id, CASE WHEN isnan(try_cast(cpu AS double)) THEN NULL ELSE try_cast(cpu AS double) END AS cpu
      FROM activity_raw)
SELECT event_id, round(coalesce(cpu, (SELECT avg(cpu) FROM c)), {D}) AS cpu FROM c
""", "A9 F19 F1")
def q_impute_mean(spark, sf):
    from pulseframe.functions.casting import to_number
    from pulseframe.operators.rollups import impute_mean
    d = fx(spark, sf, "activity_raw").select("event_id", to_number("cpu").alias("cpu"))
    return impute_mean(d, ["cpu"]).select("event_id", F.round("cpu", D).alias("cpu"))


@register("time_bounds", with_fixtures("activity") + """
SELECT min(datetimeutc) AS t_min, max(datetimeutc) AS t_max,
       cast(epoch(min(datetimeutc)) AS bigint) AS epoch_min, cast(epoch(max(datetimeutc)) AS bigint) AS epoch_max
FROM activity
""", "A10")
def q_time_bounds(spark, sf):
    from pulseframe.operators.rollups import time_bounds
    return time_bounds(fx(spark, sf, "activity"))


@register("day_marks", with_fixtures("activity") + """
SELECT unnest(generate_series(min(datetimeutc), max(datetimeutc), INTERVAL 1 DAY)) AS mark FROM activity
""", "A11")
def q_day_marks(spark, sf):
    from pulseframe.operators.rollups import day_marks
    return day_marks(fx(spark, sf, "activity"))


@register("duration_histogram", with_fixtures("activity") + """,
s AS (SELECT min(duration) AS lo, max(duration) AS hi, cast(ceil(sqrt(count(duration))) AS bigint) AS k FROM activity)
SELECT query, cast(CASE WHEN (hi - lo) / k = 0 THEN 1
                        ELSE least(floor((duration - lo) / ((hi - lo) / k)) + 1, k) END AS bigint) AS bin,
       count(*) AS count
FROM activity, s WHERE duration IS NOT NULL GROUP BY 1, 2
""", "A18")
def q_duration_histogram(spark, sf):
    from pulseframe.operators.rollups import duration_histogram
    return duration_histogram(fx(spark, sf, "activity"))


@register("head_slice", with_fixtures("activity") + """
SELECT event_id, datetimeutc, query FROM activity ORDER BY event_id LIMIT 1000
""", "T4")
def q_head_slice(spark, sf):
    from pulseframe.operators.rollups import head_slice
    return head_slice(fx(spark, sf, "activity").select("event_id", "datetimeutc", "query"), 1000, ["event_id"])


# --------------------------------------------------------------------------
# Scalars and features
# --------------------------------------------------------------------------

@register("time_features", with_fixtures("activity") + """
SELECT event_id, cast(year(datetimeutc) AS int) AS year, cast(month(datetimeutc) AS int) AS month,
       cast(day(datetimeutc) AS int) AS day, cast(hour(datetimeutc) AS int) AS hour,
       cast(minute(datetimeutc) AS int) AS minute, cast(second(datetimeutc) AS int) AS second,
       cast(isodow(datetimeutc) - 1 AS int) AS day_of_week,
       cast(isodow(datetimeutc) - 1 >= 5 AS int) AS is_weekend,
       cast(hour(datetimeutc) BETWEEN 9 AND 17 AS int) AS is_peak_hour
FROM activity
""", "F4 F5 P9")
def q_time_features(spark, sf):
    from pulseframe.functions.metrics import time_features
    cols = ["year", "month", "day", "hour", "minute", "second", "day_of_week", "is_weekend", "is_peak_hour"]
    return time_features(fx(spark, sf, "activity")).select("event_id", *cols)


_NORMALIZE_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(
  regexp_replace(query, '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+', ' ', 'g')), '\\d+', 'NUM', 'g'),
  '\\b\\w{1,2}\\b', '', 'g'), '\\s+', ' ', 'g'))"""


@register("normalize_query", with_fixtures("activity") + f"""
SELECT event_id, {_NORMALIZE_SQL} AS normalized FROM activity
""", "F6")
def q_normalize_query(spark, sf):
    from pulseframe.functions.text import normalize_query
    from pulseframe.operators.textfeatures import per_distinct_text
    a = fx(spark, sf, "activity").select("event_id", "query")
    return per_distinct_text(a, "query", normalize_query, "normalized").select("event_id", "normalized")


_SHAPE_SQL = """cast(length(query) AS int) AS query_length,
  cast(regexp_matches(query, '(?i)JOIN') AS int) AS has_join,
  cast(regexp_matches(query, '(?i)SELECT.*SELECT') AS int) AS has_subselect,
  cast(regexp_matches(query, '(?i)UNION') AS int) AS has_union,
  cast(regexp_matches(query, '(?i)SLEEP') AS int) AS has_sleep,
  cast(regexp_matches(query, '(?i)TRUNCATE') AS int) AS has_truncate,
  cast(regexp_matches(query, '(?i)DROP') AS int) AS has_drop,
  cast(regexp_matches(query, '(?i)DELETE') AS int) AS has_delete,
  cast(regexp_matches(query, '(?i)ALTER') AS int) AS has_alter,
  cast(regexp_matches(query, '(?i)INSERT') AS int) AS has_insert,
  cast(regexp_matches(query, '(?i)UPDATE') AS int) AS has_update,
  cast(len(regexp_extract_all(query, 'JOIN')) AS int) AS num_joins"""


@register("query_shape", with_fixtures("activity") + f""",
s AS (SELECT event_id, {_SHAPE_SQL} FROM activity)
SELECT *, has_join * 2 + has_subselect * 3 + has_union * 2 AS query_complexity_score FROM s
""", "F8 F9 F10 F11")
def q_query_shape(spark, sf):
    from pulseframe.functions.text import QUERY_FLAG_PATTERNS, query_shape
    cols = ["query_length", *QUERY_FLAG_PATTERNS, "num_joins", "query_complexity_score"]
    return query_shape(fx(spark, sf, "activity")).select("event_id", *cols)


_RATIOS_SQL = """cpu / (memory + 1e-6) AS cpu_memory_ratio, read_io / (write_io + 1e-6) AS read_write_ratio,
  cpu / (duration + 1e-6) AS cpu_duration_ratio, memory / (duration + 1e-6) AS memory_duration_ratio,
  (cpu + memory) / 2 AS system_load"""


@register("metric_ratios", with_fixtures("activity") + f"""
SELECT event_id, {_RATIOS_SQL} FROM activity
""", "F12 F13")
def q_metric_ratios(spark, sf):
    from pulseframe.functions.metrics import metric_ratios
    cols = ["cpu_memory_ratio", "read_write_ratio", "cpu_duration_ratio", "memory_duration_ratio", "system_load"]
    return metric_ratios(fx(spark, sf, "activity")).select("event_id", *cols)


@register("wait_flags", with_fixtures("activity") + """
SELECT event_id, cast(io_wait = 'Y' AS int) AS peak_io_wait_time, cast(io_wait = 'Y' AS int) AS is_high_io_wait,
       cast(wait = 'Y' AS int) AS is_wait, 1 AS historical_cpu_utilization, 1 AS historical_memory_utilization
FROM activity
""", "F14 F16")
def q_wait_flags(spark, sf):
    from pulseframe.functions.metrics import wait_flags
    cols = ["peak_io_wait_time", "is_high_io_wait", "is_wait", "historical_cpu_utilization",
            "historical_memory_utilization"]
    return wait_flags(fx(spark, sf, "activity")).select("event_id", *cols)


@register("coerce_metrics", with_fixtures("activity_raw") + """
SELECT event_id,
       CASE WHEN isnan(try_cast(cpu AS double)) THEN NULL ELSE try_cast(cpu AS double) END AS cpu,
       try_cast(memory AS double) AS memory, try_cast(duration AS double) AS duration,
       try_cast(pid AS bigint) AS pid, try_cast(datetimeutc AS timestamp) AS datetimeutc
FROM activity_raw
""", "F1 F2")
def q_coerce_metrics(spark, sf):
    from pulseframe.functions.casting import cast_activity
    d = cast_activity(fx(spark, sf, "activity_raw"), numeric=("cpu", "memory", "duration"))
    return d.select("event_id", "cpu", "memory", "duration", "pid",
                    F.col("datetimeutc").cast("timestamp_ntz").alias("datetimeutc"))


@register("iso_timestamps", with_fixtures("activity") + """
SELECT event_id, CASE WHEN microsecond(datetimeutc) % 1000000 = 0 THEN strftime(datetimeutc, '%Y-%m-%dT%H:%M:%S')
                      ELSE strftime(datetimeutc, '%Y-%m-%dT%H:%M:%S.%f') END AS iso
FROM activity
""", "F21")
def q_iso_timestamps(spark, sf):
    from pulseframe.functions.casting import iso_text
    return fx(spark, sf, "activity").select("event_id", iso_text("datetimeutc").alias("iso"))


_BYTES_EXPR = "l_orderkey * l_partkey * l_partkey * l_linenumber"


def _format_bytes_sql(x: str) -> str:
    parts = [f"WHEN abs({x}) < 10240 THEN concat(cast({x} AS varchar), ' bytes')"]
    units = ["kB", "MB", "GB", "TB", "PB"]
    for i, u in enumerate(units):
        half = f"floor({x} / {float(2 ** (10 * (i + 1) - 1))})"
        txt = f"concat(cast(cast(floor(({half} + 1) / 2) AS bigint) AS varchar), ' {u}')"
        if i < len(units) - 1:
            parts.append(f"WHEN abs({half}) < 20479 THEN {txt}")
        else:
            parts.append(f"ELSE {txt}")
    return "CASE " + " ".join(parts) + " END"


@register("format_bytes", f"""
SELECT l_orderkey, l_linenumber, {_BYTES_EXPR} AS bytes, {_format_bytes_sql(_BYTES_EXPR)} AS pretty
FROM lineitem
""", "F18")
def q_format_bytes(spark, sf):
    from pulseframe.functions.sizes import format_bytes
    li = base_table(spark, sf, "lineitem")
    # Keys of large tables leave the range of a bigint: the product is a decimal,
    # formatted whole; ``bytes`` (a bigint, as in the SQL) is null beyond its range.
    key = F.col("l_orderkey").cast("decimal(19,0)") * F.col("l_linenumber").cast("decimal(10,0)")
    part = F.col("l_partkey").cast("decimal(19,0)")
    b = (key * part).cast("decimal(38,0)") * part
    return li.select("l_orderkey", "l_linenumber", b.try_cast("bigint").alias("bytes"), format_bytes(b).alias("pretty"))


@register("io_wait_count", with_fixtures("activity") + """
SELECT event_id, count(*) FILTER (WHERE io_wait = 'Y') OVER (PARTITION BY datetimeutc) AS avg_io_wait_time
FROM activity
""", "W1 A15")
def q_io_wait_count(spark, sf):
    from pulseframe.operators.windows import io_wait_count
    return io_wait_count(fx(spark, sf, "activity")).select("event_id", "avg_io_wait_time")


@register("io_wait_per_day", with_fixtures("activity") + """
SELECT cast(datetimeutc AS date) AS day, count(*) FILTER (WHERE io_wait = 'Y') AS io_waits FROM activity GROUP BY 1
""", "A15")
def q_io_wait_per_day(spark, sf):
    return fx(spark, sf, "activity").groupBy(F.to_date("datetimeutc").alias("day")).agg(
        F.count_if(F.col("io_wait") == "Y").alias("io_waits"))


@register("query_duration_profile", with_fixtures("activity") + f"""
SELECT event_id, round(avg(duration) OVER (PARTITION BY query), {D}) AS avg_query_duration,
       max(duration) OVER (PARTITION BY query) AS max_query_duration
FROM activity
""", "W2 W3 J2")
def q_query_duration_profile(spark, sf):
    from pulseframe.operators.windows import query_duration_profile
    d = query_duration_profile(fx(spark, sf, "activity"))
    return d.select("event_id", F.round("avg_query_duration", D).alias("avg_query_duration"),
                    "max_query_duration")


@register("backfill", with_fixtures("stat_activity") + """
SELECT event_id, backend_type,
       first_value(client_addr IGNORE NULLS) OVER (PARTITION BY backend_type ORDER BY event_id
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS client_addr,
       first_value(usename IGNORE NULLS) OVER (PARTITION BY backend_type ORDER BY event_id
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS usename
FROM stat_activity
""", "W4")
def q_backfill(spark, sf):
    from pulseframe.operators.windows import backfill
    d = fx(spark, sf, "stat_activity").select("event_id", "backend_type", "client_addr", "usename")
    return backfill(d, ["client_addr", "usename"], ["backend_type"], ["event_id"],
                    block=F.floor(F.col("event_id") / 1000))


@register("backfill_unblocked", with_fixtures("stat_activity") + """
SELECT event_id, backend_type,
       first_value(client_addr IGNORE NULLS) OVER (PARTITION BY backend_type ORDER BY event_id
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS client_addr
FROM stat_activity
""", "W4")
def q_backfill_unblocked(spark, sf):
    from pulseframe.operators.windows import backfill
    d = fx(spark, sf, "stat_activity").select("event_id", "backend_type", "client_addr")
    return backfill(d, ["client_addr"], ["backend_type"], ["event_id"])


# --------------------------------------------------------------------------
# Thresholds and labels
# --------------------------------------------------------------------------

_FEAT = f"""
feat AS (SELECT *, {_RATIOS_SQL} FROM activity)
"""

_P95_METRICS = ["cpu", "cpu_duration_ratio", "cpu_memory_ratio", "duration", "memory",
                "memory_duration_ratio", "read_io", "read_write_ratio", "system_load", "write_io"]


@register("metric_p95", with_fixtures("activity") + "," + _FEAT + "\n" + "\nUNION ALL ".join(
    f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.95), {D}) AS quantile FROM feat" for m in _P95_METRICS),
    "A12")
def q_metric_p95(spark, sf):
    from pulseframe.functions.metrics import metric_ratios
    from pulseframe.operators.quantiles import quantile_table
    feats = metric_ratios(fx(spark, sf, "activity"))
    return quantile_table(feats, _P95_METRICS, 0.95).select(
        "metric", F.round("quantile", D).alias("quantile"))


_TAIL_EXPRS = ["CASE WHEN event_id % 1000 = 7 THEN 1e300 ELSE cpu END AS tail",
               "CASE WHEN event_id % 2 = 0 THEN -duration ELSE duration / 1e200 END AS signs",
               "cast(0.1 AS double) AS constant", "CASE WHEN event_id % 3 > 0 THEN 7.5 ELSE memory END AS hot"]
_TAIL = ["tail", "signs", "constant", "hot"]


@register("quantile_heavy_tail", with_fixtures("activity") + f",\nt AS (SELECT {', '.join(_TAIL_EXPRS)} FROM activity)\n"
          + "\nUNION ALL ".join(f"SELECT '{m}' AS metric, cast({p} AS double) AS p, quantile_cont({m}, {p}) AS quantile FROM t"
                                for m in _TAIL for p in (0.05, 0.5, 0.95)), "A12")
def q_quantile_heavy_tail(spark, sf):
    """Columns that equal-width cuts can't narrow: a far tail, magnitudes of
    both signs, a constant, one value in two thirds of the rows."""
    from pulseframe.operators.quantiles import quantile_table
    t = fx(spark, sf, "activity").selectExpr(*_TAIL_EXPRS)
    out = None
    for p in (0.05, 0.5, 0.95):
        q = quantile_table(t, _TAIL, p).select("metric", F.lit(p).alias("p"), "quantile")
        out = q if out is None else out.unionByName(q)
    return out


_LIMITS = "lim AS (SELECT " + ", ".join(
    f"quantile_cont({m}, 0.95) AS l_{m}" for m in _P95_METRICS) + " FROM feat)"

_FLAGS_SQL = """duration > l_duration AS is_long_query,
  cast(coalesce(cpu > l_cpu, false) AS int) AS is_high_cpu,
  cast(coalesce(memory > l_memory, false) AS int) AS is_high_memory,
  cast(coalesce(read_io > l_read_io, false) AS int) AS is_high_read,
  cast(coalesce(write_io > l_write_io, false) AS int) AS is_high_write,
  cast(coalesce(cpu_memory_ratio > l_cpu_memory_ratio, false) AS int) AS is_high_cpu_memory_ratio,
  cast(coalesce(read_write_ratio > l_read_write_ratio, false) AS int) AS is_high_read_write_ratio,
  cast(coalesce(cpu_duration_ratio > l_cpu_duration_ratio, false) AS int) AS is_high_cpu_duration_ratio,
  cast(coalesce(memory_duration_ratio > l_memory_duration_ratio, false) AS int) AS is_high_memory_duration_ratio,
  cast(coalesce(system_load > l_system_load, false) AS int) AS is_high_system_load"""

_FLAG_NAMES = ["is_long_query", "is_high_cpu", "is_high_memory", "is_high_read", "is_high_write",
               "is_high_cpu_memory_ratio", "is_high_read_write_ratio", "is_high_cpu_duration_ratio",
               "is_high_memory_duration_ratio", "is_high_system_load"]


@register("outlier_flags", with_fixtures("activity") + "," + _FEAT + "," + _LIMITS + f"""
SELECT event_id, {_FLAGS_SQL} FROM feat, lim
""", "A12 F15")
def q_outlier_flags(spark, sf):
    from pulseframe.functions.metrics import metric_ratios
    from pulseframe.operators.thresholds import OutlierThresholds
    feats = metric_ratios(fx(spark, sf, "activity"))
    t = OutlierThresholds().fit(feats)
    return t.transform(feats).select("event_id", *_FLAG_NAMES)


_LABEL_RULES_SQL = [
    ("is_high_cpu = 1", "High CPU Usage"),
    ("is_high_memory = 1", "High Memory Usage"),
    ("is_high_read = 1", "High Disk Read"),
    ("is_high_write = 1", "High Disk Write"),
    ("is_high_cpu_memory_ratio = 1", "High CPU to Memory Ratio"),
    ("is_high_read_write_ratio = 1", "High Read to Write Ratio"),
    ("is_high_cpu_duration_ratio = 1", "High CPU to Duration Ratio"),
    ("is_high_memory_duration_ratio = 1", "High Memory to Duration Ratio"),
    ("is_long_query", "Long Running Query"),
    ("wait = 'Y' AND is_long_query", "Potential Deadlock"),
    ("is_high_cpu = 1 AND is_high_memory = 1", "High Resource Utilization"),
    ("is_high_system_load = 1", "High System Load"),
    ("is_high_io_wait = 1", "High IO Wait"),
    ("has_join = 1", "Join Query Needs Optimization"),
    ("avg_io_wait_time > 10", "High IO Wait Time"),
]

_LABELLED = with_fixtures("activity") + "," + _FEAT + "," + _LIMITS + f""",
flg AS (
  SELECT feat.*, {_FLAGS_SQL},
         cast(io_wait = 'Y' AS int) AS is_high_io_wait,
         cast(regexp_matches(query, '(?i)JOIN') AS int) AS has_join,
         count(*) FILTER (WHERE io_wait = 'Y') OVER (PARTITION BY datetimeutc) AS avg_io_wait_time
  FROM feat, lim
),
lab AS (
  SELECT *, coalesce(nullif(concat_ws(', ', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _LABEL_RULES_SQL)}), ''),
                     'Normal') AS type_anomalie
  FROM flg
)
"""


@register("assign_labels", _LABELLED + """
SELECT event_id, type_anomalie FROM lab
""", "F23")
def q_assign_labels(spark, sf):
    return _labelled(spark, sf).select("event_id", "type_anomalie")


def _labelled(spark, sf):
    from pulseframe.plans.features import labelled
    out, _ = labelled(fx(spark, sf, "activity"))
    return out


@register("distinct_labels", _LABELLED + """
SELECT DISTINCT type_anomalie FROM lab
""", "A16")
def q_distinct_labels(spark, sf):
    return _labelled(spark, sf).select("type_anomalie").distinct()


@register("label_load_profile", _LABELLED + f"""
SELECT substring(query, 1, 10) AS query,
       concat('Duration: ', cast(duration AS varchar), 's, Wait: ', wait, 's') AS info,
       type_anomalie, round(avg(cpu), {D}) AS cpu, round(avg(memory), {D}) AS memory,
       round(avg(write_io), {D}) AS write_io, round(avg(read_io), {D}) AS read_io
FROM lab WHERE cpu IS NOT NULL AND memory IS NOT NULL AND read_io IS NOT NULL AND write_io IS NOT NULL
  AND query IS NOT NULL
GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 10
""", "A5 T5 P10")
def q_label_load_profile(spark, sf):
    from pulseframe.operators.rollups import label_load_profile
    return label_load_profile(_labelled(spark, sf), label="type_anomalie", digits=D)


@register("three_sigma", with_fixtures("activity") + """
SELECT event_id, cpu AS score,
       cast(coalesce(cpu >= (SELECT avg(cpu) + 3 * stddev_samp(cpu) FROM activity), false) AS int) AS is_anomaly
FROM activity
""", "A14 M15")
def q_three_sigma(spark, sf):
    from pulseframe.operators.thresholds import sigma_flags
    d = fx(spark, sf, "activity").select("event_id", F.col("cpu").alias("score"))
    return sigma_flags(d, "score")


@register("label_dimension", _LABELLED + """,
dim AS (SELECT * FROM (VALUES ('Normal', 0), ('High CPU Usage', 2), ('High IO Wait', 1),
                              ('Join Query Needs Optimization', 1)) t(label, severity)),
first_label AS (SELECT event_id, split_part(type_anomalie, ', ', 1) AS label FROM lab)
SELECT f.event_id, f.label, d.severity FROM first_label f LEFT JOIN dim d ON f.label = d.label
""", "J4")
def q_label_dimension(spark, sf):
    # Label -> severity dimension used by the lookup example.
    dim = spark.createDataFrame([("Normal", 0), ("High CPU Usage", 2), ("High IO Wait", 1),
                                 ("Join Query Needs Optimization", 1)], "label string, severity int")
    first = _labelled(spark, sf).select(
        "event_id", F.split_part("type_anomalie", F.lit(", "), F.lit(1)).alias("label"))
    return first.join(F.broadcast(dim), "label", "left").select("event_id", "label", "severity")


# --------------------------------------------------------------------------
# Sources: lines, messages
# --------------------------------------------------------------------------

_SPLIT_SQL = """,
sp AS (SELECT event_id, string_split(line, ';') AS p FROM activity_raw)
"""
_FIELDS = ["datetimeutc", "pid", "database_name", "appname", "user_name", "client", "cpu", "memory",
           "read_io", "write_io", "duration", "wait", "io_wait", "state"]


def _field_sql(i: int, name: str) -> str:
    raw = f"trim(p[{i + 1}], '\"')"
    if name in ("cpu", "memory", "read_io", "write_io", "duration"):
        return f"CASE WHEN isnan(try_cast({raw} AS double)) THEN NULL ELSE try_cast({raw} AS double) END AS {name}"
    if name == "pid":
        return f"cast(try_cast({raw} AS double) AS bigint) AS pid"
    if name == "datetimeutc":
        return f"try_cast({raw} AS timestamp) AS datetimeutc"
    return f"{raw} AS {name}"


@register("parse_activity_line", with_fixtures("activity_raw") + _SPLIT_SQL + "SELECT event_id, "
          + ", ".join(_field_sql(i, n) for i, n in enumerate(_FIELDS))
          + """, trim(array_to_string(list_slice(p, 15, 1000000), ';'), '"') AS query
FROM sp WHERE len(p) >= 14
""", "S1 S3 S5 F1 F2")
def q_parse_activity_line(spark, sf):
    from pulseframe.sources.activity_lines import parse_activity
    good, _ = parse_activity(fx(spark, sf, "activity_raw").select("event_id", "line"))
    return good.withColumn("datetimeutc", F.col("datetimeutc").cast("timestamp_ntz"))


@register("reject_short_lines", with_fixtures("activity_raw") + """
SELECT event_id, line FROM activity_raw WHERE len(string_split(line, ';')) < 14
""", "S4")
def q_reject_short_lines(spark, sf):
    from pulseframe.sources.activity_lines import parse_activity
    _, rejected = parse_activity(fx(spark, sf, "activity_raw").select("event_id", "line"))
    return rejected


_ENV_TYPE = "CASE WHEN l_orderkey % 2 = 0 THEN 'pg_stat_context_io' ELSE 'pg_stat_io_activity' END"
_ENV_COLS = ["l_orderkey", "l_linenumber", "context", "backend_type", "reads", "writes", "writebacks"]
_ENV_SCHEMA = ("l_orderkey BIGINT, l_linenumber INT, context STRING, backend_type STRING, "
               "reads DOUBLE, writes DOUBLE, writebacks DOUBLE")


def _envelopes(spark, sf):
    from pulseframe.sources.messages import decode_envelopes, encode_envelopes
    msgs = encode_envelopes(fx(spark, sf, "stat_io"), F.expr(_ENV_TYPE), ["l_orderkey"], _ENV_COLS)
    return decode_envelopes(msgs, _ENV_SCHEMA)


@register("decode_messages", with_fixtures("stat_io") + f"""
SELECT {_ENV_TYPE} AS type_query, {", ".join(_ENV_COLS)} FROM stat_io
""", "S8 S9 F20 F22")
def q_decode_messages(spark, sf):
    from pulseframe.sources.messages import explode_envelopes
    return explode_envelopes(_envelopes(spark, sf))


@register("route_by_type", with_fixtures("stat_io") + f"""
SELECT {", ".join(_ENV_COLS)} FROM stat_io WHERE {_ENV_TYPE} = 'pg_stat_io_activity'
""", "P14")
def q_route_by_type(spark, sf):
    from pulseframe.sources.messages import explode_envelopes, route
    return explode_envelopes(route(_envelopes(spark, sf), "pg_stat_io_activity")).drop("type_query")


@register("encode_messages", with_fixtures("activity") + """
SELECT event_id, datetimeutc, pid, client, cpu, state, query FROM activity
""", "S8 F20")
def q_encode_messages(spark, sf):
    from pulseframe.sources.messages import decode_records, encode_records
    a = fx(spark, sf, "activity").select("event_id", "datetimeutc", "pid", "client", "cpu", "state", "query")
    enc = encode_records(a, ["event_id"])
    return decode_records(enc, "event_id BIGINT, datetimeutc TIMESTAMP_NTZ, pid BIGINT, client STRING, "
                               "cpu DOUBLE, state STRING, query STRING")


# --------------------------------------------------------------------------
# Checks, changes, sets, encodings
# --------------------------------------------------------------------------

def _users_rules():
    from pulseframe.operators.checks import in_domain, in_range, not_null
    return [not_null("username"), not_null("email"), not_null("firstname"), not_null("age")], \
        [in_range("age", 18, 68)], [in_domain("gender", ["M", "F"])]


@register("check_not_null", with_fixtures("users") + """
SELECT 'not_null:username' AS rule, count(*) FILTER (WHERE username IS NULL) AS violations FROM users
UNION ALL SELECT 'not_null:email', count(*) FILTER (WHERE email IS NULL) FROM users
UNION ALL SELECT 'not_null:firstname', count(*) FILTER (WHERE firstname IS NULL) FROM users
UNION ALL SELECT 'not_null:age', count(*) FILTER (WHERE age IS NULL) FROM users
""", "D1")
def q_check_not_null(spark, sf):
    from pulseframe.operators.checks import check
    return check(fx(spark, sf, "users"), _users_rules()[0])


@register("check_range", with_fixtures("users") + """
SELECT 'range:age' AS rule, count(*) FILTER (WHERE age IS NOT NULL AND NOT (age BETWEEN 18 AND 68)) AS violations
FROM users
""", "D3")
def q_check_range(spark, sf):
    from pulseframe.operators.checks import check
    return check(fx(spark, sf, "users"), _users_rules()[1])


@register("check_domain", with_fixtures("users") + """
SELECT 'domain:gender' AS rule, count(*) FILTER (WHERE gender IS NOT NULL AND gender NOT IN ('M', 'F')) AS violations
FROM users
""", "D4")
def q_check_domain(spark, sf):
    from pulseframe.operators.checks import check
    return check(fx(spark, sf, "users"), _users_rules()[2])


@register("duplicate_keys", with_fixtures("posts") + """
SELECT user_id, count(*) AS count FROM posts GROUP BY user_id HAVING count(*) > 1
""", "A19 D2")
def q_duplicate_keys(spark, sf):
    from pulseframe.operators.rollups import duplicate_keys
    return duplicate_keys(fx(spark, sf, "posts"), ["user_id"])


@register("key_violations", with_fixtures("users") + """
SELECT email, count(*) AS count FROM users GROUP BY email HAVING count(*) > 1 OR email IS NULL
""", "D2")
def q_key_violations(spark, sf):
    from pulseframe.operators.checks import key_violations
    return key_violations(fx(spark, sf, "users"), ["email"])


@register("fk_orphans", with_fixtures("users", "posts") + """
SELECT p.id, p.user_id FROM posts p WHERE p.user_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = p.user_id)
""", "J3 D5")
def q_fk_orphans(spark, sf):
    from pulseframe.operators.checks import fk_orphans
    return fk_orphans(fx(spark, sf, "posts").select("id", "user_id"), fx(spark, sf, "users"), "user_id", "id")


@register("snapshot_diff", with_fixtures("orders_old", "orders_new") + """
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'INSERT' WHEN n.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation,
       o.o_orderstatus AS old_status, n.o_orderstatus AS new_status
FROM orders_old o FULL OUTER JOIN orders_new n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL
   OR o.o_custkey IS DISTINCT FROM n.o_custkey OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus
   OR o.o_totalprice IS DISTINCT FROM n.o_totalprice
""", "X8")
def q_snapshot_diff(spark, sf):
    from pulseframe.operators.changes import snapshot_diff
    d = snapshot_diff(fx(spark, sf, "orders_old"), fx(spark, sf, "orders_new"), ["o_orderkey"])
    return d.select("o_orderkey", "operation",
                    F.get_json_object("old_data", "$.o_orderstatus").alias("old_status"),
                    F.get_json_object("new_data", "$.o_orderstatus").alias("new_status"))


@register("change_alerts", with_fixtures("change_events") + """
SELECT event_id, table_name, operation,
       concat('Changes in ', json_extract_string(payload, '$.table'), ' table') AS subject,
       concat('Operation: ', json_extract_string(payload, '$.operation'),
              chr(10), 'Old Data: ', coalesce(cast(json_extract(payload, '$.old_data') AS varchar), 'null'),
              chr(10), 'New Data: ', coalesce(cast(json_extract(payload, '$.new_data') AS varchar), 'null')) AS body
FROM change_events
""", "X7")
def q_change_alerts(spark, sf):
    from pulseframe.operators.changes import change_alerts
    return change_alerts(fx(spark, sf, "change_events"))


@register("append_by_name", with_fixtures("activity", "stat_activity") + """
SELECT event_id, query, client_addr FROM stat_activity
UNION ALL BY NAME
SELECT event_id, query, cpu FROM activity
""", "U1")
def q_append_by_name(spark, sf):
    from pulseframe.operators.sets import append_by_name
    return append_by_name(fx(spark, sf, "stat_activity").select("event_id", "query", "client_addr"),
                          fx(spark, sf, "activity").select("event_id", "query", "cpu"))


_SPLIT_DAY = "2024-01-03 00:00:00"


def _periods(spark, sf):
    a = fx(spark, sf, "activity")
    cut = F.lit(_SPLIT_DAY).cast("timestamp_ntz")
    return a.where(F.col("datetimeutc") < cut), a.where(F.col("datetimeutc") >= cut)


@register("unseen_categories", with_fixtures("activity") + f"""
SELECT DISTINCT query FROM activity WHERE datetimeutc >= TIMESTAMP '{_SPLIT_DAY}'
EXCEPT SELECT query FROM activity WHERE datetimeutc < TIMESTAMP '{_SPLIT_DAY}'
""", "U2")
def q_unseen_categories(spark, sf):
    from pulseframe.operators.sets import unseen_values
    old, new = _periods(spark, sf)
    return unseen_values(new, old, "query")


@register("extend_categories", with_fixtures("activity") + f"""
SELECT query FROM activity WHERE datetimeutc < TIMESTAMP '{_SPLIT_DAY}' AND query IS NOT NULL
UNION SELECT query FROM activity WHERE datetimeutc >= TIMESTAMP '{_SPLIT_DAY}' AND query IS NOT NULL
""", "U3")
def q_extend_categories(spark, sf):
    from pulseframe.operators.sets import extend_values
    old, new = _periods(spark, sf)
    return extend_values(old, new, "query")


@register("encode_categories", with_fixtures("activity") + """
SELECT value, cast(dense_rank() OVER (ORDER BY value) - 1 AS int) AS code
FROM (SELECT DISTINCT client AS value FROM activity WHERE client IS NOT NULL) t
""", "F24")
def q_encode_categories(spark, sf):
    from pulseframe.operators.encoding import category_codes
    return category_codes(fx(spark, sf, "activity"), "client")


@register("encode_query_codes", with_fixtures("activity") + """
SELECT value, cast(dense_rank() OVER (ORDER BY value) - 1 AS int) AS code
FROM (SELECT DISTINCT query AS value FROM activity WHERE query IS NOT NULL) t
""", "F24")
def q_encode_query_codes(spark, sf):
    from pulseframe.operators.encoding import category_codes
    return category_codes(fx(spark, sf, "activity"), "query")


@register("align_features", with_fixtures("activity") + """
SELECT event_id, cpu, memory, 0 AS gpu_load, duration FROM activity
""", "P12 P8")
def q_align_features(spark, sf):
    from pulseframe.operators.encoding import align_features
    return align_features(fx(spark, sf, "activity"), ["event_id", "cpu", "memory", "cpu", "gpu_load", "duration"])


# --------------------------------------------------------------------------
# Text features
# --------------------------------------------------------------------------

_NORM_CTE = f""",
nq AS (SELECT event_id, datetimeutc, {_NORMALIZE_SQL} AS q FROM activity),
tok AS (SELECT event_id, datetimeutc, unnest(regexp_extract_all(lower(q), '\\b\\w\\w+\\b')) AS term FROM nq)
"""


def _normalized(spark, sf):
    from pulseframe.functions.text import normalize_query
    return fx(spark, sf, "activity").select("event_id", "datetimeutc", normalize_query("query").alias("q"))


@register("term_counts", with_fixtures("activity") + _NORM_CTE + """
SELECT event_id, term, count(*) AS tf FROM tok GROUP BY event_id, term
""", "M1")
def q_term_counts(spark, sf):
    from pulseframe.functions.text import normalize_query
    from pulseframe.operators.textfeatures import term_counts
    return term_counts(fx(spark, sf, "activity"), "event_id", "query", preprocess=normalize_query, dedup=True)


@register("tfidf", with_fixtures("activity") + _NORM_CTE + f""",
tc AS (SELECT event_id, term, count(*) AS tf FROM tok GROUP BY event_id, term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM activity)) / (count(*) + 1)) + 1 AS idf FROM tc GROUP BY term),
w AS (SELECT tc.event_id, tc.term, tc.tf, idf.idf, tc.tf * idf.idf AS w FROM tc JOIN idf ON tc.term = idf.term)
SELECT event_id, term, tf, round(idf, {D}) AS idf,
       round(w / sqrt(sum(w * w) OVER (PARTITION BY event_id)), {D}) AS weight
FROM w
""", "M2")
def q_tfidf(spark, sf):
    from pulseframe.functions.text import normalize_query
    from pulseframe.operators.textfeatures import Tfidf
    d = fx(spark, sf, "activity").select("event_id", "query")
    out = Tfidf("event_id", "query", preprocess=normalize_query, dedup=True).fit_transform(d)
    return out.select("event_id", "term", "tf", F.round("idf", D).alias("idf"), F.round("weight", D).alias("weight"))


@register("unseen_terms", with_fixtures("activity") + _NORM_CTE + f"""
SELECT DISTINCT term FROM tok WHERE datetimeutc >= TIMESTAMP '{_SPLIT_DAY}'
EXCEPT SELECT term FROM tok WHERE datetimeutc < TIMESTAMP '{_SPLIT_DAY}'
""", "U4")
def q_unseen_terms(spark, sf):
    from pulseframe.operators.textfeatures import vocabulary_gaps
    d = _normalized(spark, sf)
    cut = F.lit(_SPLIT_DAY).cast("timestamp_ntz")
    from pulseframe.operators.textfeatures import tokens
    vocab = d.where(F.col("datetimeutc") < cut).select(F.explode(tokens("q")).alias("term")).distinct()
    return vocabulary_gaps(d.where(F.col("datetimeutc") >= cut), vocab, "event_id", "q")


# Example sentiment lexicon (term, weight), a user parameter.
LEXICON = [("good", 1.9), ("great", 3.1), ("happy", 2.7), ("love", 3.2), ("best", 3.2),
           ("nice", 1.8), ("clean", 1.7), ("free", 1.3), ("bad", -2.5), ("worst", -3.1),
           ("hate", -2.7), ("error", -1.7), ("drop", -1.1), ("delete", -1.0), ("kill", -3.7),
           ("fail", -2.3), ("slow", -1.2), ("union", 0.4), ("join", 0.6), ("insert", 0.3)]


def _lexicon_sql() -> str:
    rows = ", ".join(f"('{t}', {w})" for t, w in LEXICON)
    return f"lex AS (SELECT * FROM (VALUES {rows}) t(term, weight))"


def _lexicon_score_sql(src: str, doc: str, text: str) -> str:
    return f""",
{_lexicon_sql()},
t AS (SELECT {doc}, unnest(regexp_extract_all(lower({text}), '[a-z][a-z]+')) AS term FROM {src}),
d AS (SELECT {doc} FROM {src}),
s AS (SELECT t.{doc}, coalesce(lex.weight, 0.0) AS s FROM t LEFT JOIN lex ON t.term = lex.term),
g AS (SELECT d.{doc}, coalesce(sum(s), 0.0) AS s,
             coalesce(sum(CASE WHEN s > 0 THEN s + 1 ELSE 0.0 END), 0.0) AS pos_sum,
             coalesce(sum(CASE WHEN s < 0 THEN s - 1 ELSE 0.0 END), 0.0) AS neg_sum,
             count(s) FILTER (WHERE s = 0) AS neu_n
      FROM d LEFT JOIN s ON d.{doc} = s.{doc} GROUP BY d.{doc}),
r AS (SELECT *, pos_sum + abs(neg_sum) + neu_n AS total,
             CASE WHEN s = 0 THEN 0.0 ELSE s / sqrt(s * s + 15.0) END AS comp FROM g)
SELECT {doc},
       CASE WHEN total > 0 THEN round(abs(neg_sum) / total, 3) ELSE 0.0 END AS neg,
       CASE WHEN total > 0 THEN round(abs(neu_n) / total, 3) ELSE 0.0 END AS neu,
       CASE WHEN total > 0 THEN round(abs(pos_sum) / total, 3) ELSE 0.0 END AS pos,
       round(comp, 4) AS compound, cast(comp > 0 AS int) AS is_positive
FROM r
"""


def _lexicon_df(spark):
    return spark.createDataFrame(LEXICON, "term string, weight double")


@register("lexicon_score", with_fixtures("activity") + _lexicon_score_sql("activity", "event_id", "query"), "M3")
def q_lexicon_score(spark, sf):
    from pulseframe.operators.textfeatures import lexicon_scores
    return lexicon_scores(fx(spark, sf, "activity"), "event_id", "query", _lexicon_df(spark),
                          pattern="[a-z][a-z]+", dedup=True)


@register("document_sentiment", "WITH x AS (SELECT 1)" + _lexicon_score_sql("documents", "doc_id", "text"), "M3")
def q_document_sentiment(spark, sf):
    from pulseframe.operators.textfeatures import lexicon_scores
    return lexicon_scores(base_table(spark, sf, "documents"), "doc_id", "text", _lexicon_df(spark),
                          pattern="[a-z][a-z]+")


# --------------------------------------------------------------------------
# Models and metrics
# --------------------------------------------------------------------------

@register("standardize", with_fixtures("activity") + f"""
SELECT event_id,
       round((cpu - avg(cpu) OVER ()) / CASE WHEN coalesce(stddev_pop(cpu) OVER (), 0) = 0 THEN 1.0 ELSE stddev_pop(cpu) OVER () END, {D}) AS cpu,
       round((memory - avg(memory) OVER ()) / CASE WHEN coalesce(stddev_pop(memory) OVER (), 0) = 0 THEN 1.0 ELSE stddev_pop(memory) OVER () END, {D}) AS memory,
       round((duration - avg(duration) OVER ()) / CASE WHEN coalesce(stddev_pop(duration) OVER (), 0) = 0 THEN 1.0 ELSE stddev_pop(duration) OVER () END, {D}) AS duration
FROM activity
""", "M4")
def q_standardize(spark, sf):
    from pulseframe.operators.models import standardize
    cols = ["cpu", "memory", "duration"]
    d = standardize(fx(spark, sf, "activity").select("event_id", *cols), cols)
    return d.select("event_id", *[F.round(c, D).alias(c) for c in cols])


@register("majority_vote", with_fixtures("activity") + """
SELECT event_id, cast(cpu > 100 AS int) AS p1, cast(memory > 50 AS int) AS p2, cast(duration > 5 AS int) AS p3,
       cast(cast(cpu > 100 AS int) + cast(memory > 50 AS int) + cast(duration > 5 AS int) >= 2 AS int) AS vote
FROM activity
""", "M14")
def q_majority_vote(spark, sf):
    from pulseframe.operators.models import majority_vote
    a = fx(spark, sf, "activity").select(
        "event_id", (F.col("cpu") > 100).cast("int").alias("p1"), (F.col("memory") > 50).cast("int").alias("p2"),
        (F.col("duration") > 5).cast("int").alias("p3"))
    return a.withColumn("vote", majority_vote("p1", "p2", "p3"))


# Example centroids in (cpu, memory, duration) space.
CENTROIDS = [[20.0, 30.0, 2.0], [150.0, 80.0, 8.0]]


def _centroid_sql():
    parts = []
    for c in CENTROIDS:
        parts.append("sqrt((cpu - {0}) * (cpu - {0}) + (memory - {1}) * (memory - {1}) + "
                     "(duration - {2}) * (duration - {2}))".format(*c))
    return "least(" + ", ".join(parts) + ")"


@register("centroid_outliers", with_fixtures("activity") + f""",
d AS (SELECT event_id, {_centroid_sql()} AS distance FROM activity)
SELECT event_id, round(distance, {D}) AS distance,
       cast(coalesce(distance > (SELECT quantile_cont(distance, 0.95) FROM d), false) AS int) AS is_outlier
FROM d
""", "M9 A13")
def q_centroid_outliers(spark, sf):
    from pulseframe.operators.models import centroid_outliers
    d = centroid_outliers(fx(spark, sf, "activity"), ["cpu", "memory", "duration"], CENTROIDS)
    return d.select("event_id", F.round("distance", D).alias("distance"), "is_outlier")


_LABEL_JOIN_SQL = """
j AS (SELECT l.doc_id, l.quality, l.toxic, l.quality * 2 + l.toxic AS y,
             CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS p,
             CASE WHEN d.n_chars >= 1000 THEN 2 ELSE 0 END + CASE WHEN d.lang = 'en' THEN 0 ELSE 1 END AS pm
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def _label_join(spark, sf):
    lab = base_table(spark, sf, "labels")
    doc = base_table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", "quality", "toxic", (F.col("quality") * 2 + F.col("toxic")).alias("y"),
                    (F.col("n_chars") >= 1000).cast("int").alias("p"),
                    (F.when(F.col("n_chars") >= 1000, 2).otherwise(0)
                     + F.when(F.col("lang") == "en", 0).otherwise(1)).alias("pm"))


@register("accuracy", "WITH " + _LABEL_JOIN_SQL + """
SELECT avg(cast(quality = p AS double)) AS accuracy FROM j
""", "M17")
def q_accuracy(spark, sf):
    from pulseframe.operators.models import accuracy
    return accuracy(_label_join(spark, sf), "quality", "p")


@register("binary_metrics", "WITH " + _LABEL_JOIN_SQL + f""",
c AS (SELECT count(*) FILTER (WHERE quality = 1 AND p = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE quality = 1 AND p = 0) AS fn FROM j),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT tp, fp, fn, round(precision, {D}) AS precision, round(recall, {D}) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, {D}) AS f1
FROM m
""", "M18")
def q_binary_metrics(spark, sf):
    from pulseframe.operators.models import binary_metrics
    return binary_metrics(_label_join(spark, sf), "quality", "p", D)


@register("weighted_metrics", "WITH " + _LABEL_JOIN_SQL + f""",
sup AS (SELECT y AS c, count(*) AS support FROM j GROUP BY y),
tp AS (SELECT y AS c, count(*) AS tp FROM j WHERE y = pm GROUP BY y),
pr AS (SELECT pm AS c, count(*) AS predicted FROM j GROUP BY pm),
per AS (SELECT s.c, s.support, coalesce(tp.tp, 0) AS tp, coalesce(pr.predicted, 0) AS predicted
        FROM sup s LEFT JOIN tp ON s.c = tp.c LEFT JOIN pr ON s.c = pr.c),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec, tp / support AS rec FROM per),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m)
SELECT round(sum(prec * support) / sum(support), {D}) AS precision,
       round(sum(rec * support) / sum(support), {D}) AS recall,
       round(sum(f1 * support) / sum(support), {D}) AS f1
FROM f
""", "M18")
def q_weighted_metrics(spark, sf):
    from pulseframe.operators.models import weighted_metrics
    return weighted_metrics(_label_join(spark, sf), "y", "pm", D)


@register("label_score_disagreement", _LABELLED + """,
sc AS (SELECT *, cast(coalesce(cpu >= (SELECT avg(cpu) + 3 * stddev_samp(cpu) FROM activity), false) AS int) AS anomaly_scores
       FROM lab)
SELECT count(*) FILTER (WHERE anomaly_scores = 0 AND type_anomalie <> 'Normal') AS disagreements,
       round(avg(cast(anomaly_scores = 0 AND type_anomalie <> 'Normal' AS double)), 6) AS share
FROM sc
""", "P11")
def q_label_score_disagreement(spark, sf):
    from pulseframe.operators.thresholds import sigma_flags
    lab = sigma_flags(_labelled(spark, sf), "cpu", 3.0, "anomaly_scores")
    miss = (F.col("anomaly_scores") == 0) & (F.col("type_anomalie") != "Normal")
    return lab.agg(F.count_if(miss).alias("disagreements"),
                   F.round(F.avg(miss.cast("double")), 6).alias("share"))


# ---- model queries without an SQL form (rows-only checks; unit tests check
# them by planted outliers and against brute force) ----

_MODEL_COLS = ["cpu", "memory", "read_io", "write_io", "duration"]


@register("pca_error", None, "M5")
def q_pca_error(spark, sf):
    from pulseframe.operators.models import PcaError
    a = fx(spark, sf, "activity")
    return PcaError(_MODEL_COLS, k=2).fit(a).transform(a).select("event_id", "autoencoder")


@register("isolation_forest", None, "M6")
def q_isolation_forest(spark, sf):
    from pulseframe.operators.models import IsolationForest
    a = fx(spark, sf, "activity").select("event_id", *_MODEL_COLS)
    return IsolationForest(_MODEL_COLS, "event_id").fit(a).transform(a).select("event_id", "isolation_forest")


@register("one_class_score", None, "M7")
def q_one_class_score(spark, sf):
    from pulseframe.operators.models import OneClassScore, Standardizer
    a = fx(spark, sf, "activity").select("event_id", *_MODEL_COLS)
    z = Standardizer(_MODEL_COLS).fit(a).transform(a)
    return OneClassScore(_MODEL_COLS).fit(z).transform(z).select("event_id", "one_class_svm")


@register("score_clusters", None, "M8")
def q_score_clusters(spark, sf):
    from pulseframe.operators.models import kmeans_clusters
    a = fx(spark, sf, "activity").select("event_id", "cpu", "memory", "duration")
    out, _ = kmeans_clusters(a, ["cpu", "memory", "duration"], k=2, seed=42)
    return out.select("event_id", "cluster")


@register("knn_vote", None, "M11 M10")
def q_knn_vote(spark, sf):
    from pulseframe.operators.models import KnnVote, split_flag
    a = fx(spark, sf, "activity").select("event_id", "cpu", "memory", "duration",
                                         (F.col("io_wait") == "Y").cast("int").alias("label"))
    train = a.where(split_flag("event_id", 80))
    m = KnnVote(["cpu", "memory", "duration"], "label").fit(train, "event_id")
    return m.transform(a.where(~split_flag("event_id", 80))).select("event_id", "label", "p_knn")


@register("vote_models", None, "M12 M13 M19")
def q_vote_models(spark, sf):
    from pulseframe.operators.models import assemble, probability_cut, split_flag, train_vote_models
    a = fx(spark, sf, "activity").select("event_id", "cpu", "memory", "duration",
                                         (F.col("io_wait") == "Y").cast("double").alias("label"))
    lr, rf = train_vote_models(a.where(split_flag("event_id", 80)), ["cpu", "memory", "duration"],
                               rf_trees=(20, 40))
    x = assemble(a.where(~split_flag("event_id", 80)), ["cpu", "memory", "duration"])
    p = probability_cut(lr.transform(x), "prob_lr", 0.5, "flag_lr")
    return rf.transform(p).select("event_id", "label", "p_lr", "flag_lr", "p_rf")


@register("label_tree", None, "M16")
def q_label_tree(spark, sf):
    from pulseframe.operators.models import LabelTree
    lab = _labelled(spark, sf)
    cols = ["cpu", "memory", "read_io", "write_io", "duration", "has_join", "is_high_io_wait"]
    return LabelTree(cols).fit(lab).transform(lab).select("event_id", "type_anomalie", "predicted_label")


@register("detect_anomalies", None, "M20 M15 M14")
def q_detect_anomalies(spark, sf):
    from pulseframe.plans.detector import AnomalyDetector
    a = fx(spark, sf, "activity")
    det = AnomalyDetector().fit(a)
    return det.transform(a).select("event_id", "type_anomalie", "autoencoder", "isolation_forest",
                                   "one_class_svm", "anomaly_scores", "is_anomaly", "predicted_label")


# --------------------------------------------------------------------------
# Streaming (file source, availableNow, result read back as a table)
# --------------------------------------------------------------------------

@register("stream_minute_counts", with_fixtures("activity") + """,
m AS (SELECT date_trunc('minute', datetimeutc) AS minute, count(*) AS query_count FROM activity GROUP BY 1)
SELECT minute, minute + INTERVAL 1 MINUTE AS minute_end, query_count FROM m
WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(datetimeutc) FROM activity) - INTERVAL 10 MINUTE
""", "X4 X3 X1 S2")
def q_stream_minute_counts(spark, sf):
    from pulseframe.sources.fixtures import fixture_stream
    from pulseframe.streaming import minute_rollup, run_available
    s = minute_rollup(fixture_stream(spark, sf, "activity"), "datetimeutc")
    out = run_available(s, "append", "minute-counts")
    return out.select(F.col("minute").cast("timestamp_ntz").alias("minute"),
                      F.col("minute_end").cast("timestamp_ntz").alias("minute_end"), "query_count")


@register("stream_outlier_flags", REGISTRY["outlier_flags"].sql, "X2 F15")
def q_stream_outlier_flags(spark, sf):
    from pulseframe.functions.metrics import metric_ratios
    from pulseframe.operators.thresholds import OutlierThresholds
    from pulseframe.sources.fixtures import fixture_stream
    from pulseframe.streaming import run_available, score_stream
    t = OutlierThresholds().fit(metric_ratios(fx(spark, sf, "activity")))
    s = score_stream(metric_ratios(fixture_stream(spark, sf, "activity")), t.transform)
    return run_available(s.select("event_id", *_FLAG_NAMES), "append", "outlier-flags")


@register("stream_dedup", """
SELECT event_id, ts, user_id, event_type FROM events
""", "X9")
def q_stream_dedup(spark, sf):
    from pulseframe.streaming import dedup_events, run_available
    from pulseframe.sources.fixtures import stream_glob
    path = f"{sf.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    s1 = spark.readStream.schema(schema).parquet(stream_glob(path))
    s2 = spark.readStream.schema(schema).parquet(stream_glob(path))
    both = s1.union(s2).select("event_id", "ts", "user_id", "event_type")
    return run_available(dedup_events(both, ["event_id"], "ts"), "append", "dedup")


@register("stream_change_alerts", REGISTRY["change_alerts"].sql, "X7")
def q_stream_change_alerts(spark, sf):
    from pulseframe.operators.changes import change_alerts
    from pulseframe.sources.fixtures import fixture_stream
    from pulseframe.streaming import run_available
    return run_available(change_alerts(fixture_stream(spark, sf, "change_events")), "append", "alerts")


@register("stream_parse_lines", REGISTRY["parse_activity_line"].sql, "S2 S3 X2")
def q_stream_parse_lines(spark, sf):
    from pulseframe.functions.casting import cast_activity
    from pulseframe.sources.activity_lines import split_activity_lines
    from pulseframe.sources.fixtures import fixture_stream
    from pulseframe.streaming import run_available
    good, _ = split_activity_lines(fixture_stream(spark, sf, "activity_raw").select("event_id", "line"))
    out = run_available(cast_activity(good), "append", "lines")
    return out.withColumn("datetimeutc", F.col("datetimeutc").cast("timestamp_ntz"))


@register("stream_message_count", """
SELECT cast(count(*) AS bigint) AS processed FROM events
""", "A20")
def q_stream_message_count(spark, sf):
    from pulseframe.sources.fixtures import stream_glob
    from pulseframe.streaming import run_available
    path = f"{sf.rstrip('/')}/events.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1) \
        .parquet(stream_glob(path))
    counts = s.groupBy().agg(F.count("*").alias("processed"))
    out = run_available(counts, "update", "message-count")
    return out.agg(F.max_by("processed", "_batch").alias("processed"))


# --------------------------------------------------------------------------
# Model operators on the embedding vectors
# --------------------------------------------------------------------------

def _embedding_cols(spark, sf):
    """Embedding table with one column per vector dimension."""
    e = base_table(spark, sf, "embeddings")
    dim = e.select(F.max(F.size("embedding"))).collect()[0][0] or 0
    cols = [f"e{i}" for i in range(dim)]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c)
                                         for i, c in enumerate(cols)]), cols


@register("embedding_isolation", None, "M6")
def q_embedding_isolation(spark, sf):
    from pulseframe.operators.models import IsolationForest
    e, cols = _embedding_cols(spark, sf)
    return IsolationForest(cols, "vec_id").fit(e).transform(e).select("vec_id", "label", "isolation_forest")


@register("embedding_pca_error", None, "M5 M4")
def q_embedding_pca_error(spark, sf):
    from pulseframe.operators.models import PcaError
    e, cols = _embedding_cols(spark, sf)
    return PcaError(cols, k=8).fit(e).transform(e).select("vec_id", "label", "autoencoder")


@register("embedding_knn_accuracy", None, "M11 M10 M17")
def q_embedding_knn_accuracy(spark, sf):
    from pulseframe.operators.models import KnnVote, accuracy, split_flag
    e, cols = _embedding_cols(spark, sf)
    train = e.where(split_flag("vec_id", 80))
    m = KnnVote(cols, "label").fit(train, "vec_id")
    pred = m.transform(e.where(~split_flag("vec_id", 80)))
    return accuracy(pred, "label", "p_knn").withColumn("k", F.lit(m.k))


@register("embedding_clusters", None, "M8")
def q_embedding_clusters(spark, sf):
    from pulseframe.operators.models import kmeans_clusters
    e, cols = _embedding_cols(spark, sf)
    out, _ = kmeans_clusters(e, cols, k=10, seed=42)
    return out.groupBy("cluster", "label").agg(F.count("*").alias("n"))


@register("stream_detect_anomalies", None, "X2 X1 M20")
def q_stream_detect_anomalies(spark, sf):
    """Fit on the batch table, then score the event stream micro-batch by
    micro-batch into a folder table, read back."""
    import uuid

    from pulseframe.plans.detector import AnomalyDetector
    from pulseframe.session import scratch_path
    from pulseframe.sources.fixtures import fixture_stream
    from pulseframe.streaming import score_batches
    det = AnomalyDetector().fit(fx(spark, sf, "activity"))
    tag = "detect-" + uuid.uuid4().hex[:12]
    out, ckpt = scratch_path(spark, tag + "/out"), scratch_path(spark, tag + "/ckpt")
    cols = ["event_id", "type_anomalie", "anomaly_scores", "is_anomaly", "predicted_label"]
    q = score_batches(fixture_stream(spark, sf, "activity", max_files=1),
                      lambda b: det.transform(b).select(*cols), out, ckpt, {"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(out).select(*cols)


@register("scan_activity_csv", with_fixtures("activity") + """
SELECT datetimeutc, pid, database_name, appname, user_name, client, cpu, memory, read_io, write_io,
       duration, wait, io_wait, state, query FROM activity
""", "S1 F1 F2")
def q_scan_activity_csv(spark, sf):
    """Write the activity fixture as a `;`-separated file with a header
    (the sampler's format) under the shared folder, then read it back with
    the activity reader."""
    import uuid

    from pulseframe.session import scratch_path
    from pulseframe.sources.activity_lines import ACTIVITY_FIELDS, read_activity_csv
    path = scratch_path(spark, "activity-csv-" + uuid.uuid4().hex[:12])
    a = fx(spark, sf, "activity")
    a.select(*[F.col(c).cast("string") for c in ACTIVITY_FIELDS + ["query"]]) \
        .write.option("sep", ";").option("header", True).csv(path)
    return read_activity_csv(spark, path).withColumn("datetimeutc", F.col("datetimeutc").cast("timestamp_ntz"))


@register("attach_scores", with_fixtures("activity") + f""",
sc AS (SELECT event_id, cpu / (memory + 1e-6) AS cpu_memory_ratio,
              cast(coalesce(cpu >= (SELECT avg(cpu) + 3 * stddev_samp(cpu) FROM activity), false) AS int) AS is_anomaly
       FROM activity)
SELECT a.event_id, a.query, a.cpu, sc.cpu_memory_ratio, sc.is_anomaly
FROM activity a JOIN sc ON a.event_id = sc.event_id
""", "J1")
def q_attach_scores(spark, sf):
    """Scores computed on their own branch meet the rows again by an equi
    join on the stable row id (AQE picks the strategy from run-time
    sizes)."""
    from pulseframe.operators.thresholds import sigma_flags
    a = fx(spark, sf, "activity")
    sc = sigma_flags(a.select("event_id", "cpu", (F.col("cpu") / (F.col("memory") + F.lit(1e-6)))
                              .alias("cpu_memory_ratio")), "cpu").drop("cpu")
    return a.select("event_id", "query", "cpu").join(sc, "event_id")


_KNN_SPLIT = "2024-01-20 00:00:00"
_KNN_COLS = ["cast(round(cpu * 100) AS double) AS x1", "cast(round(memory * 10) AS double) AS x2",
             "cast(round(duration * 100) AS double) AS x3"]
_KNN_FEATURES = ", ".join(_KNN_COLS)


@register("knn_vote_k5", with_fixtures("activity") + f""",
p AS (SELECT event_id, datetimeutc, {_KNN_FEATURES}, CASE WHEN io_wait = 'Y' THEN 1 ELSE 0 END AS label FROM activity),
tr AS (SELECT * FROM p WHERE datetimeutc < TIMESTAMP '{_KNN_SPLIT}' ORDER BY event_id LIMIT 10000),
te AS (SELECT * FROM p WHERE datetimeutc >= TIMESTAMP '{_KNN_SPLIT}'),
d AS (SELECT te.event_id, tr.label,
             row_number() OVER (PARTITION BY te.event_id
               ORDER BY (te.x1 - tr.x1) * (te.x1 - tr.x1) + (te.x2 - tr.x2) * (te.x2 - tr.x2)
                        + (te.x3 - tr.x3) * (te.x3 - tr.x3), tr.event_id) AS rn
      FROM te, tr),
v AS (SELECT event_id, label, count(*) AS votes FROM d WHERE rn <= 5 GROUP BY event_id, label),
w AS (SELECT event_id, label, row_number() OVER (PARTITION BY event_id ORDER BY votes DESC, label) AS r FROM v)
SELECT event_id, label AS p_knn FROM w WHERE r = 1
""", "M11")
def q_knn_vote_k5(spark, sf):
    """Exact 5-NN vote of test rows (time split) against the training slice
    (first 10,000 training rows by id); checked against brute force SQL."""
    from pulseframe.operators.models import KnnVote
    a = fx(spark, sf, "activity").selectExpr("event_id", "datetimeutc", *_KNN_COLS,
                                            "CASE WHEN io_wait = 'Y' THEN 1 ELSE 0 END AS label")
    cut = F.lit(_KNN_SPLIT).cast("timestamp_ntz")
    train = a.where(F.col("datetimeutc") < cut).orderBy("event_id").limit(10_000)
    m = KnnVote(["x1", "x2", "x3"], "label", ks=[5]).fit(train, "event_id")
    return m.transform(a.where(F.col("datetimeutc") >= cut)).select("event_id", "p_knn")


@register("knn_index_recall", with_fixtures("activity") + """
SELECT count(*) AS queries, true AS recall_reached FROM activity WHERE event_id % 20 = 0
""", "M11")
def q_knn_index_recall(spark, sf):
    """The 5 nearest rows by the neighbour index, for every row whose id is
    divisible by 20 against all rows, and whether at least 0.9 of those that the exact
    search finds are among them."""
    from pulseframe.operators.neighbours import NeighbourIndex, exact_nearest, recall
    x = F.array(*[F.expr(c.rsplit(" AS ", 1)[0]) for c in _KNN_COLS])
    rows = fx(spark, sf, "activity").select(F.col("event_id").alias("id"), x.alias("x"), F.lit(0).alias("y"))
    asked = rows.where("id % 20 = 0").select("id", "x")
    found = NeighbourIndex(3, 5).fit(rows).nearest(asked)
    out = recall(found, exact_nearest(asked, rows, 5))
    return out.select("queries", (F.col("recall") >= 0.9).alias("recall_reached"))


@register("embedding_knn_indexed", None, "M11")
def q_embedding_knn_indexed(spark, sf):
    """Vote of the 5 nearest embeddings by the neighbour index, for the test
    share against the training share."""
    from pulseframe.operators.models import KnnVote, split_flag
    e, cols = _embedding_cols(spark, sf)
    m = KnnVote(cols, "label", ks=[5], exact=False).fit(e.where(split_flag("vec_id", 80)), "vec_id")
    return m.transform(e.where(~split_flag("vec_id", 80))).select("vec_id", "label", "p_knn")


# Sample times of an hour, so that many rows share one; late rows of the last
# day of a ten-day part are delivered with the next part.
_HOURLY = "date_trunc('hour', datetimeutc)"


def _late_files(spark, sf, name):
    """The activity rows as three files of a folder, in order of delivery."""
    import uuid

    from pulseframe.session import scratch_path
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    a = fx(spark, sf, "activity").withColumn("datetimeutc", F.expr(f"cast({_HOURLY} AS timestamp_ntz)"))
    late = F.when(F.col("event_id") % 2 == 0, F.expr("datetimeutc + INTERVAL 1 DAY")).otherwise(F.col("datetimeutc"))
    part = F.least(F.floor((F.dayofmonth(late) - 1) / 10), F.lit(2)) + F.when(F.month(late) > 1, 10).otherwise(0)
    a = a.withColumn("_part", F.least(part, F.lit(2)))
    for k in range(3):
        a.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(a.drop("_part").schema).option("maxFilesPerTrigger", 1).parquet(path)


@register("stream_wait_counts", with_fixtures("activity") + f""",
h AS (SELECT event_id, io_wait, {_HOURLY} AS t FROM activity),
c AS (SELECT event_id, t, count(*) FILTER (WHERE io_wait = 'Y') OVER (PARTITION BY t) AS avg_io_wait_time FROM h)
SELECT event_id, avg_io_wait_time FROM c WHERE t <= (SELECT max(t) FROM h) - INTERVAL 2 DAY
""", "W1 J2")
def q_stream_wait_counts(spark, sf):
    """Waits per sample time counted in state over several files, a sample
    time's rows in two of them; times that the watermark hasn't passed are left."""
    from pulseframe.streaming import run_available, stream_io_wait_count
    s = stream_io_wait_count(_late_files(spark, sf, "late-activity"), watermark="2 days")
    return run_available(s.select("event_id", "avg_io_wait_time"), "append", "wait-counts")


@register("stream_duration_profile", with_fixtures("activity") + f""",
s AS (SELECT query, avg(duration) AS m, max(duration) AS x FROM activity WHERE datetimeutc < TIMESTAMP '{_KNN_SPLIT}' GROUP BY query)
SELECT a.event_id, round(coalesce(s.m, a.duration), {D}) AS avg_query_duration, coalesce(s.x, a.duration) AS max_query_duration
FROM activity a LEFT JOIN s ON a.query = s.query
""", "W2 W3 J2")
def q_stream_duration_profile(spark, sf):
    """Statistics of the texts, fitted before a time, saved and joined to the
    stream of all rows: the same in any split; an unseen text takes its own."""
    import uuid

    from pulseframe.plans.features import duration_profile
    from pulseframe.session import scratch_path
    from pulseframe.streaming import run_available
    path = scratch_path(spark, "profile-" + uuid.uuid4().hex[:12])
    duration_profile().fit(fx(spark, sf, "activity").where(F.col("datetimeutc") < F.lit(_KNN_SPLIT).cast("timestamp_ntz"))).save(path, 0)
    s = duration_profile().load(spark, path).transform(_late_files(spark, sf, "profiled-activity"))
    out = run_available(s.select("event_id", "avg_query_duration", "max_query_duration"), "append", "profile")
    return out.withColumn("avg_query_duration", F.round("avg_query_duration", D))


@register("maintained_profile", with_fixtures("activity") + f"""
SELECT query, round(avg(duration), {D}) AS avg_query_duration, max(duration) AS max_query_duration FROM activity GROUP BY query
""", "W2 W3 J2 X5")
def q_maintained_profile(spark, sf):
    """Statistics of the texts kept up micro-batch by micro-batch: the newest
    version equals the statistics of all rows."""
    import uuid

    from pulseframe.plans.features import duration_profile
    from pulseframe.session import scratch_path
    path = scratch_path(spark, "kept-profile-" + uuid.uuid4().hex[:12])
    stream = _late_files(spark, sf, "kept-activity")
    p = duration_profile().fit(fx(spark, sf, "activity").limit(0))
    p.maintain(stream, path + "/versions", path + "/checkpoint", {"availableNow": True}).awaitTermination()
    kept = duration_profile().load(spark, path + "/versions").state
    return kept.select(F.col("key").alias("query"), F.round(F.col("total") / F.col("n"), D).alias("avg_query_duration"), F.col("top").alias("max_query_duration"))


@register("backfill_ranges", with_fixtures("stat_activity") + """
SELECT event_id, client_addr,
       first_value(usename IGNORE NULLS) OVER (PARTITION BY client_addr ORDER BY event_id
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS usename
FROM stat_activity
""", "W4")
def q_backfill_ranges(spark, sf):
    """Back fill as a segmented scan; rows without client are a partition."""
    from pulseframe.operators.windows import backfill_ranges
    d = fx(spark, sf, "stat_activity").select("event_id", "client_addr", "usename")
    return backfill_ranges(d, ["usename"], ["client_addr"], ["event_id"])


@register("snapshot_chunks", with_fixtures("stat_io") + """
SELECT l_linenumber % 3 AS k, count(*) AS row_count, cast(ceil(count(*) / 100.0) AS bigint) AS chunks, true AS complete,
       sum(reads) AS reads
FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS n FROM stat_io) GROUP BY n, l_linenumber % 3
""", "S8 F20 F22")
def q_snapshot_chunks(spark, sf):
    """Snapshots (one of them without key) written as numbered chunks, every
    message delivered twice, read back: complete ones with their sums."""
    from pulseframe.sources.messages import complete_rows, decode_snapshots, encode_snapshots, snapshot_status
    io = fx(spark, sf, "stat_io").withColumn("n", F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")))
    messages = encode_snapshots(io, "pg_stat_context_io", ["n"], ["l_orderkey", "l_linenumber", "reads"], 100)
    decoded = decode_snapshots(messages.unionAll(messages), "l_orderkey LONG, l_linenumber LONG, reads DOUBLE")
    rows = complete_rows(decoded).groupBy("snapshot", (F.col("l_linenumber") % 3).alias("k")).agg(F.count("*").alias("row_count"), F.sum("reads").alias("reads"))
    return rows.join(snapshot_status(decoded).select("snapshot", "chunks", "complete"), "snapshot").select("k", "row_count", "chunks", "complete", "reads")


_ODD_QUERY = """CASE event_id % 4 WHEN 0 THEN concat(query, '; COMMIT') WHEN 1 THEN concat('say "', query, '"; "')
       WHEN 2 THEN concat(query, chr(10), ' LIMIT 1;', chr(10)) ELSE query END"""


@register("scan_activity_records", with_fixtures("activity") + f"""
SELECT datetimeutc, pid, database_name, appname, cpu, memory, duration, state, {_ODD_QUERY} AS query FROM activity
""", "S1 F1 F2")
def q_scan_activity_records(spark, sf):
    """Texts with separators, doubled quotes and line breaks, written as a
    sampler file and read back record by record."""
    import uuid

    from pulseframe.session import scratch_path
    from pulseframe.sources.activity_lines import ACTIVITY_FIELDS, read_activity_records
    path = scratch_path(spark, "activity-records-" + uuid.uuid4().hex[:12])
    a = fx(spark, sf, "activity").withColumn("query", F.expr(_ODD_QUERY))
    quoted = F.concat(F.lit('"'), F.replace("query", F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.when(F.col("event_id") % 4 == 0, F.col("query")).otherwise(quoted)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ACTIVITY_FIELDS]
    a.select(F.concat_ws(";", *fields, text)).write.text(path)
    good, _ = read_activity_records(spark, path, header=False)
    return good.select(F.col("datetimeutc").cast("timestamp_ntz").alias("datetimeutc"), "pid", "database_name", "appname", "cpu", "memory", "duration",
                       "state", "query")


_VOTE = "CASE WHEN cpu > 80 AND memory > 80 AND duration > 4 THEN 1 ELSE 0 END"


@register("probability_at_limit", with_fixtures("activity") + f""",
s AS (SELECT event_id, {_VOTE} AS vote, memory / 100 AS p FROM activity)
SELECT event_id, CASE WHEN p >= (SELECT avg(vote) + 3 * stddev_samp(vote) FROM s) THEN 1 ELSE 0 END AS flag FROM s
""", "M19 M14")
def q_probability_at_limit(spark, sf):
    """A probability cut at the fitted limit (mean + 3 sd) of the votes."""
    from pyspark.ml.functions import array_to_vector

    from pulseframe.operators.models import probability_cut
    from pulseframe.operators.thresholds import SigmaLimit
    p = F.col("memory") / 100
    s = fx(spark, sf, "activity").select("event_id", F.expr(_VOTE).alias("vote"), array_to_vector(F.array(1 - p, p)).alias("probability"))
    limit = SigmaLimit("vote").fit(s).limit
    return probability_cut(s, threshold=limit).select("event_id", "flag")


@register("rule_trees", None, "M16")
def q_rule_trees(spark, sf):
    """A binary tree per rule, joined to the label text."""
    from pulseframe.functions.labels import LABEL_RULES
    from pulseframe.operators.rule_trees import RuleTrees
    lab = _labelled(spark, sf)
    cols = ["cpu", "memory", "read_io", "write_io", "duration", "has_join", "is_high_io_wait"]
    return RuleTrees(cols, LABEL_RULES).fit(lab).transform(lab).select("event_id", "type_anomalie", "predicted_label")


@register("one_class_svm", None, "M7")
def q_one_class_svm(spark, sf):
    from pulseframe.operators.models import spread
    from pulseframe.operators.one_class import OneClassSvm
    a = spread(fx(spark, sf, "activity").select("event_id", *_MODEL_COLS)).persist()
    return OneClassSvm(_MODEL_COLS, scale=True).fit(a).transform(a).select("event_id", "one_class_svm")


@register("sparse_svd_error", None, "M5 M2")
def q_sparse_svd_error(spark, sf):
    """Reconstruction error of the texts' TF-IDF rows off 8 directions."""
    from pulseframe.functions.text import normalize_query
    from pulseframe.operators.svd import TruncatedSvd
    from pulseframe.operators.vocabulary import StoredTfidf
    a = fx(spark, sf, "activity").select("event_id", "query")
    t = StoredTfidf("query", preprocess=normalize_query).fit(a)
    x = t.transform(a).persist()
    return TruncatedSvd(t.size, min(8, t.size - 1)).fit(x).error(x, "autoencoder").select("event_id", "autoencoder")
