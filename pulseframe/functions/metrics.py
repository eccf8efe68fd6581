"""Per-row metric, flag and time features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def metric_ratios(df: DataFrame, cpu="cpu", memory="memory", read="read_io",
                  write="write_io", duration="duration") -> DataFrame:
    """Four ratios with 1e-6 added to the divisor, and system load."""
    c, m, r, w, d = (F.col(x) for x in (cpu, memory, read, write, duration))
    return df.withColumns({
        "cpu_memory_ratio": c / (m + F.lit(EPS)),
        "read_write_ratio": r / (w + F.lit(EPS)),
        "cpu_duration_ratio": c / (d + F.lit(EPS)),
        "memory_duration_ratio": m / (d + F.lit(EPS)),
        "system_load": (c + m) / 2,
    })


def wait_flags(df: DataFrame, io_wait="io_wait", wait="wait") -> DataFrame:
    """Y/N flags as 0/1 and the two constant history columns."""
    yes = (F.col(io_wait) == "Y")
    return df.withColumns({
        "peak_io_wait_time": F.coalesce(yes, F.lit(False)).cast("int"),
        "is_high_io_wait": F.coalesce(yes, F.lit(False)).cast("int"),
        "is_wait": F.coalesce(F.col(wait) == "Y", F.lit(False)).cast("int"),
        "historical_cpu_utilization": F.lit(1),
        "historical_memory_utilization": F.lit(1),
    })


def time_features(df: DataFrame, ts: str = "datetimeutc") -> DataFrame:
    """Calendar parts; day of week with Monday = 0; weekend and 9-17 flags."""
    t = F.col(ts)
    return df.withColumns({
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t),
        "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t),
        "day_of_week": F.weekday(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
        "is_peak_hour": F.hour(t).between(9, 17).cast("int"),
    })
