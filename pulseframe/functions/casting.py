"""Lenient casts: bad text becomes null instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVITY_NUMERIC = ("cpu", "memory", "read_io", "write_io", "duration")


def to_number(c: Column | str) -> Column:
    """Number or null. ``try_cast`` reads the text ``nan`` as NaN; it is
    mapped to null so that aggregates skip it as pandas does."""
    x = F.col(c) if isinstance(c, str) else c
    v = x.try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def to_timestamp_or_null(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(x.cast("string"))


def drop_zone(c: Column | str) -> Column:
    """Zone-less wall-clock time: a TIMESTAMP read in the session zone
    (UTC here) becomes TIMESTAMP_NTZ with the same wall clock."""
    x = F.col(c) if isinstance(c, str) else c
    return x.cast("timestamp_ntz")


def iso_text(c: Column | str) -> Column:
    """ISO-8601 text as Python's ``datetime.isoformat``: microseconds are
    printed only when non-zero."""
    x = F.col(c) if isinstance(c, str) else c
    micros = F.date_format(x, "SSSSSS")
    return F.when(micros == "000000", F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def cast_activity(df: DataFrame, numeric=ACTIVITY_NUMERIC, ts: str = "datetimeutc",
                  integer=("pid",)) -> DataFrame:
    """Cast the text fields of an activity record: numbers and the sample
    time become typed columns, bad values null."""
    out = {}
    for c in numeric:
        if c in df.columns:
            out[c] = to_number(c)
    for c in integer:
        if c in df.columns:
            # Whole numbers keep all digits; out of range becomes null.
            out[c] = F.coalesce(F.col(c).cast("string").try_cast("bigint"), to_number(c).try_cast("bigint"))
    if ts in df.columns:
        out[ts] = to_timestamp_or_null(ts)
    return df.withColumns(out)
