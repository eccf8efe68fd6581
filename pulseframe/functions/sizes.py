"""Size text <-> numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit suffixes read by the size parser, and the factor that
# turns each into megabytes (checked in this order).
SIZE_UNITS_MB = [("MB", 1.0), ("KB", 1.0 / 1024), ("GB", 1024.0), ("BYTES", 1.0 / (1024 * 1024))]
EXTRA_UNITS_MB = [("TB", 1024.0 * 1024), ("PB", 1024.0 ** 3)]

# Display units of the byte formatter, after "bytes".
BYTE_UNITS = ["kB", "MB", "GB", "TB", "PB"]


def parse_size_mb(c: Column | str, extended_units: bool = False) -> Column:
    """Megabytes from size text such as ``16 kB`` or ``8192 bytes``.

    null or '' -> 0; a unit suffix scales the number; a bare number is taken
    as megabytes; anything else (also ``5 TB`` unless ``extended_units``)
    -> 0.
    """
    x = F.col(c) if isinstance(c, str) else c
    s = F.upper(F.trim(x))
    units = SIZE_UNITS_MB + (EXTRA_UNITS_MB if extended_units else [])
    expr = None
    for unit, factor in units:
        num = F.replace(s, F.lit(unit), F.lit("")).try_cast("double")
        branch = F.coalesce(num * F.lit(factor), F.lit(0.0))
        cond = s.endswith(unit)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    expr = expr.otherwise(F.coalesce(s.try_cast("double"), F.lit(0.0)))
    return F.when(x.isNull() | (x == ""), F.lit(0.0)).otherwise(expr)


def format_bytes(c: Column | str) -> Column:
    """Human-readable size of a byte count, PostgreSQL ``pg_size_pretty``
    style: below 10240 -> ``N bytes``; else the largest unit that keeps the
    value below 20480 half-units, rounded half up."""
    b = (F.col(c) if isinstance(c, str) else c).cast("double")
    expr = F.when(F.abs(b) < 10240, F.concat(b.cast("bigint").cast("string"), F.lit(" bytes")))
    for i, unit in enumerate(BYTE_UNITS):
        half = F.floor(b / F.lit(float(2 ** (10 * (i + 1) - 1))))
        rounded = F.floor((half + 1) / 2).cast("bigint").cast("string")
        text = F.concat(rounded, F.lit(" " + unit))
        if i < len(BYTE_UNITS) - 1:
            expr = expr.when(F.abs(half) < 20479, text)
        else:
            expr = expr.otherwise(text)
    return expr
