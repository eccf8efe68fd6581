"""Change detection between snapshots and change-event alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, keys, compare=None) -> DataFrame:
    """Row changes between two snapshots of a table keyed by ``keys``.

    One full outer join on the key (a shuffle of both sides on the key):
    operation INSERT (only new), DELETE (only old) or UPDATE (some compared
    column differs, null-safe); unchanged rows are left out. ``old_data`` and
    ``new_data`` are JSON objects of the compared columns.
    """
    keys = list(keys)
    compare = list(compare or [c for c in old.columns if c not in keys])
    o = old.select(*keys, F.struct(*compare).alias("_o"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, F.struct(*compare).alias("_n"), F.lit(True).alias("_in_new"))
    j = o.join(n, keys, "full_outer")
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col("_o." + c).eqNullSafe(F.col("_n." + c))
    op = (F.when(F.col("_in_old").isNull(), F.lit("INSERT"))
          .when(F.col("_in_new").isNull(), F.lit("DELETE"))
          .when(changed, F.lit("UPDATE")))
    return (j.withColumn("operation", op).where(F.col("operation").isNotNull())
            .select(*keys, "operation",
                    F.to_json("_o", {"ignoreNullFields": "false"}).alias("old_data"),
                    F.to_json("_n", {"ignoreNullFields": "false"}).alias("new_data")))


CHANGE_EVENT_SCHEMA = ("table STRING, operation STRING, "
                       "old_data MAP<STRING, STRING>, new_data MAP<STRING, STRING>")


def decode_change_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON change notifications -> (table, operation, old_data, new_data);
    the two data objects are kept as JSON text."""
    return df.select("*", F.get_json_object(payload, "$.table").alias("table"),
                     F.get_json_object(payload, "$.operation").alias("operation"),
                     F.get_json_object(payload, "$.old_data").alias("old_data"),
                     F.get_json_object(payload, "$.new_data").alias("new_data"))


def change_alerts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One alert per change event: subject ``Changes in <table> table`` and a
    three-line body (operation, old data, new data; JSON re-serialised
    compactly, ``null`` for a missing side)."""
    j = lambda path: F.get_json_object(payload, path)
    return df.select(
        *[c for c in df.columns if c != payload],
        F.concat(F.lit("Changes in "), j("$.table"), F.lit(" table")).alias("subject"),
        F.concat(F.lit("Operation: "), j("$.operation"),
                 F.lit("\nOld Data: "), F.coalesce(j("$.old_data"), F.lit("null")),
                 F.lit("\nNew Data: "), F.coalesce(j("$.new_data"), F.lit("null"))).alias("body"))
