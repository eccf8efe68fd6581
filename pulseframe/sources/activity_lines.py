"""Sampler lines -> activity records.

A line is ``;``-separated; fields 0-13 are fixed and the query text is the
rest of the line (it may itself contain ``;``). Quotes round each field are
removed. Lines with fewer than 14 fields go to a reject output instead of
failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pulseframe.functions.casting import cast_activity

# Field order of a sampler line.
ACTIVITY_FIELDS = ["datetimeutc", "pid", "database_name", "appname", "user_name", "client",
                   "cpu", "memory", "read_io", "write_io", "duration", "wait", "io_wait", "state"]
MIN_FIELDS = 14

ACTIVITY_TEXT_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in ACTIVITY_FIELDS + ["query"]])


def _parts(line: str):
    # limit 15: the 15th element keeps the rest of the line, `;` included
    return F.split(F.col(line), ";", len(ACTIVITY_FIELDS) + 1)


def split_activity_lines(df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(good, rejected): good rows carry one text column per field."""
    keep = [c for c in df.columns if c != line]
    p = df.withColumn("_p", _parts(line))
    ok = F.size("_p") >= MIN_FIELDS
    fields = [F.btrim(F.element_at("_p", i + 1), F.lit('"')).alias(f)
              for i, f in enumerate(ACTIVITY_FIELDS)]
    query = F.btrim(F.coalesce(F.element_at("_p", len(ACTIVITY_FIELDS) + 1), F.lit("")),
                    F.lit('"')).alias("query")
    good = p.where(ok).select(*keep, *fields, query)
    rejected = p.where(~F.coalesce(ok, F.lit(False))).select(*keep, line)
    return good, rejected


def parse_activity(df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(typed records, rejected lines)."""
    good, rejected = split_activity_lines(df, line)
    return cast_activity(good), rejected


def read_activity_csv(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of a `;`-separated sampler file with a header (all text),
    then the lenient casts. The schema is given, never inferred."""
    df = (spark.read.schema(ACTIVITY_TEXT_SCHEMA).option("sep", ";").option("header", True)
          .option("mode", "PERMISSIVE").csv(path))
    return cast_activity(df)


def read_activity_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of sampler files (for ``parse_activity``)."""
    return spark.read.text(path).withColumnRenamed("value", "line")


# One field with the separator after it: quoted (quotes inside are doubled), or
# plain (no quote at its start).
_FIELD = r'\G(?:"[^"]*+(?:""[^"]*+)*+"|(?!")[^;]*+)(?:;|$)'
MAX_RECORD_LINES = 1000


def record_lines(spark: SparkSession, path: str, max_lines: int = MAX_RECORD_LINES) -> DataFrame:
    """Records of text files: (file, number, lines), a line break inside quotes
    being part of its record.

    Files are read in splits. Whether a line starts inside quotes is the parity of
    the quotes before it: counted inside each split, and carried over the splits
    of a file on a table of one row per split. A record of more than
    ``max_lines`` lines (a quote that is never closed) is given up: its lines
    become records of their own, so no group grows with the file."""
    lines = (spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
             .withColumn("at", F.monotonically_increasing_id())
             .withColumn("q", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))))
    splits = lines.groupBy("file", "block").agg(F.sum("q").alias("qs"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("qs").over(before), F.lit(0)).alias("qs"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    own = F.coalesce(F.sum("q").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (lines.withColumns({"own": own, "k": F.row_number().over(inside)}).join(splits, ["file", "block"])
              .select("file", "block", "value", (F.col("n") + F.col("k")).alias("line"), ((F.col("qs") + F.col("own")) % 2 == 0).alias("starts")))
    # The record of a line: the last line that starts one, in the split or before it.
    here = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("start", F.max(F.when(F.col("starts"), F.col("line"))).over(here))
    last = placed.groupBy("file", "block").agg(F.max("start").alias("last"))
    last = last.select("file", "block", F.max("last").over(before).alias("carried"))
    placed = placed.join(last, ["file", "block"]).withColumn("start", F.coalesce("start", "carried", "line"))
    placed = placed.withColumn("start", F.when(F.col("line") - F.col("start") < max_lines, F.col("start")).otherwise(F.col("line")))
    whole = placed.groupBy("file", F.col("start").alias("number")).agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("ls"))
    return whole.select("file", "number", F.col("ls.value").alias("lines"))


def _unquoted(field: Column) -> Column:
    quoted = field.startswith('"') & field.endswith('"') & (F.length(field) >= 2)
    return F.when(quoted, F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def split_activity_records(df: DataFrame, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of quote-aware records: a field in quotes may hold
    separators, line breaks and doubled quotes; the query is the rest of the
    record after 14 fields, surplus separators included. A record with fewer fields,
    with a broken quote in the first 14, or with a line break outside quotes is
    rejected."""
    keep = [c for c in df.columns if c != record]
    n = len(ACTIVITY_FIELDS)
    p = df.withColumn("_f", F.regexp_extract_all(F.col(record), F.lit(_FIELD), F.lit(0)))
    head = F.slice("_f", 1, n)
    used = F.aggregate(head, F.lit(0), lambda acc, x: acc + F.length(x))
    p = p.withColumns({"_rest": F.substring(F.col(record), used + 1, F.length(F.col(record))), "_n": F.size("_f"),
                       "_ends": F.size(F.filter(head, lambda x: x.endswith(";")))})
    # A line break is only a part of a field in quotes from its start to its end.
    length = F.aggregate("_f", F.lit(0), lambda acc, x: acc + F.length(x))
    torn = F.exists("_f", lambda x: ~x.startswith('"') & x.contains("\n")) | (length < F.length(F.col(record)))
    ok = (F.col("_n") >= n) & (F.col("_ends") >= n - 1) & ~(F.col(record).contains("\n") & torn)
    plain = lambda x: F.when(x.endswith(";"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x)
    fields = [_unquoted(plain(F.get("_f", F.lit(i)))).alias(f) for i, f in enumerate(ACTIVITY_FIELDS)]
    good = p.where(ok).select(*keep, *fields, _unquoted(F.col("_rest")).alias("query"))
    return good, p.where(~F.coalesce(ok, F.lit(False))).select(*keep, record)


def read_activity_records(spark: SparkSession, path: str, header: bool = True, max_lines: int = MAX_RECORD_LINES) -> tuple[DataFrame, DataFrame]:
    """(typed records, rejected) of sampler files with quoted text. A record of
    several lines that can't be read (a stray quote) is read again line by line; what
    can't be read then is rejected as it stands. Blank lines are left out."""
    r = record_lines(spark, path, max_lines)
    if header:
        r = r.where("number > 1")
    r = r.withColumn("record", F.array_join("lines", "\n")).where(F.trim("record") != "")
    good, broken = split_activity_records(r)
    alone = broken.select(F.explode(F.split("record", "\n")).alias("line")).where(F.trim("line") != "")
    more, rejected = split_activity_lines(alone)
    return cast_activity(good.select(*ACTIVITY_FIELDS, "query").unionByName(more)), rejected
