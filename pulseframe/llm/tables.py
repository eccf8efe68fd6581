"""Tables on shared storage, orders and components used by the operators.

Intermediate tables are written below ``spark.checkpoint.dir`` and read back:
a lost executor then costs only the tasks that ran on it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.session import scratch_path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, name: str, *keys: str, n: int | None = None) -> DataFrame:
    """Stash ``df`` dealt by range of ``keys`` with its range number ``part``.

    Written once, so every reader sees the same ranges."""
    n = n or partitions(df.sparkSession)
    return stash(df.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()), name)


def running_offsets(parts: DataFrame, total: str, by: str = "part") -> DataFrame:
    """``parts`` has one row per range (a few thousand at most): add ``offset``,
    the sum of ``total`` over the ranges before."""
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(total).over(w), F.lit(0)))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of ``df`` when it has at most ``rows`` rows (counted);
    beyond that it stays a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, component),
    component being the smallest node reachable. Nodes without an edge to
    another node don't appear.

    Alternating large-star and small-star steps: each step links every
    neighbour to the smallest one seen, by a grouped minimum and a join, so a
    hub's neighbours are never gathered. Every step's edges are written."""
    e = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    e = stash(e, name)
    seen = None
    while True:
        both = e.union(e.select(F.col("u"), F.col("v"))).toDF("v", "u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("x"), F.col("v").alias("y"))
        big = stash(large.where("x <> y").select(F.least("x", "y").alias("v"), F.greatest("x", "y").alias("u"))
                    .distinct(), name)
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (big.join(low, "u").select(F.col("m").alias("x"), F.explode(F.array("u", "v")).alias("y"))
                      .where("x <> y").select(F.least("x", "y").alias("v"), F.greatest("x", "y").alias("u")).distinct())
        nxt = stash(small_star, name)
        # A fixed point keeps the sums and the count of the edges.
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e, big)
        e = nxt
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now


def free_prefix(df: DataFrame) -> str:
    """Underscores with which no column of ``df`` begins, for names of our own."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def local_name(path: str) -> str:
    return os.path.basename(path.rstrip("/"))
