"""Sinks and external sources: CSV append, result tables, JDBC, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Append a result to a CSV folder, header in each written file."""
    df.write.mode("append").option("header", True).option("sep", sep).csv(path)


def publish(df: DataFrame, table: str, mode: str = "overwrite", partition_by=None) -> None:
    """Write a finished result as a table that readers query."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(table)


def read_sql(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Run SQL on an external database through JDBC (the driver jar must be
    on the classpath). ``partitionColumn``/``lowerBound``/``upperBound``/
    ``numPartitions`` options split the read over tasks."""
    r = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def read_topic(spark: SparkSession, servers: str, topic: str, stream: bool = True) -> DataFrame:
    """Kafka topic from the earliest offset (needs the Kafka connector jar)."""
    src = spark.readStream if stream else spark.read
    return (src.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest").load())


def run_named(builders: dict, spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A set of named source queries, built lazily together."""
    return {name: b(spark, sf_dir) for name, b in builders.items()}
