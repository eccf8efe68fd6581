"""Message envelopes: ``{type_query, data: [row, ...]}`` JSON values, and
flat JSON records with a key, as written to and read from a topic."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.session import scratch_path

# The statistics message types.
MESSAGE_TYPES = ["pg_stat_activity", "pg_stat_context_io", "pg_stat_io_activity", "pg_stat_user_tables"]

# Timestamps travel as ISO-8601 text with microseconds (the JSON default
# keeps milliseconds only).
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``_n`` (rows of the same keys) and ``_k`` (the row's number among
    them, from 0), null keys included. The rows are read once and written as they lie,
    sorted by key inside each partition; a row per (partition, key) gives the offsets,
    so a key that holds a large part of the rows is numbered in all its partitions."""
    spark = df.sparkSession
    path = scratch_path(spark, f"numbered-{uuid.uuid4().hex}")
    cols = [F.col(k) for k in keys] or [F.lit(0)]
    lying = (df.withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*cols)
             .withColumn("_at", F.monotonically_increasing_id()))
    lying.write.parquet(path)
    lying = spark.read.schema(lying.schema).parquet(path)
    pieces = lying.groupBy("_part", *keys).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                           F.sum("_rows").over(w).alias("_n"), (before - F.col("_first")).alias("_shift"))
    cond = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return lying.join(pieces, cond).withColumn("_k", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_p", "_shift", *[f"_key{i}" for i in range(len(keys))])


def _chunked(df: DataFrame, type_query, snapshot_keys, payload_cols, rows_per_message: int) -> DataFrame:
    """(keys, _tq, _chunk, _n, data): at most ``rows_per_message`` rows a chunk."""
    tq = F.lit(type_query) if isinstance(type_query, str) else type_query
    keys = list(snapshot_keys)
    d = _numbered(df.withColumn("_tq", tq), [*keys, "_tq"])
    d = d.withColumn("_chunk", F.floor(F.col("_k") / F.lit(rows_per_message)))
    return d.groupBy(*keys, "_tq", "_chunk", "_n").agg(F.sort_array(F.collect_list(F.struct(*payload_cols))).alias("data"))


def encode_envelopes(df: DataFrame, type_query, snapshot_keys, payload_cols,
                     max_rows_per_message: int = 10_000) -> DataFrame:
    """Messages of JSON envelopes ``{type_query, data: [row, ...]}``, one per
    snapshot, or several when a snapshot has more than ``max_rows_per_message``
    rows, so no message (and no task building one) grows with the snapshot.
    Decoding is unchanged: every envelope of a snapshot explodes back to its
    rows. ``type_query`` is a column or a literal text; rows with null keys
    form a snapshot too. (``encode_snapshots`` numbers the chunks.)"""
    keys = list(snapshot_keys)
    g = _chunked(df, type_query, keys, payload_cols, max_rows_per_message)
    value = F.to_json(F.struct(F.col("_tq").alias("type_query"), F.col("data")), JSON_OPTIONS)
    key = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(999)).cast("string")
    return g.select(key.alias("key"), value.alias("value"))


def encode_snapshots(df: DataFrame, type_query, snapshot_keys, payload_cols, rows_per_message: int = 10_000) -> DataFrame:
    """Envelopes that tell their place: ``{type_query, snapshot, chunk, chunks, rows,
    data}`` with the snapshot's id (a digest of type and keys), the chunk's number from
    0, the number of chunks and of rows of the whole snapshot. All chunks of a
    snapshot have one message key, so that a topic keeps them in one partition."""
    keys = list(snapshot_keys)
    g = _chunked(df, type_query, keys, payload_cols, rows_per_message)
    names = F.to_json(F.struct("_tq", *keys), {**JSON_OPTIONS, "ignoreNullFields": "false"})
    chunks = F.ceil(F.col("_n") / F.lit(rows_per_message))
    g = g.withColumn("snapshot", F.sha2(names, 256))
    value = F.to_json(F.struct(F.col("_tq").alias("type_query"), "snapshot", F.col("_chunk").alias("chunk"), chunks.alias("chunks"),
                               F.col("_n").alias("rows"), "data"), JSON_OPTIONS)
    return g.select(F.col("snapshot").alias("key"), value.alias("value"))


def decode_snapshots(df: DataFrame, data_schema: str, value: str = "value") -> DataFrame:
    """(type_query, snapshot, chunk, chunks, rows, data), each chunk once however
    often it was delivered."""
    schema = f"type_query STRING, snapshot STRING, chunk LONG, chunks LONG, rows LONG, data ARRAY<STRUCT<{data_schema}>>"
    m = df.select(F.from_json(F.col(value).cast("string"), schema, JSON_OPTIONS).alias("m")).select("m.*")
    return m.where(F.col("snapshot").isNotNull()).dropDuplicates(["snapshot", "chunk"])


def snapshot_status(decoded: DataFrame) -> DataFrame:
    """(type_query, snapshot, chunks, received, rows, rows_received, complete)."""
    g = decoded.groupBy("type_query", "snapshot").agg(
        F.max("chunks").alias("chunks"), F.count("*").alias("received"), F.max("rows").alias("rows"), F.sum(F.size("data")).alias("rows_received"))
    return g.withColumn("complete", (F.col("received") == F.col("chunks")) & (F.col("rows_received") == F.col("rows")))


def complete_rows(decoded: DataFrame) -> DataFrame:
    """Rows (type_query, snapshot, fields) of the snapshots that are complete."""
    done = snapshot_status(decoded).where("complete").select("snapshot")
    return decoded.join(done, "snapshot", "left_semi").select("type_query", "snapshot", F.inline("data"))


def encode_records(df: DataFrame, key_cols=None) -> DataFrame:
    """One flat JSON record per row; the key is a stable hash in 0..998."""
    cols = df.columns
    kc = list(key_cols or cols)
    key = F.pmod(F.xxhash64(*[F.col(k) for k in kc]), F.lit(999)).cast("string")
    return df.select(key.alias("key"), F.to_json(F.struct(*cols), JSON_OPTIONS).alias("value"))


def decode_envelopes(df: DataFrame, data_schema: str, value: str = "value") -> DataFrame:
    """JSON envelope -> (type_query, data ARRAY<STRUCT<data_schema>>)."""
    schema = f"type_query STRING, data ARRAY<STRUCT<{data_schema}>>"
    return df.select(F.from_json(F.col(value).cast("string"), schema, JSON_OPTIONS).alias("m")).select("m.*")


def explode_envelopes(decoded: DataFrame) -> DataFrame:
    """One row per data element, with its message type."""
    return decoded.select("type_query", F.inline("data"))


def route(decoded: DataFrame, type_query: str) -> DataFrame:
    """Messages of one type (one filter per output on the same parsed stream)."""
    return decoded.where(F.col("type_query") == type_query)


def decode_records(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    return df.select(F.from_json(F.col(value).cast("string"), schema, JSON_OPTIONS).alias("r")).select("r.*")
