"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing
and token encoding, each stage on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import encode, kneser_ney, linededup, prefixjoin, queries
from pulseframe.llm.tables import small, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier rejects go."""
    return kneser_ney.keep_good(docs, queries.trusted_ids(spark, sf_dir)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; documents that
    lose all their lines go, others keep their length in ``n_chars``."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each component stays, that with the least id (null ids
    last), once; texts without words stay as they are."""
    docs = docs.select(*COLUMNS)
    found = stash(prefixjoin.near_duplicates(docs).where("component is not null").select("id", "t", "rows", "component"), "texts")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    crowd = found.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first")
    copies = stash(found.join(crowd, "component").where(place != F.col("first")).select(F.col("id").alias("_id"), F.col("t").alias("_t")), "copies")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text == F.col("_t"))
    kept = docs.join(small(copies, prefixjoin.BROADCAST_IDS), same, "left_anti")
    repeated = found.where("rows > 1").select(F.col("id").alias("_id"), F.col("t").alias("_t"))
    if repeated.isEmpty():
        return kept
    repeated = small(stash(repeated, "repeated"), prefixjoin.BROADCAST_IDS)
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(once)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their leaf's epochs take them."""
    return queries.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    out = encode.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(queries.TOKENIZER))
    return out.select("doc_id", "lang", "source", "ids", "n_tokens")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near duplicates", near_duplicate_stage),
          ("mixing", mixing_stage), ("encoding", encoding_stage)]

# Language model, shingle components and tokenizer have no SQL form; the
# stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
