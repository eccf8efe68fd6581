"""Set operations: union by name, values unseen at fit, vocabulary gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_by_name(*dfs: DataFrame) -> DataFrame:
    """Union all by column name; a column missing on one side is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def unseen_values(new: DataFrame, known: DataFrame, col: str, known_col: str | None = None) -> DataFrame:
    """Distinct values of ``new.col`` absent from ``known`` (left anti join)."""
    k = known.select(F.col(known_col or col).alias(col)).distinct()
    return new.select(col).where(F.col(col).isNotNull()).distinct().join(k, col, "left_anti")


def extend_values(known: DataFrame, new: DataFrame, col: str) -> DataFrame:
    """Known values plus new ones, each once."""
    return known.select(col).union(new.select(col)).where(F.col(col).isNotNull()).distinct()


def unseen_terms(tokens: DataFrame, vocab: DataFrame, term: str = "term") -> DataFrame:
    """Terms of ``tokens`` (one per row) not in the vocabulary."""
    return tokens.select(term).distinct().join(vocab.select(term), term, "left_anti")
