"""Data checks from table constraints, as aggregate jobs.

``check`` runs many rules in one pass over the table: each rule is a
``count_if`` inside one aggregate, so the table is scanned once whatever the
number of rules. Key checks need a shuffle on the key; foreign keys are an
anti join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # not_null | range | domain | expr
    column: str
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    expr: str | None = None

    def violated(self) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "range":
            return c.isNotNull() & ~c.between(self.low, self.high)
        if self.kind == "domain":
            return c.isNotNull() & ~c.isin(*self.values)
        if self.kind == "expr":
            return ~F.coalesce(F.expr(self.expr), F.lit(True))
        raise ValueError(self.kind)


def not_null(col: str) -> Rule:
    return Rule(f"not_null:{col}", "not_null", col)


def in_range(col: str, low, high) -> Rule:
    return Rule(f"range:{col}", "range", col, low=low, high=high)


def in_domain(col: str, values) -> Rule:
    return Rule(f"domain:{col}", "domain", col, values=tuple(values))


def check(df: DataFrame, rules) -> DataFrame:
    """(rule, violations) for each rule, from a single aggregate."""
    rules = list(rules)
    agg = df.agg(*[F.count_if(r.violated()).alias(f"r{i}") for i, r in enumerate(rules)])
    pairs = [F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("violations"))
             for i, r in enumerate(rules)]
    return agg.select(F.inline(F.array(*pairs)))


def key_violations(df: DataFrame, keys) -> DataFrame:
    """Keys that are null or occur more than once (UNIQUE / PRIMARY KEY)."""
    keys = list(keys)
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where((F.col("count") > 1) | any_null)


def fk_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose non-null reference matches no parent key."""
    p = parent.select(F.col(pk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(p, fk, "left_anti")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def list_base_tables(spark: SparkSession, db: str | None = None) -> list[str]:
    """Names of the persistent tables of a database (views left out)."""
    return [t.name for t in spark.catalog.listTables(db) if t.tableType in ("MANAGED", "EXTERNAL")]


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")
