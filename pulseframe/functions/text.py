"""Query-text features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword patterns of the query-shape flags, matched in any
# case, in this order.
QUERY_FLAG_PATTERNS = {
    "has_join": "JOIN",
    "has_subselect": "SELECT.*SELECT",
    "has_union": "UNION",
    "has_sleep": "SLEEP",
    "has_truncate": "TRUNCATE",
    "has_drop": "DROP",
    "has_delete": "DELETE",
    "has_alter": "ALTER",
    "has_insert": "INSERT",
    "has_update": "UPDATE",
}


def normalize_query(c: Column | str) -> Column:
    """Normalise SQL text for bag-of-words features.

    Steps, in order: keep ASCII letters, digits and white space; lower case;
    squeeze white space; trim; digit runs -> ``NUM``; delete words of one or
    two characters; squeeze; trim. ``(?U)`` makes ``\\s`` match Unicode
    spaces, as Python's ``re`` does for str patterns. Not idempotent: a
    second pass lowers ``NUM`` to ``num``.
    """
    x = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(x, r"(?U)[^a-zA-Z0-9\s]", "")
    x = F.lower(x)
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    x = F.trim(x)
    x = F.regexp_replace(x, r"\d+", "NUM")
    x = F.regexp_replace(x, r"\b\w{1,2}\b", "")
    x = F.regexp_replace(x, r"\s+", " ")
    return F.trim(x)


def query_shape(df: DataFrame, q: str = "query") -> DataFrame:
    """Length, keyword flags (0/1, any case), upper-case JOIN count and the
    complexity score 2*join + 3*subselect + 2*union."""
    qc = F.col(q)
    cols = {"query_length": F.length(qc)}
    for name, pat in QUERY_FLAG_PATTERNS.items():
        cols[name] = qc.rlike("(?i)" + pat).cast("int")
    cols["num_joins"] = F.regexp_count(qc, F.lit("JOIN")).cast("int")
    df = df.withColumns(cols)
    return df.withColumn(
        "query_complexity_score",
        F.col("has_join") * 2 + F.col("has_subselect") * 3 + F.col("has_union") * 2)
