"""Documents with their edited text and their neighbours in id order, for the
fingerprint query. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm.tables import ranged, stash, text_or_empty


def successors(docs: DataFrame) -> DataFrame:
    """(id, n, next_id) from rows (id, n): the next larger id, after the
    largest the smallest. Ids are dealt by range; only the first id of every
    range (as many as there are partitions) meets in one task."""
    ids = ranged(docs.groupBy("id").agg(F.max("n").alias("n")), "ids", "id")
    heads = ids.groupBy("part").agg(F.min("id").alias("head"))
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy())))
    inside = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return stash(ids.withColumn("inner", inside).join(heads, "part").select("id", "n", F.coalesce("inner", "after").alias("next_id")), "successors")


def edited_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, next_id, t, text, edited): the last quarter (floor) of the code
    points replaced by the first as many of the next document. ``t`` is the
    text's hash. Rows without id are left out; the next document of rows that
    share an id is the one with the least beginning."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).where("id is not null")
    links = successors(docs.select("id", F.length("text").alias("n")))
    need = links.select(F.col("id").alias("for_id"), F.floor(F.col("n") / 4).cast("int").alias("need"), F.col("next_id").alias("id"))
    heads = (docs.join(need, "id").select(F.col("for_id").alias("id"), F.expr("substring(text, 1, need)").alias("head"), F.col("id").alias("next_id"))
             .groupBy("id").agg(F.min("head").alias("head"), F.min("next_id").alias("next_id")))
    edited = F.expr("concat(substring(text, 1, length(text) - floor(length(text) / 4)), substring(head, 1, cast(floor(length(text) / 4) as int)))")
    return docs.join(heads, "id").select("id", "next_id", F.xxhash64("text").alias("t"), "text", edited.alias("edited"))
