"""Line deduplication by overlapping three-line windows.

Every run of ``lines`` consecutive lines is a window, known by a 128-bit hash.
Of windows that occur more than once anywhere, the first occurrence in
(document, line) order stays; the lines covered by the later ones, merged over
overlaps, are removed. A removed line always has an equal line at an earlier
place, so no distinct line is lost.

Hot windows: first places and counts are partial aggregates, and the join of
places to repeated windows is one that Spark can split. Covered lines of one
document are gathered, at most the document's own lines.

Defined cases: null and empty texts stay as they are; documents with fewer
lines have no window; rows equal in id and text are one document (kept as
often as they occur); a null id orders first; ``n_lines`` and ``n_removed`` of
the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.tables import free_prefix, text_or_empty

LINES = 3


def windows(df: DataFrame, id_col: str, text_col: str, lines: int = LINES) -> DataFrame:
    """(id, t, line, h1, h2): every window with its 0-based first line."""
    text = text_or_empty(text_col)
    split = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.split(text, "\n", -1).alias("l"))
    split = split.where(F.size("l") >= lines)
    window = F.expr(f"""transform(sequence(0, size(l) - {lines}), i -> named_struct('line', i,
        'h', md5(cast(concat_ws('\n', slice(l, i + 1, {lines})) as binary))))""")
    return split.select("id", "t", F.explode(window).alias("w")).select(
        "id", "t", F.col("w.line").alias("line"),
        *(F.conv(F.substring("w.h", 1 + 16 * k, 16), 16, -10).cast("long").alias(f"h{k + 1}") for k in (0, 1)))


def covered_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """(id, t, covered): the sorted lines to remove of each touched document."""
    w = windows(df, id_col, text_col, lines)
    first = (w.groupBy("h1", "h2").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("h1", "h2", "first"))
    later = (w.join(first, ["h1", "h2"])
             .where(~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.line") == F.col("line")))))
    return (later.groupBy("id", "t").agg(F.collect_set("line").alias("starts"))
            .select("id", "t", F.expr(f"array_distinct(flatten(transform(starts, s -> sequence(s, s + {lines - 1}))))").alias("covered")))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """``df`` with the covered lines taken out of the text column, and
    ``n_lines``, ``n_removed`` appended."""
    own = free_prefix(df)
    id_, t_, covered, l_ = (own + c for c in ("id", "t", "covered", "lines"))
    cover = covered_lines(df, id_col, text_col, lines).toDF(id_, t_, covered)
    text = text_or_empty(text_col)
    out = df.join(cover, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(t_)), "left")
    out = out.withColumn(l_, F.split(text, "\n", -1))
    # A set difference of places: linear in the lines, however many are covered.
    places = F.array_except(F.sequence(F.lit(0), F.size(l_) - 1), covered)
    left = F.array_join(F.transform(places, lambda i: F.get(F.col(l_), i)), "\n")
    clean = F.when(F.col(covered).isNull(), F.col(text_col)).otherwise(left)
    return out.select(*(F.col(c) if c != text_col else clean.alias(c) for c in df.columns if c.lower() not in ("n_lines", "n_removed")),
                      F.size(l_).cast("long").alias("n_lines"), F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_removed"))
