"""Document fingerprints: I-Match with randomised lexicon subsets.

Terms are lower-case words. The lexicon holds the terms whose inverse document
frequency ln(N / df) lies in a band; df counts all documents. A document's
distinct lexicon terms are sorted and hashed to 64 bits, once for the whole
lexicon and once for each of FAMILIES x LEVELS random subsets: subset (f, l)
keeps a term with probability 4^-(l + 1) by the bits of its hash seeded for family f,
so families are independent and a family's levels are nested. Coarse subsets
tell short documents apart, fine ones survive many changed terms of a long one. A subset
without a term of the document has no hash (null). Documents without any
lexicon term are known by their text.

The likeness of two fingerprints is the share of subsets with the same hash
among those that hold terms of either one.

At most mean-terms-per-document / LOW terms reach the document frequency
LOW * N, whatever N, so the lexicon is bounded; its size is counted before it
is broadcast, and beyond BROADCAST_TERMS the join is a shuffled one.

DataFrame functions only. Defined cases: null text counts as empty; a null
likeness doesn't arise: two texts without terms are alike (1) when equal, else
0; rows equal in key and text have one fingerprint row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.tables import stash, text_or_empty

LOW, HIGH = 0.001, 0.2          # document frequency band as shares of N
MIN_IDF, MAX_IDF = math.log(1 / HIGH), math.log(1 / LOW)
FAMILIES, LEVELS = 13, 5
SEED = 1
BROADCAST_TERMS = 1_000_000


def terms(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"\s+")), "")


def document_frequencies(df: DataFrame, text_col: str) -> DataFrame:
    """(term hash, df) over all rows."""
    t = df.select(F.explode(terms(text_or_empty(text_col))).alias("t")).select(F.xxhash64("t").alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


def lexicon(df: DataFrame, text_col: str, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """The term hashes in the band, written once."""
    n = df.count()
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    band = document_frequencies(df, text_col).where((idf >= min_idf) & (idf <= max_idf)).select("term")
    return stash(band, "lexicon")


def fingerprints(texts: DataFrame, lex: DataFrame, keys: list[str], text: str, extra: dict[str, Column] | None = None,
                 seed: int = SEED) -> DataFrame:
    """(keys..., extra..., fp: array<long>, raw): one row per distinct key.
    ``extra`` columns are carried once per document. ``raw`` is the text's
    hash where no lexicon term occurs, else null."""
    extra = {**(extra or {}), "_raw": F.xxhash64(text)}
    rows = texts.select(*keys, *(c.alias(n) for n, c in extra.items()), F.posexplode_outer(terms(F.col(text))).alias("_at", "_word"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    rows = rows.select(*keys, *(F.when(first, F.col(n)).alias(n) for n in extra), F.when(F.col("_word").isNotNull(), F.xxhash64("_word")).alias("term"))
    listed = lex.withColumn("_in", F.col("term"))
    listed = F.broadcast(listed) if lex.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else listed
    docs = (rows.join(listed, "term", "left").groupBy(*keys)
            .agg(*(F.max(n).alias(n) for n in extra), F.array_sort(F.collect_list("_in")).alias("s0")))
    # Subset (f, l) keeps the terms whose family hash has 2 l + 2 zero bits at its end.
    names = []
    for level in range(1, LEVELS + 1):
        step = {}
        for f in range(FAMILIES):
            source = "s0" if level == 1 else f"s{level - 1}_{f}"
            step[f"s{level}_{f}"] = F.filter(source, _kept(seed * FAMILIES + f, 4 ** (level + 1) - 1))
        docs = docs.withColumns(step)
        names += list(step)
    fp = F.array(*(F.when(F.size(n) > 0, F.xxhash64(n)) for n in ["s0", *names]))
    return docs.select(*keys, *(n for n in extra if n != "_raw"), fp.alias("fp"), F.when(F.size("s0") == 0, F.col("_raw")).alias("raw"))


def _kept(family: int, mask: int):
    return lambda x: F.xxhash64(x, F.lit(family)).bitwiseAND(F.lit(mask)) == 0


def spelled(fp: Column, raw: Column) -> Column:
    """The fingerprint as text: hashes in hexadecimal, '-' for empty subsets."""
    names = F.transform(fp, lambda x: F.when(x.isNull(), F.lit("-")).otherwise(F.lower(F.hex(x))))
    return F.when(raw.isNull(), F.array_join(names, ".")).otherwise(F.concat(F.lit("text-"), F.lower(F.hex(raw))))


def likeness(fp: Column, raw: Column, other: Column, other_raw: Column) -> Column:
    """Share of agreeing subsets among those that hold terms of either text."""
    pairs = F.zip_with(fp, other, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.coalesce(x == y, F.lit(False)).cast("int")))
    pairs = F.filter(pairs, lambda x: x.isNotNull())
    share = F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / F.size(pairs)
    return F.when(raw.isNull() & other_raw.isNull(), share).otherwise(F.coalesce((raw == other_raw).cast("double"), F.lit(0.0)))
