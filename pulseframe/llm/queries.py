"""The registered queries of the training-data operators: each applies its
operator with production parameters to a whole table and derives the result
columns from it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import (align, edited, encode, hilbert, imatch, kneser_ney, licences, linededup, merkle, mixing, prefixjoin, repair, simhash,
                            warc)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lex = imatch.lexicon(docs, "text")
    both = edited.edited_texts(docs)
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"))))
    texts = both.select("id", "next_id", "t", kinds.alias("v")).select("id", "next_id", "t", "v.kind", "v.body")
    fps = imatch.fingerprints(texts, lex, ["id", "t", "kind"], "body", {
        "next": F.col("next_id"), "n_chars": F.length("body").cast("long"), "sha": F.sha2("body", 256)})
    # Own fingerprint, that of the edited text, and what goes to the document before.
    own = F.col("kind") == 0
    rows = fps.groupBy("id", "t").agg(
        F.max("next").alias("next_id"), *(F.max(F.when(own, F.col(c))).alias(a) for c, a in (("n_chars", "n_chars"), ("raw", "raw"))),
        *(F.max(F.when(~own, F.col(c))).alias(a) for c, a in (("sha", "sha"), ("raw", "eraw"))),
        F.max(F.when(own, F.struct("fp"))).alias("f"), F.max(F.when(~own, F.struct("fp"))).alias("e"))
    rows = rows.select("id", "next_id", F.struct("t", "n_chars", "sha", "raw", "eraw", F.col("f.fp").alias("fp"), F.col("e.fp").alias("efp")).alias("o"))
    return rows.transform(_with_next)


def _with_next(rows: DataFrame) -> DataFrame:
    """Each row meets the fingerprint of its next document."""
    out = rows.select("id", "next_id", "o").withColumn("m", F.explode(F.array(F.lit(0), F.lit(1))))
    previous = F.col("m") == 1
    # A document's fingerprint is sent under its own id; rows ask under the next id.
    sent = out.select(F.when(previous, F.col("id")).otherwise(F.col("next_id")).alias("key"),
                      F.when(~previous, F.struct("id", "o")).alias("row"),
                      F.when(previous, F.struct(F.col("o.fp").alias("fp"), F.col("o.raw").alias("raw"))).alias("next"))
    met = sent.groupBy("key").agg(F.collect_list("row").alias("rows"), F.min("next").alias("next"))
    r = met.select(F.explode("rows").alias("r"), "next").select("r.id", "r.o.*", "next")
    return r.select(F.col("id").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
                    imatch.spelled(F.col("fp"), F.col("raw")).alias("fingerprint"), imatch.spelled(F.col("efp"), F.col("eraw")).alias("edited_fingerprint"),
                    imatch.likeness(F.col("fp"), F.col("raw"), F.col("efp"), F.col("eraw")).alias("near_edited"),
                    imatch.likeness(F.col("fp"), F.col("raw"), F.col("next.fp"), F.col("next.raw")).alias("near_next"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kneser_ney.quality(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return out.drop("t").withColumnRenamed("id", "doc_id")


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def domain():
    """The test tables have no domain column: it is the parity of the source's number."""
    number = F.regexp_extract("source", r"(\d+)$", 1)
    return F.when(number == "", "other").when(number.cast("long") % 2 == 0, "web").otherwise("books")


MIX_WEIGHTS = {"domain": {"web": 0.55, "books": 0.45}, "language": {"en": 0.55, "fr": 0.2, "de": 0.15, "es": 0.1}}
MIX_BUDGET = 0.9


def mixed(docs: DataFrame) -> DataFrame:
    levels = {"domain": domain(), "language": F.col("lang"), "source": F.col("source")}
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))
    return mixing.mix(docs, levels, words, MIX_BUDGET, MIX_WEIGHTS)


def op5_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", domain().alias("domain"), "lang", "source", F.col("epoch").cast("long").alias("epoch"), "tokens")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = licences.licence_spans(table(spark, sf_dir, "documents"))
    return (spans.groupBy("id", "licence").agg(F.max("containment").alias("containment"), F.count_distinct("first_word").alias("places"),
                                               F.min("first_word").alias("first_word"))
            .withColumnRenamed("id", "doc_id"))


def op7_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return out.withColumnRenamed("id", "vec_id")


def op9_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.withColumnRenamed("id", "doc_id")


def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefixjoin.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*MANIFEST_FIELDS)
    tampered = [lower_ascii(f) if f == "text" else f for f in MANIFEST_FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_hash(*(F.col(f) if isinstance(f, str) else f for f in tampered)))
    m = merkle.manifest(docs, "lang", "doc_id", MANIFEST_FIELDS, {"changed": changed})
    out = merkle.proofs(m, F.col("changed"), ["id"])
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
                      "verified")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = align.scored(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_imatch, op2_kneser_ney, op3_line_windows, op4_warc, op5_budget_mix, op6_licences,
                                   op7_transducer_bpe, op8_hilbert_ann, op9_repair_tokens, op10_prefix_join, op11_merkle,
                                   op12_alignment, op13_simhash)}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _climb(name: str, levels: int) -> str:
    """CTEs that raise ``{name}_n0`` (g, pos, d) and the proofs ``{name}_f0`` (g,
    p, proof, cur, ...) by so many levels; a group of one node stays."""
    out = []
    for k in range(levels):
        out.append(f"""
{name}_s{k} AS (
  SELECT g, pos, d, count(*) OVER (PARTITION BY g) AS c,
         coalesce(string_agg(d, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
         coalesce(string_agg(d, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi
  FROM {name}_n{k}
), {name}_n{k + 1} AS (
  SELECT g, pos // 8 AS pos, CASE WHEN max(c) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d
  FROM {name}_s{k} GROUP BY g, pos // 8
), {name}_f{k + 1} AS (
  SELECT f.* REPLACE (f.p // 8 AS p, f.proof || s.lo || s.hi AS proof, CASE WHEN s.c = 1 THEN f.cur ELSE sha256(s.lo || f.cur || s.hi) END AS cur)
  FROM {name}_f{k} f JOIN {name}_s{k} s ON f.g = s.g AND f.p = s.pos
),""")
    return "".join(out)


def _leaf_sql(text: str) -> str:
    fields = ["cast(doc_id AS varchar)", "source", "lang", "cast(n_chars AS varchar)", text]
    return "sha256(" + " || ".join(f"coalesce(cast(strlen({f}) AS varchar) || ':' || {f}, '-')" for f in fields) + ")"


# CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(cast(doc_id AS varchar), ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

_MERKLE_SQL = f"""
WITH t_l AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf_sql("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_leaf_sql(f"translate(text, {_LETTERS})")} END AS changed
  FROM documents
), t_f0 AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, '' AS proof, coalesce(changed, leaf) AS cur FROM t_l
), t_n0 AS (SELECT g, p AS pos, leaf AS d FROM t_f0),
{_climb("t", 10)}
u_r AS (SELECT g AS grp, d, row_number() OVER (ORDER BY g) - 1 AS pos FROM t_n10),
u_n0 AS (SELECT '' AS g, pos, d FROM u_r),
u_f0 AS (SELECT f.doc_id, f.leaf, r.d AS subroot, '' AS g, r.pos AS p, f.proof, f.cur FROM t_f10 f JOIN u_r r ON f.g = r.grp),
{_climb("u", 4)}
fin AS (SELECT f.*, n.d AS root FROM u_f4 f JOIN u_n4 n ON f.g = n.g)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM fin
"""

ORACLES = {
    # Trees of up to 8^10 documents a language and 8^4 languages.
    "op11_merkle": _MERKLE_SQL,
    # The lines covered by later occurrences of repeated three-line windows.
    "op3_line_windows": """
WITH l AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, i AS line, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS win
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l)
), o AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS k FROM w
), c AS (
  SELECT DISTINCT doc_id, line + d AS line FROM o, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1
), s AS (
  SELECT doc_id, text IS NULL AS none, lines[i] AS line, i FROM (SELECT doc_id, text, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)
), kept AS (
  SELECT s.doc_id, count(*) AS n, count(c.line) AS removed,
         CASE WHEN NOT bool_or(s.none) THEN coalesce(string_agg(s.line, chr(10) ORDER BY s.i) FILTER (WHERE c.line IS NULL), '') END AS text
  FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.line = s.i GROUP BY s.doc_id
)
SELECT doc_id, n AS n_lines, removed AS n_removed, text FROM kept
""",
}
