"""Quality classifier: interpolated modified Kneser-Ney n-gram model.

The model is trained on trusted text and scores every document by its
perplexity; a document is rejected when its score lies above a quantile of
the trusted documents of its language.

Symbols are the bytes of the text in UTF-8 as they are: letters, their case,
digits, marks and all scripts are told apart, and no text has an unknown symbol.
The order is 5. Perplexities and scores are per code point. Counts are
gathered from all trusted text (partial counts per task, summed by n-gram).
Texts fall in two folds by their hash, and each fold is scored with the model
of the other one: trusted documents are scored held out, so their quantiles
hold for documents that the model hasn't seen, and equal texts score alike.
When a fold has no trusted text, one model of all of it scores every document.

Everything is a join of count tables sharded by n-gram or context: continuation
counts, discounts, context totals, back-off weights, and the probability of
every distinct n-gram that any document asks for, order by order. Tables of
n-grams grow with the corpus. The asked probabilities go back to the documents
as a broadcast when they are at most ``broadcast_grams`` (counted); beyond that
documents are dealt in chunks, and each chunk is joined with the n-grams it
asked for.

Short documents: ``prior`` symbols at the trusted mean are added to the score,
so that a few rare letters don't reject a text of ten characters. Defined
cases: null text counts as empty; empty texts have null perplexity and the
trusted mean as score (kept); a null or unseen language uses the quantile of
all trusted documents; without trusted text every document is kept; repeated
rows are scored each; further columns of ``df`` are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm.tables import free_prefix, small, stash, text_or_empty
from pulseframe.session import ship_package

SYMBOLS = 257
ORDER = 5
QUANTILE = 0.999
MARGIN = 1.01         # factor on the trusted quantile of the score
PRIOR = 20
BINS = 1000           # score bins per nat for the exact quantiles
BROADCAST_IDS = 5_000_000
BROADCAST_GRAMS = 4_000_000   # 16 bytes each
CHUNK_CHARS = 16_000_000      # code points scored together where the n-grams are no broadcast
HELD = 1_000_000              # n-grams a task holds before it adds them up (about 80 bytes each meanwhile)


def _symbols(text: str) -> np.ndarray:
    """The bytes of a text, from 1 on (0 is the text start)."""
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64) + 1


PIECE = 1 << 20  # code points worked on at once


def _grams(text: str):
    """Codes of the n-gram ending at every symbol, in pieces."""
    last = np.zeros(ORDER - 1, np.int64)
    for i in range(0, len(text), PIECE):
        s = np.concatenate([last, _symbols(text[i:i + PIECE])])
        code = s[:len(s) - ORDER + 1].copy()
        for k in range(1, ORDER):
            code *= SYMBOLS
            code += s[k:len(s) - ORDER + 1 + k]
        last = s[len(s) - ORDER + 1:]
        yield code


def _kept_grams(pairs):
    """(gram, count) arrays added up, passed on when more than HELD are held."""
    grams, counts, held = [], [], 0

    def added():
        k, at = np.unique(np.concatenate(grams), return_inverse=True)
        return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

    for k, c in pairs:
        grams.append(k)
        counts.append(c)
        held += len(k)
        if held > HELD:
            k, c = added()
            if 2 * len(k) > HELD:
                yield k, c
                k, c = k[:0], c[:0]
            grams, counts, held = [k], [c], len(k)
    if held:
        yield added()


def gram_counts(texts: DataFrame, keep: str | None = None) -> DataFrame:
    """(k, c): counts of the n-grams of ``text`` in model ``m``'s numbering
    (m * SYMBOLS ** ORDER + code); with ``keep`` (a column) by its values."""
    cols = ["m", "text", *([keep] if keep else [])]

    def count(batches):
        held: dict = {}

        def counted(b, rows):
            m, texts = b.column("m").to_pylist(), b.column("text").to_pylist()
            for i in rows:
                for code in _grams(texts[i]):
                    yield np.unique(code + m[i] * SYMBOLS ** ORDER, return_counts=True)

        def of_all():
            for b in batches:
                yield from counted(b, range(b.num_rows))

        def out(k, c, value=None):
            for i in range(0, len(k), 100_000):
                cols = {"k": pa.array(k[i:i + 100_000]), "c": pa.array(c[i:i + 100_000])}
                if keep:
                    cols[keep] = pa.array([value] * len(cols["k"]), pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

        if not keep:
            for k, c in _kept_grams(of_all()):
                yield from out(k, c)
            return
        for b in batches:
            held.clear()
            for i, v in enumerate(b.column(keep).to_pylist()):
                held.setdefault(v, []).append(i)
            for v, rows in held.items():
                for k, c in _kept_grams(counted(b, rows)):
                    yield from out(k, c, v)

    schema = "k long, c long" + (f", {keep} long" if keep else "")
    made = texts.select(*cols).mapInArrow(count, schema)
    return made.groupBy("k", *([keep] if keep else [])).agg(F.sum("c").alias("c"))


def _lower(n: int):
    """The n-gram of order ``n`` without its first symbol, same model."""
    return F.expr(f"(k div {SYMBOLS ** n}) * {SYMBOLS ** (n - 1)} + k % {SYMBOLS ** (n - 1)}")


def discounts(counts: dict[int, DataFrame]) -> dict[tuple[int, int], tuple[float, float, float]]:
    """D1, D2, D3+ by (order, model) from the counts of counts."""
    all_ = None
    for n, t in counts.items():
        t = t.groupBy(F.lit(n).alias("n"), F.expr(f"k div {SYMBOLS ** n}").alias("m")).agg(
            *(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
        all_ = t if all_ is None else all_.unionByName(t)
    out = {}
    for r in all_.collect():  # one row for each order and model
        n1, n2, n3, n4 = r["n1"], r["n2"], r["n3"], r["n4"]
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        out[r["n"], r["m"]] = tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))
    return out


def continuations(counts: DataFrame) -> dict[int, DataFrame]:
    """Counts of all orders: those of the highest, and below it the numbers of
    distinct left extensions."""
    out = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        out[n] = stash(out[n + 1].groupBy(_lower(n + 1).alias("k")).agg(F.count("*").alias("c")), "grams")
    return out


def gram_costs(counts: dict[int, DataFrame], asked: DataFrame) -> DataFrame:
    """(k, cost): -ln p(w | h) of every n-gram of ``asked`` (distinct k)."""
    cuts = discounts(counts)
    wanted = {ORDER: asked}
    for n in range(ORDER - 1, 0, -1):
        wanted[n] = wanted[n + 1].select(_lower(n + 1).alias("k")).distinct()
    p = None
    for n in range(1, ORDER + 1):
        # One shuffle by context serves the totals, the back-off mass and the
        # lookup of the asked n-grams; a context has SYMBOLS rows at most.
        rows = counts[n].select("k", "c", F.lit(0).alias("asked")).unionByName(
            wanted[n].select("k", F.lit(0).cast("long").alias("c"), F.lit(1).alias("asked")))
        rows = (rows.withColumn("h", F.expr(f"k div {SYMBOLS}")).repartition("h").groupBy("h", "k")
                .agg(F.sum("c").alias("c"), F.max("asked").alias("asked")))
        model = F.expr(f"k div {SYMBOLS ** n}")
        cut = F.lit(0.0)
        for (order, m), (d1, d2, d3) in cuts.items():
            if order == n:
                d = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
                cut = F.when(model == m, d).otherwise(cut)
        w = Window.partitionBy("h")
        rows = rows.withColumn("cut", cut).select("k", "asked", "c", "cut", F.sum("c").over(w).alias("total"), F.sum("cut").over(w).alias("mass"))
        rows = rows.where("asked = 1").select(
            "k", F.when(F.col("total") > 0, (F.col("c") - F.col("cut")) / F.col("total")).otherwise(0.0).alias("a"),
            F.when(F.col("total") > 0, F.col("mass") / F.col("total")).otherwise(1.0).alias("b"))
        # Interpolation with the order below: p(w | h) = a + b(h) p(w | h').
        if n == 1:
            p = rows.select("k", (F.col("a") + F.col("b") / (SYMBOLS - 1)).alias("p"))
        else:
            below = p.select(F.col("k").alias("low"), F.col("p").alias("p_low"))
            p = (rows.withColumn("low", _lower(n)).join(below, "low")
                 .select("k", (F.col("a") + F.col("b") * F.col("p_low")).alias("p")))
    return p.select("k", (-F.log(F.greatest("p", F.lit(1e-12)))).cast("float").alias("cost"))


def _nll(text: str, model: int, keys: np.ndarray, cost: np.ndarray) -> float:
    out = 0.0
    for code in _grams(text):
        k, c = np.unique(code, return_counts=True)
        out += float(np.dot(cost[np.searchsorted(keys, k + model * SYMBOLS ** ORDER)].astype(np.float64), c))
    return out


def cross_entropy(docs: DataFrame, counts: dict[int, DataFrame], keep: list[str], broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Add ``nll`` (summed) and ``symbols`` to the columns ``keep`` of ``docs``
    (which also has ``m``, the model to use, and ``text``)."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", nll double, symbols long"
    asked = stash(gram_counts(docs).select("k"), "asked")

    def scored(b, keys, cost):
        rows = zip(b.column("text").to_pylist(), b.column("m").to_pylist())
        nll, n = zip(*((_nll(t, m, keys, cost), len(t)) for t, m in rows)) if b.num_rows else ((), ())
        return [*(b.column(k) for k in keep), pa.array(nll, pa.float64()), pa.array(n, pa.int64())]

    if asked.count() <= broadcast_grams:
        costs = gram_costs(counts, asked).toArrow()
        keys = costs["k"].to_numpy()
        order = np.argsort(keys)
        table = docs.sparkSession.sparkContext.broadcast((keys[order], costs["cost"].to_numpy()[order]))

        def score(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays(scored(b, *table.value), names=[*keep, "nll", "symbols"])

        return docs.select(*keep, "m", "text").mapInArrow(score, kinds)

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // CHUNK_CHARS + 1
    # Written once, so that both readers see the same chunks.
    dealt = stash(docs.select(*keep, "m", "text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("chunk")), "chunks")
    costs = gram_counts(dealt, "chunk").select("chunk", "k").join(gram_costs(counts, asked), "k")

    def score_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right["k"].to_numpy()
        order = np.argsort(keys)
        left = left.combine_chunks()
        return pa.Table.from_arrays(scored(left, keys[order], right["cost"].to_numpy()[order]), names=[*keep, "nll", "symbols"])

    return dealt.groupBy("chunk").cogroup(costs.groupBy("chunk")).applyInArrow(score_chunk, kinds)


def quality(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            quantile: float = QUANTILE, margin: float = MARGIN, prior: int = PRIOR,
            broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Rows (id, lang, t, symbols, perplexity, score, threshold, keep) of every
    row of ``df``, ``t`` being the text's hash; ``trusted`` holds the ids (one column) of trusted documents."""
    ship_package(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    ids = small(trusted.select(F.col(trusted.columns[0]).alias("id")).where("id is not null").distinct(), BROADCAST_IDS)
    sure = docs.join(ids, "id", "left_semi")
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).cast("long")
    both = sure.where("text <> ''").agg(F.min(fold), F.max(fold)).first()
    null = F.lit(None).cast("double")
    if both[0] is None:
        return docs.select("id", "lang", F.xxhash64("text").alias("t"), F.length("text").cast("long").alias("symbols"), null.alias("perplexity"),
                           null.alias("score"), null.alias("threshold"), F.lit(True).alias("keep"))
    # Model m is of the texts in the other fold.
    split = both[0] != both[1]
    counts = continuations(stash(gram_counts(sure.withColumn("m", 1 - fold if split else F.lit(0).cast("long"))), "grams"))
    docs = docs.withColumn("m", fold if split else F.lit(0).cast("long"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    scored = cross_entropy(docs, counts, ["id", "lang", "t"], broadcast_grams).join(ids.withColumn("trusted", F.lit(True)), "id", "left")
    scored = stash(scored, "scores")
    mean = scored.where("trusted").agg(F.sum("nll") / F.greatest(F.sum("symbols"), F.lit(1))).first()[0]
    scored = scored.withColumn("score", (F.col("nll") + prior * mean) / (F.col("symbols") + prior))

    # Exact quantiles of binned scores; the bins of a language are a few thousand.
    bins = (scored.where("trusted").groupBy("lang", F.ceil(F.col("score") * BINS).alias("bin")).count())
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("count").alias("count")).withColumn("lang", F.lit(None).cast("string"))
                            .withColumn("all", F.lit(True)), allowMissingColumns=True).withColumn("all", F.coalesce("all", F.lit(False)))
    w = Window.partitionBy("all", "lang")
    limits = (bins.withColumn("below", F.sum("count").over(w.orderBy("bin"))).withColumn("total", F.sum("count").over(w))
              .where(F.col("below") >= F.col("total") * quantile).groupBy("all", "lang")
              .agg((F.min("bin") / BINS * margin).alias("limit")))
    whole = limits.where("all").select(F.max("limit").alias("limit"))
    return (scored.join(limits.where("not all").select("lang", F.col("limit").alias("own")), "lang", "left")
            .withColumn("threshold", F.coalesce("own", whole.scalar()))
            .select("id", "lang", "t", "symbols", F.when(F.col("symbols") > 0, F.exp(F.col("nll") / F.col("symbols"))).alias("perplexity"),
                    "score", "threshold", (F.col("score") <= F.col("threshold")).alias("keep")))


def keep_good(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose text isn't rejected, columns as they are. Rows
    that share an id, or have none, are decided by their texts."""
    id_, t_ = (free_prefix(df) + c for c in ("id", "t"))
    bad = stash(quality(df, trusted, id_col=id_col, text_col=text_col, **options).where("not keep").select("id", "t").distinct().toDF(id_, t_), "rejected")
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty(text_col)) == F.col(t_))
    return df.join(small(bad, BROADCAST_IDS), same, "left_anti")
