"""Mixing sources to target weights by hierarchical budgeting.

The documents form a tree of levels (domain, language, source). A budget of
tokens flows from the root down by the weights of siblings. A node can use at
most ``epochs`` times the tokens below it; what it can't use goes to its
siblings first, and only when all of them are full to the siblings of its
parent (the parent's own capacity then is the shortage). Each level is one
water filling: with r = capacity / weight sorted inside the parent, nodes with
r below the fill level are full, the others get their weight's share.

Each leaf then takes a token prefix of its seeded epochs: epoch e visits the
leaf's documents in the order of md5(seed, e, id); whole epochs are taken
while the budget lasts, and of the last one the documents before the budget is
passed. The cut is found by narrowing on the hash prefix (sums of at most 16^k
groups), so no leaf's documents are ordered in one task; the last narrowing
step ranks the few documents that share the prefix.

Defined cases: null levels form a node of their own; null or negative token
counts count as 0; rows with equal id are ordered together and taken together;
weights default to 1; a zero or negative weight gets nothing, for the node and
all below it, and its tokens are no part of any capacity; ``tokens`` and
``epoch`` of the input are replaced; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm.tables import discard, free_prefix, stash

EPOCHS = 4
STEP = 3            # hash digits per narrowing step: at most 4096 groups a leaf
LEAF_ROWS = 2_000   # rows of a leaf that share a prefix before they are ranked
HASH_DIGITS = 32
NO_KEY = -(1 << 63)  # stands for a null id


def node_key(levels: list[str]):
    """One text for a node's path; a null level differs from every value."""
    return F.to_json(F.struct(*levels), {"ignoreNullFields": "false"})


def node_budgets(leaves: DataFrame, levels: list[str], budget: float, weights: dict[str, dict[str, float]],
                 epochs: int = EPOCHS) -> DataFrame:
    """(leaf, tokens, budget) of every leaf. ``leaves`` has the levels, ``leaf``
    (its node key) and ``tokens``; ``weights`` maps level -> value -> weight
    (default 1)."""
    def weight(level):
        w = F.lit(1.0)
        for value, x in weights.get(level, {}).items():
            w = F.when(F.col(level) == value, float(x)).otherwise(w)
        return w

    for name in levels:
        leaves = leaves.where(weight(name) > 0)
    given = None
    for k in range(len(levels)):
        here = levels[:k + 1]
        level = leaves.groupBy(*here).agg((F.sum("tokens") * epochs).cast("double").alias("cap"))
        level = level.withColumn("w", weight(levels[k])).withColumn("node", node_key(here))
        level = level.withColumn("up", node_key(here[:-1]) if k else F.lit(""))
        if given is None:
            level = level.withColumn("parent", F.lit(float(budget)))
        else:
            level = level.join(given, "up")
        order = Window.partitionBy("up").orderBy(F.col("cap") / F.col("w"), "node")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(0, Window.unboundedFollowing)
        level = (level.withColumn("rate", (F.col("parent") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)))
        # Full nodes come first. The rate rises up to the first node that isn't
        # full, which sets the fill level, and falls after it.
        fill = F.max(F.when(F.col("cap") > F.col("rate") * F.col("w"), F.col("rate"))).over(Window.partitionBy("up"))
        level = level.withColumn("fill", fill).withColumn("given", F.when(F.col("fill").isNull(), F.col("cap"))
                                                          .otherwise(F.least("cap", F.greatest("fill", F.lit(0.0)) * F.col("w"))))
        given = level.select(F.col("node").alias("up"), F.col("given").alias("parent"))
    return leaves.join(given.toDF("leaf", "given"), "leaf").select("leaf", "tokens", F.floor("given").alias("budget"))


def epoch_hash(seed: int, epoch, key):
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary"))


def cuts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """For every leaf the last (hash, key) inside its partial budget ``rest``:
    (leaf, last_h, last_k). ``docs`` has leaf, h, k, n."""
    open_ = plan.select("leaf", "rest", F.lit("").alias("prefix"))
    for depth in range(STEP, HASH_DIGITS + 2 * STEP, STEP):
        held = docs.join(open_, "leaf").where(F.col("h").startswith(F.col("prefix")))
        most = held.groupBy("leaf").count().agg(F.max("count")).first()[0] or 0
        if most <= LEAF_ROWS or depth > HASH_DIGITS:
            break
        sums = held.groupBy("leaf", "rest", F.substring("h", 1, depth).alias("p")).agg(F.sum("n").alias("s"))
        sums = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("leaf").orderBy("p")))
        # The group in which the budget is passed; the last one if the epoch fits.
        group = F.struct("p", "rest", "upto", "s")
        passed = sums.groupBy("leaf").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), group)), F.max(group)).alias("z"))
        open_ = stash(passed.select("leaf", (F.col("z.rest") - F.col("z.upto") + F.col("z.s")).alias("rest"), F.col("z.p").alias("prefix")), "open")
    ranked = held.withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("h", "k"))).where("upto <= rest")
    inside = ranked.groupBy("leaf").agg(F.max(F.struct("h", "k")).alias("m"))
    # Nothing of the last group fits: everything below its prefix is inside.
    return open_.join(inside, "leaf", "left").select("leaf", F.coalesce("m.h", "prefix").alias("last_h"),
                                                     F.coalesce("m.k", F.lit(NO_KEY)).alias("last_k"))


def mix(df: DataFrame, levels: dict, tokens, budget: float, weights: dict[str, dict[str, float]] | None = None,
        id_col: str = "doc_id", epochs: int = EPOCHS, seed: int = 17) -> DataFrame:
    """``df`` with each row repeated for the epochs it is taken in (column
    ``epoch`` from 0) and ``tokens``; ``budget`` is a share of all tokens.
    ``levels`` maps level name -> column, top first; ``tokens`` is a column."""
    own = free_prefix(df)
    names = [f"_{name}" for name in levels]
    weights = {f"_{name}": w for name, w in (weights or {}).items()}
    leaf_, k_, n_, taken_ = (own + c for c in ("leaf", "k", "n", "taken"))
    leaf = F.to_json(F.struct(*(c.cast("string").alias(f"_{name}") for name, c in levels.items())), {"ignoreNullFields": "false"})
    tagged = df.select("*", leaf.alias(leaf_), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_KEY)).alias(k_),
                       F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).alias(n_))
    light = stash(tagged.select(F.col(leaf_).alias("leaf"), F.col(k_).alias("k"), F.col(n_).alias("n")), "tokens")
    kinds = ", ".join(f"`{n}` string" for n in names)
    leaves = light.groupBy("leaf").agg(F.sum("n").alias("tokens")).withColumn("path", F.from_json("leaf", kinds)).select("leaf", "tokens", "path.*")
    leaves = stash(leaves, "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = node_budgets(leaves, names, total * budget, weights, epochs)
    # Whole epochs, then the rest of the budget in the next one.
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0))
    plan = stash(plan.select("leaf", full.cast("long").alias("full"), (F.col("budget") - full * F.col("tokens")).cast("long").alias("rest")), "plan")
    open_ = plan.where("rest > 0")
    part = light.join(open_.select("leaf", "full"), "leaf").select("leaf", epoch_hash(seed, F.col("full"), F.col("k")).alias("h"), "k", "n")
    part = stash(part.groupBy("leaf", "h", "k").agg(F.sum("n").alias("n")), "epoch")
    full_, last_h, last_k = (own + c for c in ("full", "last_h", "last_k"))
    rule = stash(plan.join(cuts(part, open_), "leaf", "left").toDF("leaf", "full", "rest", "last_h", "last_k")
                 .select(F.col("leaf").alias(leaf_), F.col("full").alias(full_), F.col("last_h").alias(last_h), F.col("last_k").alias(last_k)), "rule")
    discard(part, leaves, light)
    h = epoch_hash(seed, F.col(full_), F.col(k_))
    inside = F.coalesce((h < F.col(last_h)) | ((h == F.col(last_h)) & (F.col(k_) <= F.col(last_k))), F.lit(False))
    out = tagged.join(rule, leaf_).withColumn(taken_, F.col(full_) + inside.cast("long")).where(F.col(taken_) > 0)
    return out.select(*(c for c in df.columns if c.lower() not in ("tokens", "epoch")), F.col(n_).alias("tokens"),
                      F.explode(F.sequence(F.lit(0), (F.col(taken_) - 1).cast("int"))).alias("epoch"))
