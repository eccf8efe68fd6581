"""N-gram Jaccard join: grouped prefix join over word-shingle sets.

Two texts link when ``100 * |A n B| >= percent * |A u B|`` for their sets of
distinct five-word shingles (fewer words: the whole sequence as one shingle;
no words: empty, linked with nothing). Words are runs of bytes other than
white space (0x20, 0x09-0x0D), A-Z lower-cased. Shingles are compared by
64-bit hashes.

1. Every shingle gets a place in one total order: rare ones first, by a
   fixed-size count sketch (the order decides cost only, never the result).
   Linked sets share a token among the first ``n - ceil(t n) + 1`` of each.
2. Equal sets form one class, known by 64 bits of its digest; classes with
   equal prefix and size form one group, which is carried through the candidate
   step as one row.
3. For each prefix token that two different sets hold, one holder is the
   leader and is paired with the other groups (a star, linear in the list).
   Pairs are filtered by size and position, groups expand to their classes,
   and the pairs are verified on the full sets.
4. Linked pairs are merged to components. Lists whose holders are still in
   different components are paired across components where that makes at most
   PAIRS_A_ROW pairs a holder. Longer ones get another round of stars: LEADERS
   holders drawn by hash, those of the component with most rows first, meet the
   holders of other components, and leave the list. Pairs are also filtered by the
   triangle inequality of the Jaccard distance to the token's first leader.
5. After ROUNDS rounds what is left is paired within each list. Every linked
   pair whose ends aren't connected already is met in one of these steps.

Defined cases: null text counts as empty; rows that share an id are decided by
their texts; rows equal in id and text give one row; rows without id take part,
and a component without any id has a null ``component_id``; texts without words
are components of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm.tables import components, discard, small, stash, text_or_empty
from pulseframe.llm.textvec import WORDS, shingle_sets
from pulseframe.session import ship_package

SKETCH_BITS = 21   # counters of the order sketch: 2^21 of 4 bytes
CHUNK_BITS = 16    # counters carried in one row while sketches are added up
PARITY = ("q0", "q1", "q2", "q3")
BROADCAST_IDS = 1_000_000  # candidates sent to every executor at most (24 MB)
PAIRS_A_ROW = 32   # pairs a holder up to which lists are paired outright
ROUNDS = 2         # rounds of stars over longer lists
LEADERS = 32       # leaders of a list in each of them
NO_ID = (1 << 63) - 1


SLICE = 500  # rows whose sets are held at once


def slices(batches):
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _sketch_slot(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def order_sketch(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Number of texts per hashed shingle slot, over all texts. Partial
    sketches are added in two grouped steps; 2^bits counters come back."""
    n_chunks = max(1, 1 << (bits - CHUNK_BITS))

    def count(batches):
        from pyspark import TaskContext
        acc = np.zeros(1 << bits, dtype=np.uint32)
        for b in batches:
            for _, s in shingle_sets(b.column("text"), words):
                np.add.at(acc, _sketch_slot(s, bits), 1)
        part = TaskContext.get().partitionId()
        parts = np.split(acc, n_chunks)
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(range(n_chunks), pa.int32()), "salt": pa.array([part % 64] * n_chunks, pa.int32()),
            "blob": pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        acc = None
        for blob in rows["blob"]:
            x = np.frombuffer(zlib.decompress(blob.as_buffer()), dtype=np.uint32)
            # Saturating, so that no counter wraps at any corpus size.
            acc = x.copy() if acc is None else np.minimum(acc.astype(np.uint64) + x, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"chunk": rows["chunk"][:1], "salt": pa.array([0], pa.int32()), "blob": pa.array([zlib.compress(acc.tobytes(), 1)], pa.binary())})

    schema = "chunk int, salt int, blob binary"
    rows = docs.select("text").mapInArrow(count, schema)
    total = rows.groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    out = np.zeros(1 << bits, dtype=np.uint32)
    size = (1 << bits) // n_chunks
    for r in total.collect():  # n_chunks rows
        out[r["chunk"] * size:(r["chunk"] + 1) * size] = np.frombuffer(zlib.decompress(r["blob"]), dtype=np.uint32)
    return out


def prefix_table(docs: DataFrame, percent: int, words: int, bits: int) -> DataFrame:
    """One row per text: id, t, n (set size), key (64 bits of the set's digest), g
    (hash of prefix and size), prefix (tokens in the global order), parities."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(order_sketch(docs, words, bits))

    def rows(batches):
        counts = order.value
        for b in slices(batches):
            n, key, g, prefix, parity = [], [], [], [], []
            for _, s in shingle_sets(b.column("text"), words):
                keep = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                pre = s[np.lexsort((s, counts[_sketch_slot(s, bits)]))[:keep]]
                n.append(len(s))
                key.append(set_key(s))
                g.append(int.from_bytes(hashlib.blake2b(pre.tobytes() + len(s).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                prefix.append(pre.view(np.int64))
                parity.append(np.packbits(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            q = np.stack(parity)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("t"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(g, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prefix))), *(pa.array(q[:, k].copy()) for k in range(4))],
                names=["id", "t", "n", "key", "g", "prefix", *PARITY])

    out = stash(docs.select("id", "t", "text").mapInArrow(
        rows, "id long, t long, n long, key long, g long, prefix array<long>, q0 long, q1 long, q2 long, q3 long"), "prefixes")
    order.destroy()
    return out


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def verified(docs: DataFrame, sets_: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Exact set sizes of the pairs of sets (a, b): rows (a, b, na, nb, common)."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    need = sets_.join(need, "key", "left_semi").select("key", F.col("low").alias("nid"), F.col("t").alias("nt"))

    def sets(batches):
        seen = set()  # repeated rows: a set is made once in a task
        for b in slices(batches):
            fresh = []
            for i, k in enumerate(b.column("key").to_pylist()):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            b = b.take(pa.array(fresh, pa.int64()))
            found = [s for _, s in shingle_sets(b.column("text"), words)]
            right = pa.array([set_key(s) == k for s, k in zip(found, b.column("key").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "s"]).filter(right)

    need = stash(need, "needed")
    same = F.col("id").eqNullSafe(F.col("nid")) & (F.col("t") == F.col("nt"))
    own = stash(docs.join(small(need, BROADCAST_IDS), same).select("key", "text").mapInArrow(sets, "key long, s binary"), "sets")

    def common(batches):
        for b in batches:
            na, nb, k = [], [], []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                na.append(len(x))
                nb.append(len(y))
                k.append(len(np.intersect1d(x, y, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(v, pa.int64()) for v in (na, nb, k))],
                                             names=["a", "b", "na", "nb", "common"])

    both = (pairs.join(own.toDF("b", "sb"), "b").join(own.toDF("a", "sa"), "a").select("a", "b", "sa", "sb"))
    # A row that several tasks read gives a set for each of them.
    out = stash(both.mapInArrow(common, "a long, b long, na long, nb long, common long").distinct(), "verified")
    discard(own, need)
    return out


def _possible(percent, na, nb, pa_, pb):
    """Size and position filters for a common token at 0-based places."""
    need = F.ceil(F.lit(percent) * (F.col(na) + F.col(nb)) / F.lit(100 + percent))
    room = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
    return (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)) & (room >= need)


def _few_bits(percent, na, nb, qa, qb):
    """Parity filter."""
    bits = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(qa, qb)), F.lit(0))
    return bits * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = WORDS,
                    sketch_bits: int = SKETCH_BITS, pairs_a_row: float = PAIRS_A_ROW, rounds: int = ROUNDS, leaders: int = LEADERS) -> DataFrame:
    """Rows (id, t, rows, n_shingles, component_id, component): every text (t: its
    hash, rows: how often it occurs under its id), the least id of its component
    and the component's own number (null for texts without words)."""
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("t", F.xxhash64("text"))
    meta = prefix_table(docs, percent, words, sketch_bits)

    # Distinct sets, each with one of its texts.
    texts = stash(meta.groupBy("id", "t", "key", "n").agg(F.count("*").alias("rows"), F.first("g").alias("g"), *(F.first(q).alias(q) for q in PARITY)), "texts")
    sets_ = stash(texts.groupBy("key").agg(F.first("n").alias("n"), F.first("g").alias("g"), *(F.first(q).alias(q) for q in PARITY), F.min("id").alias("low"),
                                           F.min_by("t", F.coalesce("id", F.lit(NO_ID))).alias("t")), "distinct-sets")

    # Tokens held by at least two different sets, and their leaders. Most tokens have
    # one holder: rows are narrow, are shuffled once, and get their group afterwards.
    holders = meta.where("n > 0").select(F.col("n").cast("int").alias("n"), "key", F.posexplode("prefix").alias("pos", "token"))
    over = Window.partitionBy("token")
    held = {"leader": F.min("key"), "hi": F.max("key"), "ln": F.min_by("n", "key"), "rows": F.count("*"),
            "least": F.min("n"), "both": F.sum("n"), "room": F.min(F.col("n") - F.col("pos"))}
    tokens = (holders.select("*", *(f.over(over).alias(c) for c, f in held.items()))
              .where("leader <> hi")
              # The size and position filters, exact for a list of two.
              .where(F.expr(f"rows > 2 or (100 * least >= {percent} * (both - least) and {100 + percent} * room >= {percent} * both)"))
              .select("token", "key", F.col("n").cast("long").alias("n"), "pos", "leader", F.col("ln").cast("long").alias("ln")))
    # One row for each group of a token.
    lists = stash(tokens.join(sets_.select("key", "g"), "key").groupBy("token", "g").agg(*(F.min(c).alias(c) for c in ("n", "pos", "leader", "ln"))), "lists")
    discard(meta)

    other = [q + "2" for q in PARITY]
    members = sets_.select("g", F.col("key").alias("b"), F.col("n").alias("nb"), *PARITY)
    led = sets_.select(F.col("key").alias("leader"), F.col("n").alias("na"), *(F.col(q).alias(q + "2") for q in PARITY))
    alike = F.lit(100) * F.least("ln", "n") >= F.lit(percent) * F.greatest("ln", "n")
    star = (lists.where(alike).select("leader", "g").distinct()
            .join(members, "g").where("b <> leader").join(led, "leader")
            .where(_few_bits(percent, "na", "nb", other, PARITY))
            .select(F.least("leader", "b").alias("a"), F.greatest("leader", "b").alias("b")).distinct())
    star = stash(star, "star")
    seen = verified(docs, sets_, star, words)

    def linked(v):
        return v.where(F.col("common") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")

    comp = components(linked(seen), "star-components")
    # A pair that the parity filter dropped isn't linked; its distance is unknown.
    far = seen.select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d"))
    far = far.union(far.select("b", "a", "d")).toDF("leader", "key", "d")
    tags = ["token", "key", "n", "pos", "d", *PARITY]

    def mixed(rows, comp):
        """The rows of tokens whose holders are still in several components."""
        rows = rows.join(comp.toDF("key", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        split = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        return stash(rows.join(split, "token", "left_semi").select(*tags, "comp"), "mixed")

    # Groups first, so that tokens of one component don't expand to their sets.
    span = (sets_.select("key", "g").join(comp.toDF("key", "comp"), "key", "left").groupBy("g")
            .agg(F.min(F.coalesce("comp", "key")).alias("lo"), F.max(F.coalesce("comp", "key")).alias("hi")))
    split = lists.select("token", "g").join(span, "g").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    rest = (lists.join(split, "token", "left_semi").select("token", "g", "n", "pos", "leader").join(sets_.select("key", "g", *PARITY), "g")
            .where("key <> leader").join(far, ["leader", "key"], "left"))
    rest = mixed(rest.select(*tags), comp)
    made, found = [star], [seen]
    reach = 1 - percent / 100 + 1e-9
    near = F.coalesce(F.abs(F.col("d") - F.col("d2")), F.lit(0.0)) <= reach
    for turn in range(rounds + 1):
        if rest.isEmpty():
            break
        y = [F.col(c).alias(c + "2") for c in ("key", "n", "pos", "comp", "d", *PARITY)]
        long = stash(rest.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token")
                     .agg(F.sum("c").cast("double").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
                     .where((F.col("s") * F.col("s") - F.col("q")) / 2 > F.lit(float(pairs_a_row)) * F.col("s")).select("token"), "long-lists")
        last = turn == rounds or long.isEmpty()
        short = rest if last else rest.join(long, "token", "left_anti")
        met = short.join(short.select("token", *y), "token").where("key < key2 and comp <> comp2")
        if not last:
            held = rest.join(long, "token", "left_semi")
            weight = held.groupBy("comp").agg(F.count("*").alias("weight"))
            draw = F.xxhash64("key", F.lit(turn))
            lead = (held.join(weight, "comp").groupBy("token", F.pmod(draw, F.lit(leaders)).alias("seat"))
                    .agg(F.max(F.struct("weight", draw.alias("draw"), "key", "n", "pos", "comp", "d", *PARITY)).alias("x"))
                    .select("token", "x.*").select("token", *y))
            lead = stash(lead, "leaders")
            met = met.unionByName(held.join(lead, "token").where("key <> key2 and comp <> comp2"))
        met = (met.where(_possible(percent, "n", "n2", "pos", "pos2")).where(_few_bits(percent, "n", "n2", PARITY, other)).where(near)
               .select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct())
        for m in made:
            met = met.join(m, ["a", "b"], "left_anti")
        met = stash(met, "met")
        made.append(met)
        found.append(verified(docs, sets_, met, words))
        links = linked(found[0])
        for v in found[1:]:
            links = links.union(linked(v))
        comp = components(links, "components")
        if last:
            break
        spent = lead.select("token", F.col("key2").alias("key"))
        smaller = mixed(held.join(spent, ["token", "key"], "left_anti").select(*tags), comp)
        discard(rest, lead, long)
        rest = smaller

    # A component's least node has no row of its own in ``comp``.
    comp = comp.toDF("key", "c")
    comp = comp.union(comp.select("c", "c").distinct())
    least = comp.join(sets_.select("key", "low"), "key").groupBy("c").agg(F.min("low").alias("component_id"))
    label = (sets_.select("key", "low").join(comp, "key", "left").join(least, "c", "left")
             .select("key", F.coalesce("c", "key").alias("component"), F.when(F.col("c").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id")))
    worded = F.col("n") > 0
    out = (texts.join(label, "key")
           .select("id", "t", "rows", F.col("n").alias("n_shingles"), F.when(worded, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                   F.when(worded, F.col("component")).alias("component")))
    discard(lists, rest, *made, *found)
    return out
