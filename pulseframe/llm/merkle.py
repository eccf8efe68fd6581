"""Merkle manifest of a table, its blocks in a van Emde Boas layout.

Each row is a leaf: the SHA-256 of its fields (``-`` for null, else UTF-8 byte
count, ``:``, value). Within a group (a language), leaves ascend by id; while
several nodes remain, every 8 consecutive ones become the hash of their hex
digests. The groups' roots, ordered by group (null first, bytewise), likewise
give the root of the table.

A tree is stored as aligned blocks of 8^height leaves. A block is one row whose
``nodes`` hold a complete subtree, recursively split at half its height: the top
half first, then the bottom subtrees from left to right, each laid out alike. A
node's place is found by arithmetic on (depth, index) alone, for the building as
for the siblings of a proof, and a run of siblings is contiguous at any cache
size. The blocks' roots are the leaves of the next tier of blocks, up to one
block per group; the groups' roots form a tree of the same kind.

A proof (``path``) holds for every level, leaf first, one byte for the size of
the run, one for the own place in it, and the digests of the others.

Leaves are numbered by ranges of (group, id), so that no group is gathered; a
task holds the leaves of one block at a time.

Defined cases: rows with null id come first in their group; rows that share an
id follow the order of their leaves, and equal rows are leaves of their own; a
group of one row has its leaf as root; an empty table gives empty results. Only
the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm.tables import partitions, small, stash
from pulseframe.session import ship_package

ARITY_BITS = 3       # eight nodes to a run
HEIGHT = 3           # hashed levels of a block: 512 leaves
OFFSET_ROWS = 200_000  # (range, group) offsets sent to the executors at most
DIGEST = 32


def subtree_size(levels: int) -> int:
    """Nodes of a complete subtree."""
    return ((1 << ARITY_BITS * levels) - 1) // ((1 << ARITY_BITS) - 1)


def address(levels: int, depth: int, i):
    """Place of node ``i`` (a number or an array) at ``depth`` (0: root) in a
    complete subtree of ``levels`` levels, split at half height."""
    at = i * 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        sub = i >> ARITY_BITS * depth
        at = at + subtree_size(top) + sub * subtree_size(levels)
        i = i - (sub << ARITY_BITS * depth)
    return at


def joined(digests: bytes) -> bytes:
    """Hash of digests, concatenated as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height_of(n: int, height: int) -> int:
    """Hashed levels of the block that holds a whole tier of ``n`` nodes."""
    h = 0
    while h < height and (1 << ARITY_BITS * h) < n:
        h += 1
    return h


def lay_out(leaves: np.ndarray, height: int) -> bytes:
    """Block of a run of leaves (rows of bytes); absent nodes are zeros."""
    nodes = np.zeros((subtree_size(height + 1), DIGEST), np.uint8)
    row = leaves
    for depth in range(height, -1, -1):
        nodes[address(height + 1, depth, np.arange(len(row)))] = row
        if depth:
            raw, step = row.tobytes(), DIGEST << ARITY_BITS
            up = b"".join(joined(raw[k:k + step]) for k in range(0, len(raw), step))
            row = np.frombuffer(up, np.uint8).reshape(-1, DIGEST)
    return nodes.tobytes()


def paths_in(nodes: bytes, n: int, height: int, wanted) -> list[bytes]:
    """Proof steps inside a block for its leaves ``wanted``, leaf level first."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    out = [b""] * len(wanted)
    for depth in range(height, 0, -1):
        up = ARITY_BITS * (height - depth)
        count = -(-n // (1 << up))
        runs: dict[int, bytes] = {}
        for k, leaf in enumerate(wanted):
            node = leaf >> up
            run = node >> ARITY_BITS
            if run not in runs:
                first = run << ARITY_BITS
                runs[run] = table[address(height + 1, depth, np.arange(first, min(count, first + (1 << ARITY_BITS))))].tobytes()
            raw, j = runs[run], node - (run << ARITY_BITS)
            out[k] += bytes((len(raw) // DIGEST, j)) + raw[:j * DIGEST] + raw[(j + 1) * DIGEST:]
    return out


def steps(path: bytes):
    """(own place, digests of the others) of every level of a proof."""
    at = 0
    while at < len(path):
        end = at + 2 + (path[at] - 1) * DIGEST
        yield path[at + 1], path[at + 2:end]
        at = end


def fold(leaf: bytes, path: bytes) -> bytes:
    """Root that a leaf and its proof lead to."""
    for j, others in steps(path):
        leaf = joined(others[:j * DIGEST] + leaf + others[j * DIGEST:])
    return leaf


class Manifest(NamedTuple):
    """``leaves``: grp, id, pos, n (leaves of the group), leaf and the carried
    columns; ``tiers``: blocks (grp, block, n, height, nodes) of the groups'
    trees, leaves first; ``top``: blocks of the tree over the groups' roots."""
    leaves: DataFrame
    tiers: list[DataFrame]
    top: list[DataFrame]
    height: int


def leaf_hash(*fields: Column) -> Column:
    """Leaf of a row: digest (binary) of its fields."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their number within ``grp`` by ``order``, and the
    group's size ``n``, both from ranges that are written once."""
    keys = ["grp", *order]
    # Equal rows may be a large part of all: chance deals them to several ranges.
    dealt = (rows.withColumn("_tie", F.rand(11)).repartitionByRange(partitions(rows.sparkSession), *keys, "_tie")
             .sortWithinPartitions(*keys, "_tie").drop("_tie")
             .withColumn("_part", F.spark_partition_id())
             .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    dealt = stash(dealt, name)
    parts = dealt.groupBy("grp", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    w = Window.partitionBy("grp")
    before = F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("grp", "_part", F.sum("_rows").over(w).alias("n"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return (dealt.join(small(stash(parts, name + "-ranges"), OFFSET_ROWS), ["grp", "_part"])
            .withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks of one tier: ``nodes`` has grp, n, pos, digest."""
    bits = ARITY_BITS * height

    def build(batches):
        for b in batches:
            made = []
            ns = b.column("n").to_pylist()
            for n, block, cell in zip(ns, b.column("block").to_pylist(), b.column("cells")):
                leaves = np.frombuffer(b"".join(cell.values.field("digest").to_pylist()), np.uint8).reshape(-1, DIGEST)
                h = height if n > 1 << bits else height_of(n, height)
                made.append((len(leaves), h, lay_out(leaves, h)))
            yield pa.RecordBatch.from_arrays(
                [b.column("grp"), b.column("n"), b.column("block"), *(pa.array([m[k] for m in made], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.binary())))],
                names=["grp", "n", "block", "size", "height", "nodes"])

    # At most 8^height nodes of distinct places meet in a block.
    cells = (nodes.groupBy("grp", "n", F.shiftright("pos", bits).alias("block"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("cells")))
    return cells.mapInArrow(build, "grp string, n long, block long, size int, height int, nodes binary")


def forest(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Tiers of blocks over ``nodes`` (grp, n, pos, digest), written tables."""
    tiers, full = [], 1 << ARITY_BITS * height
    while True:
        blocks = stash(_blocks(nodes, height), f"{name}-{len(tiers)}")
        tiers.append(blocks)
        if blocks.where(F.col("n") > full).isEmpty():
            return tiers
        nodes = (blocks.where(F.col("n") > full)
                 .select("grp", F.ceil(F.col("n") / full).cast("long").alias("n"), F.col("block").alias("pos"), F.substring("nodes", 1, DIGEST).alias("digest")))


def roots(tiers: list[DataFrame], height: int) -> DataFrame:
    """(grp, digest): the root of every tree."""
    full = 1 << ARITY_BITS * height
    out = None
    for t in tiers:
        r = t.where(F.col("n") <= full).select("grp", F.substring("nodes", 1, DIGEST).alias("digest"))
        out = r if out is None else out.unionByName(r)
    return out


def manifest(df: DataFrame, group: str, id_col: str, fields: list[str], carry: dict[str, Column] | None = None,
             height: int = HEIGHT) -> Manifest:
    """Manifest of ``df``: a tree per value of ``group`` over the leaves in
    order of ``id_col``, and a tree over their roots. ``carry`` names columns
    to keep beside the leaves (short ones: they are shuffled)."""
    ship_package(df.sparkSession)
    g = F.col(group).cast("string")
    # A null group sorts first and differs from the empty text.
    rows = df.select(F.when(g.isNull(), "").otherwise(F.concat(F.lit("="), g)).alias("grp"), F.col(id_col).alias("id"),
                     leaf_hash(*(F.col(f) for f in fields)).alias("leaf"), *(c.alias(k) for k, c in (carry or {}).items()))
    leaves = numbered(stash(rows, "leaves"), "numbered-leaves", "id", "leaf")
    tiers = forest(leaves.select("grp", "n", "pos", F.col("leaf").alias("digest")), height, "blocks")
    tops = roots(tiers, height).select(F.lit("").alias("grp"), F.col("grp").alias("group"), "digest")
    tops = numbered(tops, "group-roots", "group")
    top = forest(tops.select("grp", "n", "pos", "digest"), height, "top-blocks")
    return Manifest(leaves, tiers, top, height)


def _descend(blocks: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Proof of every leaf of ``blocks``, given those of the blocks (grp,
    block, path, subroot, root): rows (grp, pos, path, subroot, root)."""
    bits = ARITY_BITS * height

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                found = paths_in(r["nodes"], r["size"], r["height"], range(r["size"]))
                yield pa.RecordBatch.from_pydict({
                    "grp": pa.array([r["grp"]] * len(found), pa.string()), "pos": pa.array([(r["block"] << bits) + k for k in range(len(found))], pa.int64()),
                    "path": pa.array([f + r["path"] for f in found], pa.binary()), "subroot": pa.array([r["subroot"]] * len(found), pa.binary()),
                    "root": pa.array([r["root"]] * len(found), pa.binary())})

    met = blocks.join(above, ["grp", "block"]).select("grp", "block", "size", "height", "nodes", "path", "subroot", "root")
    return met.mapInArrow(run, "grp string, pos long, path binary, subroot binary, root binary")


def block_paths(m: Manifest) -> DataFrame:
    """Proof of every lowest block's root: (grp, block, path, subroot, root)."""
    full = 1 << ARITY_BITS * m.height
    # From the root of the table down to the groups' roots ...
    above = (m.top[-1].select("grp", "block", F.lit(b"").alias("path"), F.lit(b"").alias("subroot"), F.substring("nodes", 1, DIGEST).alias("root")))
    for blocks in reversed(m.top):
        above = stash(_descend(blocks, above, m.height), "group-paths").withColumnRenamed("pos", "block")
    ordered = numbered(roots(m.tiers, m.height).select(F.lit("").alias("grp"), F.col("grp").alias("group"), F.col("digest")), "group-order", "group")
    groups = (ordered.join(above.select("grp", F.col("block").alias("pos"), "path", "root"), ["grp", "pos"])
              .select(F.col("group").alias("grp"), "path", F.col("digest").alias("subroot"), "root"))
    groups = stash(groups, "groups")
    # ... and on to the blocks of each tier; a group joins in where its tree ends.
    below = None
    for blocks in reversed(m.tiers):
        at = blocks.where(F.col("n") <= full).join(groups, "grp").select("grp", "block", "path", "subroot", "root")
        above = at if below is None else at.unionByName(below)
        if blocks is m.tiers[0]:
            return above
        below = stash(_descend(blocks, above, m.height), "block-paths").withColumnRenamed("pos", "block")


def proofs(m: Manifest, presented: Column, keep: list[str]) -> DataFrame:
    """For every leaf the manifest's values and what ``presented`` (a digest
    over the columns of ``leaves``; null: none) leads to: ``keep``, leaf,
    subroot, root, proof (digest of all siblings as hex text, in the proof's
    order), folded (from the presented leaf, else the stored one) as hex, and
    ``verified``."""
    bits = ARITY_BITS * m.height
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in m.leaves.select(*keep).schema)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {k: b.column(k)[i].as_py() for k in ("block", "size", "height", "nodes", "path", "subroot", "root")}
                cells = b.column("cells")[i].values
                own, shown = cells.field("leaf").to_pylist(), cells.field("shown").to_pylist()
                first = r["block"] << bits
                inner = paths_in(r["nodes"], r["size"], r["height"], [p - first for p in cells.field("pos").to_pylist()])
                outer = b"".join(s for _, s in steps(r["path"])).hex().encode()
                proof, folded = [], []
                for path, a, t in zip(inner, own, shown):
                    h = hashlib.sha256(b"".join(s for _, s in steps(path)).hex().encode())
                    h.update(outer)
                    proof.append(h.hexdigest())
                    folded.append(fold(t if t is not None else a, path + r["path"]))
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [*(cells.field(k) for k in keep), pa.array([x.hex() for x in own]), pa.array([r["subroot"].hex()] * n), pa.array([r["root"].hex()] * n),
                     pa.array(proof), pa.array([x.hex() for x in folded]), pa.array([x == r["root"] for x in folded], pa.bool_())],
                    names=[*keep, "leaf", "subroot", "root", "proof", "folded", "verified"])

    asked = (m.leaves.select("grp", F.shiftright("pos", bits).alias("block"), F.struct("pos", "leaf", presented.alias("shown"), *keep).alias("cell"))
             .groupBy("grp", "block").agg(F.collect_list("cell").alias("cells")))
    met = (asked.join(m.tiers[0].select("grp", "block", "size", "height", "nodes"), ["grp", "block"])
           .join(block_paths(m), ["grp", "block"]))
    return met.mapInArrow(run, schema + "leaf string, subroot string, root string, proof string, folded string, verified boolean")


def save(m: Manifest, path: str) -> None:
    """Write a manifest's tables below ``path``."""
    m.leaves.write.parquet(f"{path}/leaves")
    for name, tables in (("tier", m.tiers), ("top", m.top)):
        for k, t in enumerate(tables):
            t.write.parquet(f"{path}/blocks/tree={name}/level={k}")


def load(spark: SparkSession, path: str, height: int = HEIGHT) -> Manifest:
    """A manifest that ``save`` wrote."""
    blocks = spark.read.parquet(f"{path}/blocks")
    found = sorted((r["tree"], r["level"]) for r in blocks.select("tree", "level").distinct().collect())
    tables = {name: [blocks.where((F.col("tree") == name) & (F.col("level") == k)).drop("tree", "level") for t, k in found if t == name]
              for name in ("tier", "top")}
    return Manifest(spark.read.parquet(f"{path}/leaves"), tables["tier"], tables["top"], height)
