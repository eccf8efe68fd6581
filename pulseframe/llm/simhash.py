"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint of a text: words are runs of bytes other than white space (0x20,
0x09-0x0D), A-Z lower-cased; the 64-bit XXH64 (seed 42) of every shingle of
three words, repeats included, joined by one space (fewer words: the whole
sequence; no words: fingerprint zero). A bit is set if it is set in over half of
the hashes. Fingerprints link at ``distance`` or fewer differing bits.

1. Equal fingerprints are one row from the start.
2. Bits are ordered so that correlated ones share an octet (greedily, from the
   counts of all pairs of bits), and the octets are dealt to partitions.
3. Every fingerprint allots its own thresholds t_i >= -1 to the partitions with
   sum(t_i + 1) = distance + 1, so that any linked fingerprint differs from it
   by at most t_i bits in some partition. Dynamic programming takes the cheapest
   allotment: signatures to probe plus estimated candidates (convolved distances
   within octets, and exact counts of crowded values). The number of partitions
   is the one with the least cost for a sample of the fingerprints; thresholds
   and partitions decide cost only, never the result.
4. Probes meet the fingerprints by (partition, value); candidates are verified
   on all bits.
5. A value held by more than ``CROWD`` fingerprints would make pairs
   without bound. Those who meet there are linked through their surroundings
   instead: all fingerprints within one bit of any 64-bit value are within two
   bits of each other, and those within one bit of it are within three of those
   within two. At most 65 and 2081 fingerprints can meet so, whatever the input.
6. Links are merged to components.

Defined cases: null text counts as empty; a row without id belongs to a
component but doesn't name it (the component of rows that all lack ids is
null); an empty table gives an empty result; repeated rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.tables import components, discard, small, stash, text_or_empty
from pulseframe.session import ship_package

WORDS = 3
SEED = 42
DISTANCE = 3
CROWD = 64              # fingerprints of one partition value that are paired
COSTED = 2_000          # fingerprints whose costs choose the number of partitions
PARTITIONS = (8, 4, 2)  # choices, in octets of bits
PROBE_COST = 2.0        # a probed signature against a verified candidate
CROWDED_VALUES = 1_000_000  # crowded values sent to the executors at most
OCTETS = 8

# One byte lane for each bit of a byte, for counting up to 255 hashes at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of a text, in order."""
    from xxhash import xxh64_intdigest
    found = text.encode("utf-8").lower().split()
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), SEED)] if found else [], np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    cuts = zip(first[:len(found) - words + 1].tolist(), ends[words - 1:].tolist())
    return np.array([xxh64_intdigest(line[i:j], SEED) for i, j in cuts], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes (unsigned)."""
    if not len(hashes):
        return 0
    lanes = _LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(lanes), 255 * 16):
        part = lanes[k:k + 255 * 16]
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)
        counts += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed long."""
    ship_package(df.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py())) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """0/1 per bit, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pair_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set (64 x 64)."""
    def count(batches):
        acc, n = np.zeros((64, 64), np.int64), 0
        for b in batches:
            x = bits_of(b.column("fp").to_numpy(zero_copy_only=False))
            for k in range(0, len(x), 1 << 16):
                y = x[k:k + (1 << 16)].astype(np.float32)  # exact below 2^24
                acc += (y.T @ y).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(4097), pa.int32()), "n": pa.array([*acc.ravel().tolist(), n], pa.int64())})

    total = {r["cell"]: r["n"] for r in fps.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return total.get(4096, 0), np.array([total.get(k, 0) for k in range(4096)]).reshape(64, 64)


def bit_order(n: int, both: np.ndarray) -> list[int]:
    """Bits in octets of correlated ones: the free bit with the strongest ties
    starts an octet, those tied closest to it on average follow."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        tie = np.abs(np.nan_to_num((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)))
    np.fill_diagonal(tie, 0)
    free, out = list(range(64)), []
    while free:
        octet = [max(free, key=lambda i: (tie[i, free].sum(), -i))]
        free.remove(octet[0])
        while len(octet) < OCTETS:
            octet.append(max(free, key=lambda i: (tie[i, octet].mean(), -i)))
            free.remove(octet[-1])
        out += octet
    return out


def permuted(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with bit ``order[k]`` at place k."""
    return np.ascontiguousarray(np.packbits(bits_of(fps)[:, order], axis=1, bitorder="little")).view("<i8").ravel()


def octet_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints (permuted) hold each value of each octet."""
    cells = F.explode(F.array(*(F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255) + 256 * k for k in range(OCTETS)))).alias("cell")
    out = np.zeros(256 * OCTETS)
    for r in fps.select(cells).groupBy("cell").count().collect():
        out[r["cell"]] = r["count"]
    return out.reshape(OCTETS, 256)


def _reordered(df: DataFrame, order: list[int]) -> DataFrame:
    """``df`` (columns of fingerprints) with ``permuted`` columns."""
    names = df.columns

    def turn(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(permuted(b.column(c).to_numpy(zero_copy_only=False), order)) for c in names], names=names)

    return df.mapInArrow(turn, ", ".join(f"{c} long" for c in names))


class Costs:
    """Estimated candidates within 0..distance bits of a fingerprint's value in
    each of ``m`` partitions, and the allotment of least cost."""

    def __init__(self, m: int, octets: np.ndarray, distance: int):
        self.m, self.distance, self.width = m, distance, 64 // m
        self.total = octets[0].sum()
        apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        # Share of the fingerprints at each distance from each value of an octet.
        self.near = np.stack([np.stack([(apart == d) @ o for d in range(distance + 1)], axis=1) for o in octets]) / max(self.total, 1)
        flips = [0, *(1 << k for k in range(self.width))]
        masks = [np.array([0], np.uint64)]
        for _ in range(distance):
            masks.append(np.unique(np.bitwise_xor.outer(masks[-1], np.array(flips, np.uint64))))
        self.masks = masks

    def values(self, fps: np.ndarray) -> np.ndarray:
        shift = (np.arange(self.m) * self.width).astype(np.uint64)
        return (fps.view(np.uint64)[:, None] >> shift) & np.uint64((1 << self.width) - 1)

    def candidates(self, fps: np.ndarray, crowds: np.ndarray) -> np.ndarray:
        """(fingerprint, partition, threshold) -> candidates; ``crowds`` are the
        exact counts of crowded values, else 0."""
        octet = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, OCTETS)
        out = np.empty((len(fps), self.m, self.distance + 1))
        per = OCTETS // self.m
        for i in range(self.m):
            share = self.near[i * per][octet[:, i * per]]
            for k in range(i * per + 1, (i + 1) * per):
                more = self.near[k][octet[:, k]]
                share = np.stack([sum(share[:, a] * more[:, d - a] for a in range(d + 1)) for d in range(self.distance + 1)], axis=1)
            out[:, i] = np.maximum(np.cumsum(share, axis=1) * self.total, crowds[:, i:i + 1])
        return out

    def allot(self, fps: np.ndarray, crowds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds (-1: not probed) of every partition, and their cost."""
        probes = np.array([len(x) for x in self.masks]) * PROBE_COST
        cost = self.candidates(fps, crowds) + probes
        units = self.distance + 1
        best = np.full((len(fps), units + 1), np.inf)
        best[:, 0] = 0
        chosen = np.zeros((self.m, len(fps), units + 1), np.int8)
        for i in range(self.m):
            options = np.full((units + 1, len(fps), units + 1), np.inf)
            options[0] = best
            for u in range(1, units + 1):
                options[u][:, u:] = best[:, :units + 1 - u] + cost[:, i, u - 1:u]
            chosen[i] = options.argmin(axis=0)
            best = options.min(axis=0)
        left, out = np.full(len(fps), units), np.empty((len(fps), self.m), np.int8)
        for i in reversed(range(self.m)):
            out[:, i] = chosen[i][np.arange(len(fps)), left]
            left = left - out[:, i]
        return out - 1, best[:, units]


def surroundings(fps: DataFrame, bits: int, tag: str) -> DataFrame:
    """(z, fp, tag): every value within ``bits`` of each fingerprint."""
    singles = np.array([0, *(1 << k for k in range(64))], np.uint64)
    masks = np.array([0], np.uint64)
    for _ in range(bits):
        masks = np.unique(np.bitwise_xor.outer(masks, singles))

    def run(batches):
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(x), 256):
                part = x[k:k + 256]
                z = (part.view(np.uint64)[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.repeat(part, len(masks)))], names=["z", "fp"])

    return fps.select("fp").mapInArrow(run, "z long, fp long").withColumn(tag, F.lit(True))


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the distinct ``fp`` of a written table that give the
    same components as all pairs at ``distance`` (3 at most) or fewer bits."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    n, both = pair_counts(fps)
    order = bit_order(n, both)

    turned = stash(_reordered(fps.select("fp"), order), "turned")
    octets = octet_counts(turned)
    sample = np.array([r["fp"] for r in turned.orderBy(F.xxhash64("fp")).limit(COSTED).select("fp").collect()], np.int64)
    costs = min((Costs(m, octets, distance) for m in PARTITIONS), key=lambda c: c.allot(sample, np.zeros((len(sample), c.m)))[1].sum())
    m, width = costs.m, costs.width

    values = [F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1) for i in range(m)]
    index = turned.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)))).alias("s"), "fp").select("s.i", "s.v", "fp")
    crowded = stash(index.groupBy("i", "v").agg(F.count("*").alias("crowd")).where(F.col("crowd") > crowd), "crowded")
    few = small(crowded, CROWDED_VALUES)
    own = turned.select("fp", *(v.alias(f"v{i}") for i, v in enumerate(values)))
    for i in range(m):
        own = own.join(few.where(F.col("i") == i).select(F.col("v").alias(f"v{i}"), F.col("crowd").alias(f"c{i}")), f"v{i}", "left")

    def probe(batches):
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                s = b.slice(k, 4096)
                x = s.column("fp").to_numpy(zero_copy_only=False)
                crowds = np.stack([s.column(f"c{i}").fill_null(0).to_numpy(zero_copy_only=False) for i in range(m)], axis=1)
                t, _ = costs.allot(x, crowds)
                v = costs.values(x)
                for i in range(m):
                    for d in range(distance + 1):
                        at = np.flatnonzero(t[:, i] == d)
                        masks = costs.masks[d]
                        for a in range(0, len(at), max(1, 65536 // len(masks))):
                            rows = at[a:a + max(1, 65536 // len(masks))]
                            z = (v[rows, i][:, None] ^ masks[None, :]).ravel().view(np.int64)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(z), i, np.int32)), pa.array(z), pa.array(np.repeat(x[rows], len(masks)))], names=["i", "v", "fp"])

    probes = own.select("fp", *(f"c{i}" for i in range(m))).mapInArrow(probe, "i int, v long, fp long")
    probes = stash(probes.join(few, ["i", "v"], "left"), "probes")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    # Each finds all its links; the smaller end of a pair reports it.
    pairs = (probes.where("crowd is null").join(index.select("i", "v", F.col("fp").alias("other")), ["i", "v"])
             .where((F.col("fp") < F.col("other")) & (apart <= distance)).select(F.col("fp").alias("a"), F.col("other").alias("b")))
    found = pairs
    met = probes.where("crowd is not null").select("i", "v", "fp")
    if not met.isEmpty():
        members = index.join(few, ["i", "v"], "left_semi").select("i", "v", "fp")
        met = stash(met.unionByName(members).distinct(), "met")
        found = stash(pairs, "pairs").unionByName(_crowd_links(met, distance))
    out = stash(found.distinct(), "links")
    discard(turned, crowded, probes)
    return _reordered(out, np.argsort(order).tolist())


def _crowd_links(met: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) among those who meet at a crowded value (i, v, fp)."""
    all_met = stash(met.select("fp").distinct(), "crowd")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))

    def star(rows: DataFrame, lead) -> DataFrame:
        """Each value's least leader with the others there (2081 at most)."""
        seen = rows.groupBy("z").agg(lead, F.collect_set("fp").alias("all")).where("lead is not null and size(all) > 1")
        return (seen.select(F.col("lead").alias("a"), F.explode("all").alias("b")).where("a <> b").where(apart <= distance)
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    if distance < 2:
        rows = surroundings(all_met, distance, "near")
        keyed = rows.groupBy("z").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
        one = keyed.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b").where(apart <= distance)
        return one.distinct()
    first = stash(star(surroundings(all_met, 1, "near"), F.min("fp").alias("lead")), "two-apart")
    if distance == 2:
        return first
    # At three bits only who is not yet with the most of a meeting asks further.
    comp = components(first, "crowd-components")
    own = met.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("i", "v", "fp", F.coalesce("component", "fp").alias("comp"))
    sizes = own.groupBy("i", "v", "comp").agg(F.count("*").alias("n"))
    most = sizes.groupBy("i", "v").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    split = stash(own.join(most, ["i", "v"]).groupBy("fp").agg(F.max(F.col("comp") != F.col("most")).alias("asks")), "split")
    near = surroundings(split, 1, "near")
    far = surroundings(split.where("asks"), 2, "far")
    rows = near.unionByName(far, allowMissingColumns=True)
    second = star(rows, F.min(F.when(F.col("near"), F.col("fp"))).alias("lead"))
    return first.unionByName(second)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Rows (id, fp, component_id): fingerprint (signed long) of every text and
    the smallest id reachable by links."""
    docs = stash(fingerprints(df, id_col, text_col), "fingerprints")
    # With equal fingerprints as one row.
    classes = stash(docs.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    edges = links(classes, distance, crowd)
    comp = components(edges, "fingerprint-components")
    named = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = stash(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return docs.join(by_fp, "fp").select("id", "fp", "component_id")
