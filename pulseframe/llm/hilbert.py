"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors form one point. Every point is projected to ``dims`` directions
(a seeded orthonormal set for each curve), each coordinate is squashed to
(0, 1) and shifted by a random offset, and the cell's Hilbert number is its key
on that curve. Points are range-partitioned by (curve, key), which gives them
a rank on each curve. A query looks at the ``window`` ranks on both sides on
every curve: points and queries meet in blocks of 2 ``window`` ranks, exact
cosines are taken there, and the lists of all curves merge to the nearest.

The window follows the number of points (``window_for``), since a fixed one
sees an ever smaller share of the neighbours; the work of a query grows with it.
Cells are as fine as single precision, so that near copies have an order of
their own on every curve. A block is bounded by the window; equal points, also a
third of all rows, are one point with its least ids. Recall grows with curves
and window and was measured against brute force (README).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do vectors of another dimension than the most
common one; ties go to the smaller id; a row whose id is null takes no part;
of repeated rows (id and vector) one counts; fewer candidates than ``k`` give
fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm.tables import discard, ranged, small, stash
from pulseframe.session import ship_package

CURVES = 32
DIMS = 10
BITS = 24
WINDOW = 640           # up to WINDOW_POINTS points
WINDOW_POINTS = 50_000
WINDOW_POWER = 0.8
SEED = 11


def window_for(points: int) -> int:
    """Ranks looked at on both sides for recall@5 of 0.9 (README)."""
    return math.ceil(WINDOW * max(1.0, points / WINDOW_POINTS) ** WINDOW_POWER)


def _transposed(cells: np.ndarray, bits: int) -> np.ndarray:
    """The transpose form of Hilbert numbers: undo excess work from the top
    bit, Gray-decode."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, 0) ^ swap
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= t
    return x


def _interleaved(x: np.ndarray, high: int, low: int) -> np.ndarray:
    key = np.zeros_like(x[0])
    for b in range(high - 1, low - 1, -1):
        for i in range(len(x)):
            key = key << 1 | (x[i] >> b) & 1
    return key


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert number of integer cells (points x dims, below 2^bits)."""
    return _interleaved(_transposed(cells, bits), bits, 0)


def hilbert_bytes(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert numbers of any length, as byte strings of one length that sort
    as the numbers do."""
    x = _transposed(cells, bits)
    step = max(1, 63 // len(x))
    words = [_interleaved(x, b, max(b - step, 0)) for b in range(bits, 0, -step)]
    return np.ascontiguousarray(np.stack(words, axis=1).astype(">u8")).view(f"V{8 * len(words)}").ravel()


def curve_keys(unit: np.ndarray, curves: int, dims: int, bits: int, seed: int = SEED):
    """Keys of unit vectors on each curve."""
    rng = np.random.default_rng(seed)
    d = unit.shape[1]
    dims = min(dims, d)
    for _ in range(curves):
        axes = np.linalg.qr(rng.normal(size=(d, dims)))[0]
        shift = rng.random(dims)
        # A projection of a unit vector is near normal with variance 1/d.
        u = 1 / (1 + np.exp(-1.702 * np.sqrt(d) * (unit @ axes)))
        yield hilbert_bytes(np.minimum(((u + shift) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row and ``q`` in double precision; a row's value doesn't
    depend on the other rows, so equal vectors get equal values."""
    rows, q = _near_one(rows), _near_one(q[None])[0]
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def _near_one(v: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component below 1:
    no square overflows or vanishes, and no digit changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v: array<double>) of the vectors that take part."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null")
    good = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    v = v.where(F.coalesce(good, F.lit(False)))
    common = v.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    # -0.0 and 0.0 are one value.
    return v.where(F.size("v") == (common or 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): up to ``k`` nearest rows of each query row
    other than itself; ``is_query`` is a condition on ``id``. Without ``window``
    it follows the number of points."""
    spark = df.sparkSession
    ship_package(spark)
    rows = valid_vectors(df, id_col, vec_col).dropDuplicates(["id", "v"])
    by = Window.partitionBy("v").orderBy("id")
    least = rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    point = rows.groupBy("v").agg(F.min("id").alias("p"), F.max(is_query).alias("asks"))
    points = stash(point.select("p", "asks", "v"), "points")
    window = window or window_for(points.count())
    members = stash(least.join(points.select("p", "v"), "v").select("p", "id"), "members")

    def key_rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
            scaled = v / np.abs(v).max(axis=1, keepdims=True)
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            for c, key in enumerate(curve_keys(unit, curves, dims, bits)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.Array.from_buffers(pa.binary(key.itemsize), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary()), b.column("p"), b.column("asks"),
                                                  pa.array([x.tobytes() for x in v], pa.binary())], names=["curve", "key", "p", "asks", "vec"])

    dealt = ranged(points.mapInArrow(key_rows, "curve int, key binary, p long, asks boolean, vec binary"), "curves", "curve", "key", "p")
    counts = dealt.groupBy("part", "curve").count()
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "curve", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part", "curve").orderBy("key", "p")) - 1
    placed = dealt.withColumn("rank", rank).join(small(counts, 100_000), ["part", "curve"])
    placed = placed.withColumn("rank", F.col("rank") + F.col("start"))
    width = 2 * window
    block = lambda c: F.floor(c / width)
    # Every point lies in its block; a query also visits the blocks its window reaches.
    visits = F.when(F.col("asks"), F.array_distinct(F.array(block(F.col("rank")), block(F.greatest(F.col("rank") - window, F.lit(0))), block(F.col("rank") + window))))
    spread = placed.select("curve", "rank", "p", "asks", "vec", block(F.col("rank")).alias("home"),
                           F.explode(F.coalesce(visits, F.array(block(F.col("rank"))))).alias("block"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        own = pdf[pdf["home"] == pdf["block"]]
        mat = np.frombuffer(b"".join(own["vec"]), np.float64).reshape(len(own), -1) if len(own) else None
        ranks, ids, out = own["rank"].to_numpy(), own["p"].to_numpy(), []
        for q in pdf[pdf["asks"]].itertuples() if len(own) else ():
            lo, hi = np.searchsorted(ranks, [q.rank - window, q.rank + window + 1])
            if lo == hi:
                continue
            score = cosines(mat[lo:hi], np.frombuffer(q.vec, np.float64))
            best = np.lexsort((ids[lo:hi], -score))[:k + 1]
            out += [(q.p, int(ids[lo + i]), float(score[i])) for i in best]
        return pd.DataFrame(out, columns=["q", "p", "score"]).astype({"q": "int64", "p": "int64", "score": "float64"})

    found = (spread.groupBy("curve", "block").applyInPandas(search, "q long, p long, score double")
             .groupBy("q", "p").agg(F.max("score").alias("score")))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "p")
    found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")
    near = stash(found.join(members, "p").select("q", "id", "score"), "near")
    asking = rows.where(is_query).join(points.where("asks").select("p", "v"), "v").select(F.col("id").alias("query_id"), F.col("p").alias("q")).distinct()
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = (asking.join(near, "q").where("id <> query_id").withColumn("rank", F.row_number().over(last))
           .where(F.col("rank") <= k).select("query_id", "rank", "id", "score"))
    discard(dealt)
    return out
