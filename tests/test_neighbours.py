import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulseframe.operators import models, neighbours
from pulseframe.operators.models import KnnVote, _knn_votes
from pulseframe.operators.neighbours import NeighbourIndex, exact_nearest, recall


def table(spark, x, y=None):
    y = np.zeros(len(x), int) if y is None else y
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int")


def brute(q, x, k):
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return [np.lexsort((np.arange(len(x)), row))[:k].tolist() for row in d]


def test_exact_search_with_ties_and_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (300, 2)).astype(float)  # many equal rows and distances
    df = table(spark, x)
    got = {r["id"]: r["r"] for r in exact_nearest(df.select("id", "x"), df, 7, block_rows=90).collect()}
    assert [got[i] for i in range(300)] == brute(x, x, 7)


def test_one_leaf_is_exact(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 3, (200, 2)), np.ones((100, 2))]).astype(float)
    df = table(spark, x)
    got = {r["id"]: r["r"] for r in NeighbourIndex(2, 5, trees=2, block_rows=4).fit(df).nearest(df.select("id", "x")).collect()}
    assert [got[i] for i in range(300)] == brute(x, x, 5)


def test_recall_over_many_leaves(spark):
    rng = np.random.default_rng(2)
    clusters = np.repeat(rng.normal(size=(40, 16)), 100, axis=0) + 0.05 * rng.normal(size=(4000, 16))
    hot = np.repeat(clusters[:1], 2000, axis=0)  # a third of all rows share one vector
    df = table(spark, np.concatenate([clusters, hot]))
    asked = df.where("id % 20 = 0").select("id", "x")
    index = NeighbourIndex(16, 5, leaf_rows=64, block_rows=100).fit(df)
    assert len(index.cuts) >= 1 and index.leaves.where("tree = 0").agg(F.sum(F.size("own"))).first()[0] <= 4005
    largest = index.sizes.agg(F.max("points")).first()[0]
    assert largest <= 4 * 64
    found = index.nearest(asked)
    r = recall(found, exact_nearest(asked, df, 5)).first()
    assert r["queries"] == asked.count() and r["recall"] >= 0.9
    # Every row has its nearest ones in order, whatever leaf it fell into.
    assert all(x["d"] == sorted(x["d"]) and len(x["d"]) == 5 for x in found.collect())


def test_several_rounds_of_cuts(spark):
    rng = np.random.default_rng(3)
    df = table(spark, rng.normal(size=(1500, 2)))
    index = NeighbourIndex(2, 3, trees=4, leaf_rows=4).fit(df)
    assert len(index.cuts) >= 2
    assert index.leaves.groupBy("tree").count().where("count <> 1500").isEmpty()
    asked = df.where("id % 20 = 0").select("id", "x")
    assert recall(index.nearest(asked), exact_nearest(asked, df, 3)).first()["recall"] > 0.6  # four rows a leaf


def test_empty_and_unseen(spark):
    none = table(spark, np.zeros((0, 2)))
    asked = table(spark, np.ones((2, 2))).select("id", "x")
    assert [r["d"] for r in NeighbourIndex(2, 3).fit(none).nearest(asked).collect()] == [[], []]
    assert NeighbourIndex(2, 3).fit(table(spark, np.ones((3, 2)))).nearest(none.select("id", "x")).count() == 0


def test_vote_by_index_and_exactly(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int")
    q = df.where("id >= 800").drop("label")
    want = _knn_votes(x[800:], x[:800], y[:800], [7])[7].tolist()
    train = df.where("id < 800")
    near = {e: {r["id"]: r["p_knn"] for r in KnnVote(["a", "b", "c"], "label", ks=[7], max_reference=10, exact=e).fit(train, "id").transform(q).collect()}
            for e in (True, False)}
    assert [near[True][i] for i in range(800, 900)] == want
    assert np.mean([near[False][i] == w for i, w in zip(range(800, 900), want)]) >= 0.95


def test_boxes_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(3)
    kinds = (lambda n: rng.integers(0, 40, (n, 3)).astype(float), lambda n: rng.normal(size=(n, 3)) * [1, 100, 1e4],
             lambda n: rng.integers(0, 2, (n, 3)).astype(float), lambda n: np.zeros((n, 2)))
    for made in kinds:
        r, x = made(3000), made(300)
        boxes = models._boxes(r)
        near = np.full((len(x), 7), -1)
        for own, found, _ in models._nearest_in_boxes(x, r, 7, boxes):
            near[own] = found
        want = np.concatenate([found for _, found, _ in models._nearest(x, r, 7)])
        # Ties go to the smaller place; whole numbers have exact distances.
        d = lambda at: ((x[:, None, :] - r[at]) ** 2).sum(axis=2)
        assert np.allclose(d(near), d(want)) and (near >= 0).all()
        if (r == np.round(r)).all():
            assert (near == want).all()
    # Far reference rows are left out where the rows are spread.
    r = rng.normal(size=(20_000, 3))
    met = []
    plain, models._nearest = models._nearest, lambda x, r, *more: (met.append(len(x) * len(r)), plain(x, r, *more))[1]
    try:
        models._knn_votes(rng.normal(size=(2000, 3)), r, rng.integers(0, 2, 20_000), [5])
    finally:
        models._nearest = plain
    assert sum(met) < 0.6 * 2000 * 20_000


def test_blocks_that_meet_leave_far_rows_out():
    rng = np.random.default_rng(4)
    r, x = rng.integers(0, 60, (4000, 3)).astype(float), rng.integers(0, 60, (1000, 3)).astype(float)
    right = pd.DataFrame({"x": list(r), "own": [[{"id": i, "y": i % 3}] for i in range(len(r))]})
    met = []
    plain, neighbours._least = neighbours._least, lambda d, k: (met.append(d.size), plain(d, k))[1]
    try:
        out = neighbours._meet(pd.DataFrame({"pid": range(len(x)), "x": list(x)}), right, 5)
    finally:
        neighbours._least = plain
    d = ((x[:, None, :] - r[None, :, :]) ** 2).sum(axis=2)
    want = {i: [(d[i, j], j, j % 3) for j in np.argsort(d[i], kind="stable")[:5]] for i in range(len(x))}
    assert dict(zip(out["pid"], out["near"])) == want
    assert sum(met) < 0.8 * d.size


def test_block_search_by_arrays_is_exact():
    import pyarrow as pa
    rng = np.random.default_rng(6)
    for x, r in ((rng.normal(size=(50, 16)), rng.normal(size=(700, 16))), (rng.integers(0, 4, (60, 3)) * 1.0, rng.integers(0, 4, (600, 3)) * 1.0),
                 (rng.normal(size=(9, 2)), rng.normal(size=(3, 2))), (np.full((4, 2), np.inf), rng.normal(size=(300, 2))),
                 (1e8 + rng.normal(size=(20, 2)), 1e8 + rng.normal(size=(900, 2)))):
        ids = rng.permutation(3 * len(r)).reshape(-1, 3)
        own = [[{"id": int(v), "y": int(v % 5)} for v in sorted(o[:1 + i % 3])] for i, o in enumerate(ids)]
        want = {}
        for i, v in enumerate(x):
            with np.errstate(invalid="ignore"):
                d = ((v - r) ** 2).sum(axis=1)
            want[i] = sorted((d[j], m["id"], m["y"]) for j, o in enumerate(own) for m in o)[:7]
        q = pa.table({"pid": pa.array(range(len(x)), pa.int64()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})
        b = pa.table({"x": pa.array(r.tolist(), pa.list_(pa.float64())), "own": pa.array(own, pa.list_(pa.struct([("id", pa.int64()), ("y", pa.int32())])))})
        out = neighbours._meet_tables(q, b, 7)
        got = {p: [(e["d"], e["r"], e["y"]) for e in near] for p, near in zip(out["pid"].to_pylist(), out["near"].to_pylist())}
        assert got == want
        assert neighbours._meet_tables(q, b.slice(0, 0), 7).num_rows == 0 and neighbours._meet_tables(q.slice(0, 0), b, 7).num_rows == 0
    # No row of a block costs a loop of its own.
    calls = []
    plain, neighbours._least = neighbours._least, lambda d, k: (calls.append(len(d)), plain(d, k))[1]
    try:
        x, r = rng.normal(size=(400, 16)), rng.normal(size=(500, 16))
        neighbours._met(x, r, np.ones(500, int), np.arange(500), np.arange(500), 7)
    finally:
        neighbours._least = plain
    assert sum(calls) < 410 and len(calls) < 20


def test_vote_is_the_same_however_many_rows_are_the_reference(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1200, 12)), np.repeat(rng.normal(size=(1, 12)), 60, axis=0)])
    y = rng.integers(0, 3, len(x))
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{c} double" for c in cols) + ", label int")
    train, q = df.where("id % 5 > 0"), df.where("id % 5 = 0").drop("label")
    # With the index (the rule beyond max_reference before) some of these votes differ.
    votes = []
    for most, rows in ((100_000, 20_000), (0, 200)):
        m = KnnVote(cols, "label").fit(train, "id") if rows == 20_000 else KnnVote(cols, "label", max_reference=most, block_rows=rows).fit(train, "id")
        votes.append((m.k, {r["id"]: r["p_knn"] for r in m.transform(q).collect()}))
    assert votes[0] == votes[1] and len(votes[0][1]) == q.count()


def test_cells_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(9)
    far = np.concatenate([rng.normal(size=(500, 3)) * [1, 1e3, 10], rng.integers(0, 3, (400, 3)) * 1.0, np.full((3, 3), np.nan), np.full((2, 3), np.inf)])
    df = table(spark, far)
    got = {r["id"]: r["r"] for r in exact_nearest(df.select("id", "x"), df, 5, block_rows=60).collect()}
    with np.errstate(invalid="ignore"):
        want = brute(far, far, 5)
    assert [got[i] for i in range(len(far))] == want


def test_far_cells_are_not_met(spark):
    rng = np.random.default_rng(10)
    df = table(spark, rng.normal(size=(4000, 2)))
    parts = neighbours.exact_parts(df.selectExpr("id AS pid", "0 AS part", "x", "0 AS t"), df.selectExpr("0 AS part", "id", "x", "y"), 3, block_rows=200)
    assert parts.where("done").count() > 2000 and parts.count() < 3 * 4000  # of 20 cells


def test_block_search_leaves_points_out():
    rng = np.random.default_rng(11)
    for x, r in ((rng.normal(size=(300, 3)), rng.normal(size=(4000, 3))), (rng.integers(0, 5, (300, 3)) * 1.0, rng.integers(0, 5, (4000, 3)) * 1.0)):
        row, at, d = neighbours._nearest_points(x, r, 6)
        all_d = ((x[:, None, :] - r[None, :, :]) ** 2).sum(axis=2)
        assert at.reshape(-1, 6).tolist() == np.argsort(all_d, axis=1, kind="stable")[:, :6].tolist() and (row == np.repeat(np.arange(300), 6)).all()
        bound = np.sort(all_d, axis=1)[:, 2]
        row, at, d = neighbours._nearest_points(x, r, 6, bound)
        assert {(i, j) for i, j, v in zip(row, at, d) if v <= bound[i]} >= {(i, j) for i in range(300) for j in np.argsort(all_d[i], kind="stable")[:3]}
