"""Scores, clusters, classifiers and metrics on Spark.

Built-in MLlib where it has the model (PCA, KMeans, RandomForest,
LogisticRegression, DecisionTree, CrossValidator); composed from aggregates
where MLlib's definition differs (population-sd scaling, smoothed idf);
Arrow-batched numpy inside ``applyInPandas`` / ``mapInPandas`` only for the
isolation forest and the random-feature map, whose per-row work is vector
math with no SQL form.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.operators.quantiles import exact_quantiles
from pulseframe.session import scratch_path, ship_package


def _with_field(df: DataFrame, name: str, dtype) -> T.StructType:
    """Schema of ``df`` plus one field (a new object: ``df.schema`` is cached)."""
    return T.StructType(list(df.schema.fields) + [T.StructField(name, dtype)])


TASK_ROWS = 20_000  # rows of a task whose Python work is dear


def spread(df: DataFrame, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt to tasks of about ``task_rows`` rows: a file of few megabytes
    is one scan task, however long its rows are worked on. ``rows`` is counted
    where it isn't given."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(1, math.ceil(rows / task_rows)))


# --------------------------------------------------------------------------
# Scaling
# --------------------------------------------------------------------------

class Standardizer:
    """``(x - mean) / population sd`` per column (sd 0 -> divide by 1).
    MLlib's StandardScaler divides by the sample sd, hence this form."""

    def __init__(self, cols):
        self.cols = list(cols)
        self.mean: dict = {}
        self.sd: dict = {}

    def fit(self, df: DataFrame) -> "Standardizer":
        aggs = []
        for c in self.cols:
            aggs += [F.avg(c).alias("m_" + c), F.stddev_pop(c).alias("s_" + c)]
        r = df.agg(*aggs).collect()[0]
        for c in self.cols:
            self.mean[c] = r["m_" + c] or 0.0
            s = r["s_" + c]
            self.sd[c] = s if s not in (None, 0.0) and not math.isnan(s) else 1.0
        return self

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.sd[c])
                               for c in self.cols})


def standardize(df: DataFrame, cols) -> DataFrame:
    """Lazy form: mean and sd come from one scalar subquery."""
    st = df.select(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                              for c in cols]).alias("st")).scalar()
    out = {}
    for c in cols:
        sd = F.when((st[c]["s"].isNull()) | (st[c]["s"] == 0), F.lit(1.0)).otherwise(st[c]["s"])
        out[c] = (F.col(c) - st[c]["m"]) / sd
    return df.withColumns(out)


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


# --------------------------------------------------------------------------
# M5: reconstruction error of a linear autoencoder (PCA)
# --------------------------------------------------------------------------

class PcaError:
    """Mean squared reconstruction error after projecting standardised
    features on the top ``k`` principal components: for centred x,
    ``(|x|^2 - |P^T x|^2) / d``. The covariance is one distributed
    aggregate (MLlib); the d x k projection ships with the model. ``k`` is below
    d: with all components the error would be 0 on every row. (Wide or sparse
    rows: ``svd.TruncatedSvd``.)"""

    def __init__(self, cols, k: int, out: str = "autoencoder"):
        if not 1 <= k < len(cols):
            raise ValueError(f"k = {k} must be at least 1 and below the number of columns, {len(cols)}")
        self.cols, self.k, self.out = list(cols), k, out

    def fit(self, df: DataFrame) -> "PcaError":
        self.scaler = Standardizer(self.cols).fit(df)
        self.pca = PCA(k=self.k, inputCol="_x", outputCol="_p").fit(self._vectors(df))
        return self

    def _vectors(self, df: DataFrame) -> DataFrame:
        z = [c + "_z" for c in self.cols]
        scaled = self.scaler.transform(df, suffix="_z").na.fill(0.0, z)
        return assemble(scaled, z, "_x").drop(*z)

    def transform(self, df: DataFrame) -> DataFrame:
        d = len(self.cols)
        p = self.pca.transform(self._vectors(df))
        sq = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)
        err = F.greatest((sq(vector_to_array("_x")) - sq(vector_to_array("_p"))) / F.lit(float(d)),
                         F.lit(0.0))
        return p.withColumn(self.out, err).drop("_x", "_p")


# --------------------------------------------------------------------------
# M6: isolation forest
# --------------------------------------------------------------------------

def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Arrays (feature, threshold, left, right, size) of one isolation tree."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))  # noqa: E702
        if depth >= max_depth or len(idx) <= 1:
            return i
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        mask = sub[:, f] < t
        left[i] = node(idx[mask], depth + 1)
        right[i] = node(idx[~mask], depth + 1)
        return i

    node(np.arange(len(X)), 0)
    return feat, thr, left, right, size


def _path_lengths(X: np.ndarray, tree) -> np.ndarray:
    """Path length of every row of X: depth of the leaf reached plus the
    average path length c(size) of the rows left in that leaf. All rows
    walk one level per step (at most the tree depth steps)."""
    feat, thr, left, right, adj = tree
    node = np.zeros(len(X), dtype=np.int64)
    depth = np.zeros(len(X))
    rows = np.arange(len(X))
    while True:
        f = feat[node]
        inner = f >= 0
        if not inner.any():
            break
        go_left = X[rows, np.where(inner, f, 0)] < thr[node]
        nxt = np.where(go_left, left[node], right[node])
        node = np.where(inner, nxt, node)
        depth += inner
    return depth + adj[node]


def _tree_arrays(feat, thr, left, right, size):
    """numpy form of a grown tree, with c(size) precomputed per node."""
    return (np.asarray(feat, dtype=np.int64), np.asarray(thr, dtype=float),
            np.asarray(left, dtype=np.int64), np.asarray(right, dtype=np.int64),
            np.array([_c(float(n)) for n in size]))


class IsolationForest:
    """Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

    Each tree keeps ``sample_size`` of about twice as many rows drawn by
    hashes of the row id, so drawing is one pass with no shuffle of the data and
    follows one rule at every size; the draws
    (trees x sample_size rows) are grown in parallel, one tree per group in
    ``applyInPandas``. The forest (at most trees x (2 * sample_size) nodes)
    is shipped to the scoring tasks, which score Arrow batches in
    ``mapInPandas``. Output: ``score - 0.5`` with ``score = 2^(-E[h]/c(n))``,
    i.e. the negated decision function for the default offset.
    """

    def __init__(self, cols, id_col: str, trees: int = 100, sample_size: int = 256,
                 seed: int = 42, out: str = "isolation_forest"):
        self.cols, self.id_col = list(cols), id_col
        self.trees, self.sample_size, self.seed, self.out = trees, sample_size, seed, out
        self.forest = None

    def fit(self, df: DataFrame) -> "IsolationForest":
        ship_package(df.sparkSession)
        n = df.count()
        psi = min(self.sample_size, n)
        cols, seed, max_depth = self.cols, self.seed, int(math.ceil(math.log2(max(psi, 2))))
        base = df.select(*[F.col(c).cast("double") for c in cols], F.col(self.id_col).alias("_id"))
        # Every row is drawn rate times on average, each time by a tree of its
        # own hash: below one draw a row that is one hash and no copy.
        rate = 2.0 * psi * self.trees / max(n, 1)
        part = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
        times = F.floor(F.lit(rate) + part).cast("int")
        tree = lambda j: F.pmod(F.xxhash64(F.col("_id"), F.lit(seed), j), F.lit(self.trees)).cast("int")
        draws = (base.withColumn("_n", times).where("_n > 0")
                 .withColumn("tree", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_n")), tree)))).drop("_n")
                 .withColumn("h", F.xxhash64("_id", F.lit(seed), F.col("tree"), F.lit(1))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "_id"]).head(psi)
            t = int(pdf["tree"].iloc[0])
            X = pdf[cols].fillna(0.0).to_numpy(dtype=float)
            rng = np.random.default_rng(seed * 1000 + t)
            feat, thr, left, right, size = _grow(X, rng, max_depth)
            return pd.DataFrame({"tree": [t], "feat": [feat], "thr": [thr], "left": [left],
                                 "right": [right], "size": [size], "n": [len(X)]})

        schema = ("tree int, feat array<int>, thr array<double>, left array<int>, "
                  "right array<int>, size array<int>, n int")
        rows = draws.groupBy("tree").applyInPandas(grow, schema).collect()
        self.forest = [_tree_arrays(r["feat"], r["thr"], r["left"], r["right"], r["size"]) for r in
                       sorted(rows, key=lambda r: r["tree"])]
        self.psi = psi
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        forest, cols, cn, out = self.forest, self.cols, _c(self.psi), self.out
        bforest = df.sparkSession.sparkContext.broadcast(forest)
        schema = _with_field(df, out, T.DoubleType())

        def score(batches):
            trees = bforest.value
            for pdf in batches:
                X = pdf[cols].astype(float).fillna(0.0).to_numpy()
                eh = np.mean([_path_lengths(X, t) for t in trees], axis=0) if len(X) else np.zeros(0)
                pdf[out] = np.power(2.0, -eh / cn) - 0.5 if cn > 0 else 0.0
                yield pdf

        return df.mapInPandas(score, schema)


# --------------------------------------------------------------------------
# M7: one-class score by random Fourier features
# --------------------------------------------------------------------------

class OneClassScore:
    """Approximate one-class RBF score: ``z(x) = sqrt(2/D) cos(W x + b)``
    with ``W ~ N(0, 2 gamma)`` (Rahimi and Recht, 2007) approximates
    ``k(x, y) = exp(-gamma |x - y|^2)``; the score is ``-<z(x), mean z>``
    (minus the mean kernel similarity to the training rows), shifted so
    that the ``nu`` share of training rows score above 0. An approximation
    of the SVM decision function with uniform weights, stated as such.
    The mean of z is a distributed sum of per-partition partial sums.
    ``scale`` standardises the columns first (fitted, part of the state): the
    kernel width means nothing on columns of unlike units."""

    def __init__(self, cols, gamma: float = 0.1, nu: float = 0.05, dims: int = 256,
                 seed: int = 42, out: str = "one_class_svm", scale: bool = False):
        self.cols, self.gamma, self.nu, self.dims, self.seed, self.out = list(cols), gamma, nu, dims, seed, out
        self.scale, self.mean, self.sd = scale, np.zeros(len(self.cols)), np.ones(len(self.cols))

    def fit(self, df: DataFrame) -> "OneClassScore":
        ship_package(df.sparkSession)
        rng = np.random.default_rng(self.seed)
        d = len(self.cols)
        if self.scale:
            scaler = Standardizer(self.cols).fit(df)
            self.mean = np.array([scaler.mean[c] for c in self.cols])
            self.sd = np.array([scaler.sd[c] for c in self.cols])
        self.W = rng.normal(0.0, math.sqrt(2 * self.gamma), size=(d, self.dims))
        self.b = rng.uniform(0, 2 * math.pi, size=self.dims)
        W, b, cols, D, mean, sd = self.W, self.b, self.cols, self.dims, self.mean, self.sd

        def partial(batches):
            for pdf in batches:
                X = pdf[cols].astype(float).fillna(0.0).to_numpy()
                Z = math.sqrt(2.0 / D) * np.cos((X - mean) / sd @ W + b)
                yield pd.DataFrame({"s": [Z.sum(axis=0).tolist()], "n": [len(X)]})

        sums = df.select(*cols).mapInPandas(partial, "s array<double>, n long")
        tot = sums.agg(F.sum("n").alias("n"),
                       F.array(*[F.sum(F.col("s")[i]) for i in range(D)]).alias("s")).collect()[0]
        self.mu = np.asarray(tot["s"], dtype=float) / max(tot["n"], 1)
        self.offset = 0.0
        raw = self._raw(df.select(*cols)).persist()  # scored once for the quantile passes
        q = exact_quantiles(raw, [self.out], 1.0 - self.nu)[self.out]
        raw.unpersist()
        self.offset = q or 0.0
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        W, b, mu, cols, D, out, off = self.W, self.b, self.mu, self.cols, self.dims, self.out, self.offset
        mean, sd = self.mean, self.sd
        schema = _with_field(df, out, T.DoubleType())

        def score(batches):
            for pdf in batches:
                X = pdf[cols].astype(float).fillna(0.0).to_numpy()
                Z = math.sqrt(2.0 / D) * np.cos((X - mean) / sd @ W + b)
                pdf[out] = -(Z @ mu) - off
                yield pdf

        return df.mapInPandas(score, schema)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._raw(df)


# --------------------------------------------------------------------------
# M8, M9: clusters of the scores, distance to the nearest centroid
# --------------------------------------------------------------------------

def kmeans_clusters(df: DataFrame, cols, k: int = 2, seed: int = 42, out: str = "cluster"):
    """(clustered rows, centroids as a list of lists)."""
    x = assemble(df, cols, "_x")
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol=out).fit(x)
    return model.transform(x).drop("_x"), [list(map(float, c)) for c in model.clusterCenters()]


def nearest_centroid_distance(cols, centroids) -> Column:
    """Euclidean distance to the nearest of a few fixed centroids (literals)."""
    dists = []
    for c in centroids:
        s = None
        for col, v in zip(cols, c):
            term = (F.col(col) - F.lit(float(v))) * (F.col(col) - F.lit(float(v)))
            s = term if s is None else s + term
        dists.append(F.sqrt(s))
    return dists[0] if len(dists) == 1 else F.least(*dists)


def centroid_outliers(df: DataFrame, cols, centroids, q: float = 0.95) -> DataFrame:
    """Distance to the nearest centroid and ``distance > quantile(q)``."""
    d = df.withColumn("distance", nearest_centroid_distance(cols, centroids))
    lim = exact_quantiles(d, ["distance"], q)["distance"]
    return d.withColumn("is_outlier", F.coalesce(F.col("distance") > F.lit(lim), F.lit(False)).cast("int"))


# --------------------------------------------------------------------------
# M10-M19: splits, classifiers, votes, metrics
# --------------------------------------------------------------------------

def split_flag(id_col: str, train_pct: int = 80, seed: int = 42) -> Column:
    """Repeatable train/test split: True for the training share."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(100)) < train_pct


def majority_vote(*preds) -> Column:
    s = None
    for p in preds:
        c = F.col(p) if isinstance(p, str) else p
        s = c if s is None else s + c
    return (s >= (len(preds) // 2 + 1)).cast("int")


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def binary_metrics(df: DataFrame, y: str, p: str, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 of class 1 from the confusion counts (0 when
    undefined)."""
    g = df.agg(F.count_if((F.col(y) == 1) & (F.col(p) == 1)).alias("tp"),
               F.count_if((F.col(y) == 0) & (F.col(p) == 1)).alias("fp"),
               F.count_if((F.col(y) == 1) & (F.col(p) == 0)).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    g = g.select("tp", "fp", "fn", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return g.select("tp", "fp", "fn", F.round("precision", digits).alias("precision"),
                    F.round("recall", digits).alias("recall"), F.round(f1, digits).alias("f1"))


def weighted_metrics(df: DataFrame, y: str, p: str, digits: int = 6) -> DataFrame:
    """Support-weighted precision, recall and F1 over the true classes. The
    rows are read once, for the counts of (true, predicted) pairs; each of these
    few rows then counts for its true and for its predicted class."""
    pairs = df.groupBy(F.col(y).alias("t"), F.col(p).alias("q")).agg(F.count("*").alias("n"))
    one = lambda c, support, predicted, tp: F.struct(c.alias("c"), support.alias("support"), predicted.alias("predicted"), tp.alias("tp"))
    none, n = F.lit(0).cast("long"), F.col("n")
    sides = F.explode(F.array(one(F.col("t"), n, none, F.when(F.col("t") == F.col("q"), n).otherwise(none)),
                              one(F.col("q").cast(df.schema[y].dataType), none, n, none)))
    per = (pairs.select(sides.alias("s")).select("s.*").where(F.col("c").isNotNull()).groupBy("c")
           .agg(*(F.sum(x).alias(x) for x in ("support", "predicted", "tp"))).where("support > 0")
           .withColumn("prec", F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0))
           .withColumn("rec", F.col("tp") / F.col("support"))
           .withColumn("f1", F.when(F.col("prec") + F.col("rec") > 0,
                                    2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0)))
    return per.agg(*(F.round(F.sum(F.col(x) * F.col("support")) / F.sum("support"), digits).alias(name)
                     for x, name in (("prec", "precision"), ("rec", "recall"), ("f1", "f1"))))


def probability_cut(df: DataFrame, prob: str = "probability", threshold: float = 0.5,
                    out: str = "flag") -> DataFrame:
    """1 where the probability of class 1 reaches ``threshold``: 0.5, or the
    fitted limit of the scores (``SigmaLimit.limit``)."""
    return df.withColumn(out, (vector_to_array(prob)[1] >= F.lit(threshold)).cast("int"))


def train_vote_models(train: DataFrame, cols, label: str = "label", seed: int = 42,
                      rf_trees=(100, 200, 300, 400, 500), folds: int = 2):
    """Logistic regression (C = 1 as regParam = 1/n), a random forest tuned
    over tree counts by k-fold cross-validation, both MLlib."""
    x = assemble(train, cols, "features")
    n = x.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(n, 1),
                            standardization=False, predictionCol="p_lr", probabilityCol="prob_lr",
                            rawPredictionCol="raw_lr").fit(x)
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed,
                                predictionCol="p_rf", probabilityCol="prob_rf", rawPredictionCol="raw_rf")
    grid = ParamGridBuilder().addGrid(rf.numTrees, list(rf_trees)).build()
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="p_rf", metricName="accuracy")
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, seed=seed,
                        parallelism=min(len(grid) * folds, 4)).fit(x)
    return lr, cv.bestModel


class LabelTree:
    """Decision tree predicting the label text; classes indexed in sorted
    name order (the label set is bounded by the rule count). Fits of more than
    ``max_rows`` rows are grown by ``GrownTrees``, by the same rules: MLlib holds
    every node with a count per class on the driver."""

    def __init__(self, cols, label: str = "type_anomalie", max_depth: int = 30, seed: int = 42, max_rows: int = 100_000):
        self.cols, self.label, self.max_depth, self.seed, self.max_rows = list(cols), label, max_depth, seed, max_rows

    def fit(self, df: DataFrame) -> "LabelTree":
        from pulseframe.operators.grown_trees import GrownTrees
        idx = StringIndexer(inputCol=self.label, outputCol="_y", stringOrderType="alphabetAsc",
                            handleInvalid="keep")
        self.grown = None
        if df.limit(self.max_rows + 1).count() > self.max_rows:
            names = idx.fit(df)
            self.labels = names.labels
            self.grown = GrownTrees(self.cols, 1, self.max_depth, seed=self.seed).fit(names.transform(df), "_y")
            return self
        asm = VectorAssembler(inputCols=self.cols, outputCol="_f", handleInvalid="keep")
        tree = DecisionTreeClassifier(featuresCol="_f", labelCol="_y", maxDepth=self.max_depth,
                                      seed=self.seed, predictionCol="_p", maxBins=64)
        self.model = Pipeline(stages=[idx, asm, tree]).fit(df)
        self.labels = self.model.stages[0].labels
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.model.transform(df) if self.grown is None else self.grown.transform(df, "_p").withColumn("_p", F.col("_p").cast("double"))
        back = IndexToString(inputCol="_p", outputCol="predicted_label", labels=self.labels)
        return back.transform(p).drop("_y", "_f", "_p", "rawPrediction", "probability")


__all__ = ["Standardizer", "standardize", "PcaError", "IsolationForest", "OneClassScore",
           "kmeans_clusters", "nearest_centroid_distance", "centroid_outliers", "split_flag",
           "majority_vote", "accuracy", "binary_metrics", "weighted_metrics", "probability_cut",
           "train_vote_models", "LabelTree", "KnnVote"]


# --------------------------------------------------------------------------
# M11: k nearest neighbours vote
# --------------------------------------------------------------------------

BLOCK_ROWS = 20_000  # rows of a reference or query block


def _nearest(X: np.ndarray, R: np.ndarray, kmax: int, max_cells: int = 4_000_000):
    """(first row, nearest reference rows, distances) of runs of rows of ``X``
    (exact, ties in distance by reference order), one (chunk x reference) matrix at
    a time of at most ``max_cells`` entries. Distances are those of
    ``neighbours``, so that a row has the same neighbours whichever search finds them."""
    from pulseframe.operators.neighbours import _nearest_places
    chunk = max(1, max_cells // max(len(R), 1))
    for s in range(0, len(X), chunk):
        yield s, *_nearest_places(X[s:s + chunk], R, min(kmax, len(R)))


def _majority(ny: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Most frequent of the first ``k`` labels of each row (ties to the smaller)."""
    return _majorities(ny, labels, [k])[k]


def _majorities(ny: np.ndarray, labels: np.ndarray, ks) -> dict:
    """``_majority`` for each k."""
    counts = np.stack([np.cumsum(ny == lab, axis=1) for lab in labels], axis=2)
    return {k: labels[counts[:, min(k, ny.shape[1]) - 1].argmax(axis=1)] for k in ks}


BOX_DIMS = 8        # columns up to which boxes leave rows out
BOX_ROWS = 32       # reference rows of a box
BOX_QUERIES = 16    # query rows searched together


def _cells(P: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of ``P`` in cells of at most ``rows``, halved at the median of
    the widest column."""
    out, open_ = [], [np.arange(len(P))]
    while open_:
        own = open_.pop()
        if len(own) <= rows:
            out.append(own)
            continue
        part = P[own]
        c = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order, mid = np.argpartition(part[:, c], len(own) // 2), len(own) // 2
        open_ += [own[order[:mid]], own[order[mid:]]]
    return out


def _boxes(R: np.ndarray):
    """(cells, lower corners, upper corners, sizes) of reference rows; None where
    boxes leave hardly a row out."""
    if R.ndim != 2 or not 1 <= R.shape[1] <= BOX_DIMS or len(R) <= 16 * BOX_ROWS or not np.isfinite(R).all():
        return None
    cells = _cells(R, BOX_ROWS)
    return (cells, np.stack([R[c].min(axis=0) for c in cells]), np.stack([R[c].max(axis=0) for c in cells]),
            np.array([len(c) for c in cells]))


def _box_rows(X: np.ndarray, R: np.ndarray, k: int, boxes):
    """(query rows, reference rows) of groups of near queries: the boxes that surely
    hold ``k`` rows bound the distance, and boxes farther off are left out."""
    cells, low, high, sizes = boxes
    # Distances by way of |x|^2 + |r|^2 - 2 x.r are off by rounding of the squares.
    slack = 1e-9 * ((R * R).sum(axis=1).max() + (X * X).sum(axis=1).max()) if len(X) else 0.0
    for own in _cells(X, BOX_QUERIES):
        a, b = X[own].min(axis=0), X[own].max(axis=0)
        least = (np.maximum(np.maximum(low - b, a - high), 0.0) ** 2).sum(axis=1)
        most = (np.maximum(high - a, b - low) ** 2).sum(axis=1)
        first = np.argpartition(most, min(k, len(most)) - 1)[:k]  # a box holds a row at least
        first = first[np.argsort(most[first])]
        bound = most[first[np.searchsorted(np.cumsum(sizes[first]), k)]]
        yield own, np.sort(np.concatenate([cells[i] for i in np.flatnonzero(least <= bound + slack)]))


def _nearest_in_boxes(X: np.ndarray, R: np.ndarray, kmax: int, boxes, max_cells: int = 4_000_000):
    """As ``_nearest``, by groups of near rows."""
    kk = min(kmax, len(R))
    for own, rows in _box_rows(X, R, kk, boxes):
        for s, near, d in _nearest(X[own], R[rows], kk, max_cells):
            yield own[s:s + len(near)], rows[near], d


def _knn_votes(X: np.ndarray, R: np.ndarray, y: np.ndarray, ks, max_cells: int = 4_000_000, boxes=None) -> dict:
    """Majority label of the k nearest reference rows, for each k; ``boxes`` (of
    the reference rows) are made where they aren't given."""
    out = {k: np.zeros(len(X), dtype=np.int64) for k in ks}
    labels = np.unique(y)
    if len(X) > BOX_QUERIES and np.isfinite(X).all():
        boxes = boxes or _boxes(R)
        if boxes:
            for own, near, _ in _nearest_in_boxes(X, R, max(ks), boxes, max_cells):
                for k, votes in _majorities(y[near], labels, ks).items():
                    out[k][own] = votes
            return out
    for s, near, _ in _nearest(X, R, max(ks), max_cells):
        for k, votes in _majorities(y[near], labels, ks).items():
            out[k][s:s + len(near)] = votes
    return out


def _fold(seed: int, folds: int) -> Column:
    """Fold of a reference row."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)).cast("int")


class KnnVote:
    """k-NN classifier with k chosen by 2-fold cross-validation over 1..24.

    Every labelled row given to ``fit`` is a reference row, and the ``k`` nearest ones
    are exact at every size; size decides only where they are searched. Up to
    ``max_reference`` rows are shipped to every task, which scores Arrow batches in
    numpy. Beyond that both sides are dealt to cells of space
    of about ``block_rows`` rows (``neighbours.exact_parts``), as are more than ``block_rows`` rows
    that are cross-validated. ``exact=False`` takes the neighbours from a ``NeighbourIndex`` of
    ``trees`` trees instead, again at every size: approximate (see ``neighbours.recall``). The
    data being scored is never gathered. A row without label is no reference row.
    """

    def __init__(self, cols, label: str = "label", ks=range(1, 25), folds: int = 2, seed: int = 42, out: str = "p_knn",
                 max_reference: int = 100_000, block_rows: int = BLOCK_ROWS, exact: bool = True, trees: int = 12):
        self.cols, self.label, self.ks, self.folds = list(cols), label, list(ks), folds
        self.seed, self.out, self.max_reference, self.block_rows = seed, out, max_reference, block_rows
        self.exact, self.trees = exact, trees

    def _values(self) -> Column:
        return F.array(*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in self.cols])

    def fit(self, train: DataFrame, id_col: str) -> "KnnVote":
        ship_package(train.sparkSession)
        ref = _written(train.where(F.col(self.label).isNotNull())
                       .select(F.col(id_col).cast("long").alias("id"), self._values().alias("x"), F.col(self.label).cast("int").alias("y")), "knn-reference")
        n = ref.count()
        self.keep(ref, n)
        self.k = self.ks[0] if len(self.ks) == 1 else self._validated(ref, n)
        return self

    def keep(self, ref: DataFrame, n: int) -> None:
        """Take the ``n`` rows (id, x, y) as reference."""
        self.ref, self.n = ref, n
        self.R = self.y = None
        if self.exact and n <= self.max_reference:
            self.ids, self.R, self.y = _arrays(ref, len(self.cols))

    def _validated(self, ref: DataFrame, n: int) -> int:
        acc = {k: 0 for k in self.ks}
        if self.exact and n <= self.block_rows:
            _, X, y, fold = _arrays(ref.withColumn("fold", _fold(self.seed, self.folds)), len(self.cols), "fold")
            for f in range(self.folds):
                tr, te = fold != f, fold == f
                if tr.sum() == 0 or te.sum() == 0:
                    continue
                votes = _knn_votes(X[te], X[tr], y[tr], self.ks)
                for k in self.ks:
                    acc[k] += int((votes[k] == y[te]).sum())
        else:
            ks, fold = self.ks, _fold(self.seed, self.folds)
            asked = _written(ref.withColumn("pid", F.monotonically_increasing_id()).withColumn("part", fold), "knn-folds").withColumnRenamed("y", "t")
            # A row is reference for the queries of all folds but its own.
            others = F.filter(F.array(*(F.lit(f) for f in range(self.folds))), lambda f: f != fold)
            near = self._neighbours(asked, ref.withColumn("part", F.explode(others)), max(ks))

            def hits(batches):
                for b in batches:
                    for own, ny in _label_lists(b.column("labels")):
                        y = b.column("t").to_numpy()[own]
                        for k, votes in _majorities(ny, np.unique(ny), ks).items():
                            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "right": pa.array([int((votes == y).sum())])})

            for r in near.mapInArrow(hits, "k int, right long").groupBy("k").agg(F.sum("right")).collect():
                acc[r[0]] += r[1]
        return max(self.ks, key=lambda k: (acc[k], -k))

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        if self.R is None:
            return self._by_neighbours(df)
        sc = df.sparkSession.sparkContext
        ref = sc.broadcast((self.R, self.y))
        cols, k, out = self.cols, self.k, self.out
        schema = _with_field(df, out, T.IntegerType())

        def score(batches):
            R, y = ref.value
            boxes = _boxes(R)
            for pdf in batches:
                X = pdf[cols].astype(float).fillna(0.0).to_numpy()
                pdf[out] = _knn_votes(X, R, y, [k], boxes=boxes)[k].astype("int32") if len(X) else np.zeros(0, "int32")
                yield pdf

        return df.mapInPandas(score, schema)

    def _neighbours(self, queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
        """(pid, t, labels) of every row of ``queries`` (pid, part, x, t): labels of the nearest
        rows of ``reference`` (part, id, x, y) of the same part, nearest first."""
        from pulseframe.operators.neighbours import NeighbourIndex, best_of_parts, exact_parts
        if self.exact:
            parts = _written(exact_parts(queries, reference, k, self.block_rows, labels_only=True), "knn-parts")
            near = (parts.where("done").select("pid", "t", F.col("y").alias("labels"))
                    .unionByName(best_of_parts(parts.where(~F.col("done")), k).select("pid", "t", F.col("near.y").alias("labels"))))
        else:
            near = None
            for part in range(self.folds if "part" in reference.columns else 1):
                own = NeighbourIndex(len(self.cols), k, self.trees, seed=self.seed).fit(reference.where(F.col("part") == part))
                found = own.nearest(queries.where(F.col("part") == part).select(F.col("pid").alias("id"), "x"))
                found = found.select(F.col("id").alias("pid"), F.col("y").alias("labels")).join(queries.select("pid", "t"), "pid")
                near = found if near is None else near.unionByName(found)
            near = near.select("pid", "t", "labels")
        return near.where(F.size("labels") > 0)

    def _by_neighbours(self, df: DataFrame) -> DataFrame:
        rows = _written(df.withColumn("_row", F.monotonically_increasing_id()), "knn-rows")
        none, k = F.lit(0), self.k
        near = self._neighbours(rows.select(F.col("_row").alias("pid"), none.alias("part"), self._values().alias("x"), none.alias("t")),
                                self.ref.withColumn("part", none), k)

        def vote(batches):
            for b in batches:
                for own, ny in _label_lists(b.column("labels")):
                    yield pa.RecordBatch.from_arrays([b.column("pid").take(pa.array(own)), pa.array(_majority(ny, np.unique(ny), k).astype("int32"))],
                                                     names=["_row", "_vote"])

        votes = near.mapInArrow(vote, "_row long, _vote int")
        # A row whose leaves hold no reference row gets the most frequent label.
        usual = self.ref.groupBy("y").count().orderBy(F.desc("count"), "y").first()
        return rows.join(votes, "_row", "left").na.fill({"_vote": usual["y"] if usual else 0}).select(*[F.col(c) for c in df.columns if c != self.out], F.col("_vote").alias(self.out))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to shared storage, so that every reader sees the same rows."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _arrays(ref: DataFrame, dims: int, *more: str):
    """Ids, features, labels and ``more`` of a reference table, by id and label."""
    t = ref.toArrow()
    t = t.take(pc.sort_indices(t, [("id", "ascending"), ("y", "ascending")], null_placement="at_start"))
    whole = lambda c: pc.fill_null(t[c], -(1 << 63) if c == "id" else 0).to_numpy().astype(np.int64)
    x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    return whole("id"), x, whole("y"), *(whole(c) for c in more)


def _label_lists(labels: pa.ListArray):
    """(rows, label matrix) of the lists of each length."""
    n, flat = np.diff(labels.offsets.to_numpy()), labels.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(n) - n
    # Rows have as many neighbours as there are reference rows, k at most.
    for size in np.unique(n[n > 0]):
        own = np.flatnonzero(n == size)
        yield own, flat[start[own, None] + np.arange(size)]
