"""Unsupervised anomaly scores: fitted on the train side, scored on the holdout, scaled to [0, 1]."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import array_literal, hash_key, hash_unit, row_count
from loomwright.operators.encode import minmax_scaler
from loomwright.operators.neighbours import knn, knn_exact
from loomwright.operators.sets import hash_numbered
from loomwright.plans.quantile import column_quantiles
from loomwright.plans.store import cut, spread


def scaled(df: DataFrame, score: str = "score") -> DataFrame:
    return minmax_scaler([score]).fit(df).apply(df)


def _means(df: DataFrame, vec: str) -> list[float]:
    cells = df.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()
    return [r["m"] for r in sorted(cells, key=lambda r: r["i"])]


def pca_reconstruction(train: DataFrame, test: DataFrame, vec: str, k: int = 15) -> DataFrame:
    """Squared error after projecting onto the leading components and back."""
    centre = array_literal(_means(train, vec))

    def centred(df):
        c = F.zip_with(F.col(vec), centre, lambda a, b: a - b)
        return df.withColumn("__c", array_to_vector(c))

    model = PCA(k=k, inputCol="__c", outputCol="__z").fit(centred(train))
    z = model.transform(centred(test))

    def square(v):
        return F.aggregate(vector_to_array(v), F.lit(0.0), lambda a, x: a + x * x)

    # an orthonormal projection: |c|^2 - |z|^2 is the squared residual
    return scaled(z.withColumn("score", square("__c") - square("__z")).drop("__c", "__z"))


def gmm(train: DataFrame, test: DataFrame, vec: str, k: int = 8, seed: int = 42, reg: float = 1e-4, max_iter: int = 30) -> DataFrame:
    """Negative log density of a full-covariance Gaussian mixture."""
    feats = train.select(array_to_vector(vec).alias("features"))
    model = GaussianMixture(k=k, seed=seed, maxIter=max_iter).fit(feats)
    parts = model.gaussiansDF.collect()
    means = np.array([p["mean"].toArray() for p in parts])
    covs = np.array([p["cov"].toArray() for p in parts]) + reg * np.eye(means.shape[1])
    prec = np.linalg.inv(covs)
    const = np.log(np.maximum(model.weights, 1e-300)) - 0.5 * (np.linalg.slogdet(covs)[1] + means.shape[1] * math.log(2 * math.pi))

    @F.pandas_udf("double")
    def density(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(a, dtype=float) for a in v])
        d = x[:, None, :] - means[None, :, :]
        logs = const[None, :] - 0.5 * np.einsum("nkd,kde,nke->nk", d, prec, d)
        top = logs.max(axis=1)
        return pd.Series(-(top + np.log(np.exp(logs - top[:, None]).sum(axis=1))))

    return scaled(test.withColumn("score", density(vec)))


def _moments(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    m = len(cols)
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(m) for j in range(i, m)]
    r = df.agg(*aggs).first()
    return np.array([r[f"m{i}"] for i in range(m)]), np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])


def _quadratic(cols: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    inv = np.linalg.inv(cov)
    d = [F.col(c) - F.lit(float(v)) for c, v in zip(cols, mean)]
    out = F.lit(0.0)
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            out = out + d[i] * d[j] * F.lit(float(inv[i, j] * (1 if i == j else 2)))
    return out


def mahalanobis(train: DataFrame, test: DataFrame, cols: Sequence[str], rounds: int = 0, keep: float = 0.75) -> DataFrame:
    """Gaussian distance; each trimming round refits on the closest share of the train side."""
    mean, cov = _moments(train, cols)
    for _ in range(rounds):
        d = train.withColumn("__d", _quadratic(cols, mean, cov))
        limit = column_quantiles(d, ["__d"], [keep])["__d"][0]
        mean, cov = _moments(d.filter(F.col("__d") <= limit), cols)
    return test.withColumn("score", _quadratic(cols, mean, cov))


# ---- isolation forest --------------------------------------------------------------------------


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, np.ndarray]:
    """Nodes of a tree: the right child stands behind the left one, a leaf leads to itself and has a path length."""
    nodes: list[list] = [[0, np.inf, 0, 0.0]]
    stack = [(0, np.arange(len(x)), 0)]
    while stack:
        at, rows, depth = stack.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.nonzero(hi > lo)[0]
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[at] = [0, np.inf, at, depth + average_path(len(rows))]
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        left = part[:, f] < t
        if not left.any():
            t = float(np.nextafter(lo[f], np.inf))
            left = part[:, f] < t
        nodes[at] = [f, t, len(nodes), 0.0]
        nodes += [[0, np.inf, 0, 0.0], [0, np.inf, 0, 0.0]]
        stack += [(nodes[at][2], rows[left], depth + 1), (nodes[at][2] + 1, rows[~left], depth + 1)]
    feature, threshold, child, path = zip(*nodes)
    return {"feature": np.array(feature, np.int32), "threshold": np.array(threshold), "child": np.array(child, np.int32), "path": np.array(path)}


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


_TREE_SAMPLE = "tree int, marks binary, points binary"
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _SPREAD[1]
    h = (h ^ (h >> np.uint64(27))) * _SPREAD[2]
    return h ^ (h >> np.uint64(31))


def _lowest(marks: np.ndarray, points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the lowest marks, ties by the points: the same of any split and order of the rows."""
    order = np.lexsort((*points.T[::-1], marks))[:size]
    return marks[order], points[order]


def _tree_samples(rows: DataFrame, width: int, trees: int, size: int, seed: int) -> DataFrame:
    """For every tree the ``size`` rows with its lowest hash marks, of each partition: samples that merge.

    ``rows``: (mark, x array): a hash of the row and its numbers.
    """
    turn = _mixed((np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * _SPREAD[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, points = np.empty((0, trees), np.uint64), np.empty((0, trees, width))
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            x = batch.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, len(own), 4096):
                here = _mixed(own[at:at + 4096, None] ^ turn[None, :])
                take = min(size, len(here))
                pick = np.argpartition(here, take - 1, axis=0)[:take] if take < len(here) else np.broadcast_to(np.arange(take)[:, None], here.shape)
                marks = np.concatenate([marks, np.take_along_axis(here, pick, axis=0)])
                points = np.concatenate([points, x[at:at + 4096][pick]])
                if len(marks) > size:
                    keep = np.argpartition(marks, size - 1, axis=0)[:size]
                    marks, points = np.take_along_axis(marks, keep, axis=0), np.take_along_axis(points, keep[:, :, None], axis=0)
        if len(marks):
            yield pa.RecordBatch.from_arrays([
                pa.array(range(trees), pa.int32()), pa.array([marks[:, t].tobytes() for t in range(trees)], pa.binary()),
                pa.array([points[:, t].tobytes() for t in range(trees)], pa.binary())], ["tree", "marks", "points"])

    return rows.mapInArrow(run, _TREE_SAMPLE)


def isolation_forest(train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str], trees: int = 300, size: int = 256, seed: int = 42) -> DataFrame:
    """Each tree grows on the ``size`` rows with its lowest hashes of id and seed, drawn from all rows at any table size.

    Rows of equal id and numbers are drawn together. Trees stand in one flat array of nodes; a batch of rows walks all of
    them together, level by level.
    """
    names, width, limit = list(cols), len(cols), math.ceil(math.log2(max(2, size)))
    numbers = F.array(*[F.col(c).cast("double") for c in names])
    mark = F.xxhash64(F.col(id_col), *[F.col(c).cast("double") for c in names]).alias("mark")
    samples = _tree_samples(spread(train.select(mark, numbers.alias("x")), "mark"), width, trees, size, seed)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown():
            nodes = _grow(points, np.random.default_rng([seed, tree]), limit)
            return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([len(points)], pa.int32()), *[pa.array([nodes[n].tobytes()], pa.binary()) for n in nodes]],
                                              ["tree", "n", *nodes])

        tree, marks, points = None, None, None
        for batch in batches:
            for t, m, p in zip(*[c.to_pylist() for c in batch.columns]):
                if t != tree:
                    if tree is not None:
                        yield grown()
                    tree, marks, points = t, np.empty(0, np.uint64), np.empty((0, width))
                marks, points = _lowest(np.concatenate([marks, np.frombuffer(m, np.uint64)]), np.concatenate([points, np.frombuffer(p).reshape(-1, width)]), size)
        if tree is not None:
            yield grown()

    # a tree has fewer than 2 * size nodes
    found = sorted(samples.repartition("tree").sortWithinPartitions("tree").mapInArrow(
        grow, "tree int, n int, feature binary, threshold binary, child binary, path binary").collect(), key=lambda r: r["tree"])
    if not found:
        return test.withColumn("score", F.lit(None).cast("double"))
    root = np.cumsum([0, *[len(r["path"]) // 8 for r in found]])[:-1].astype(np.int32)
    whole = {n: np.concatenate([np.frombuffer(r[n], k) for r in found]) for n, k in (("feature", np.int32), ("threshold", np.float64), ("path", np.float64))}
    child = np.concatenate([np.frombuffer(r["child"], np.int32) + first for r, first in zip(found, root)])
    shared = train.sparkSession.sparkContext.broadcast((root, whole["feature"], whole["threshold"], child, whole["path"], average_path(found[0]["n"]) or 1.0))

    @F.pandas_udf("double")
    def path_score(*parts: pd.Series) -> pd.Series:
        root, feature, threshold, child, path, norm = shared.value
        x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        out = np.empty(len(x))
        for first in range(0, len(x), 512):
            some = x[first:first + 512]
            flat, base = some.ravel(), np.arange(len(some), dtype=np.int32)[:, None] * width
            at = np.broadcast_to(root, (len(some), len(root)))
            for _ in range(limit):
                at = child[at] + (flat[base + feature[at]] >= threshold[at])
            out[first:first + 512] = path[at].sum(axis=1)
        return pd.Series(np.power(2.0, -out / len(root) / norm))

    return spread(test, id_col).withColumn("score", path_score(*names))


def local_outlier_factor(train: DataFrame, test: DataFrame, id_col: str, vec: str, k: int = 20) -> DataFrame:
    """Mean neighbour density over own density (id, score); densities come from the train side only.

    Neighbours are the k nearest of all train rows.
    """
    both = train.select(id_col, vec, F.lit(True).alias("base")).unionByName(test.select(id_col, vec, F.lit(False).alias("base")))
    near = cut(knn_exact(both, k, id_col, vec))
    inside = near.join(train.select(F.col(id_col).alias("qid")), "qid", "left_semi")
    reach = inside.groupBy("qid").agg(F.max("dist").alias("kdist"))
    reached = near.join(reach.select(F.col("qid").alias("bid"), "kdist"), "bid")
    lrd = cut(reached.groupBy("qid").agg((1.0 / (F.avg(F.greatest("kdist", "dist")) + 1e-10)).alias("lrd")))
    around = near.join(lrd.select(F.col("qid").alias("bid"), F.col("lrd").alias("b_lrd")), "bid").groupBy("qid").agg(F.avg("b_lrd").alias("around"))
    scored = test.select(F.col(id_col).alias("qid")).join(lrd, "qid").join(around, "qid")
    return scored.select(F.col("qid").alias(id_col), (F.col("around") / F.col("lrd")).alias("score"))


def rule_flags(df: DataFrame, value: str) -> DataFrame:
    x = F.col(value)

    def rate(cond):
        return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))

    return df.agg(rate(x == 1).alias("rate_one"), rate(x == 0).alias("rate_zero"), rate(x < 0).alias("rate_negative"), rate(x.isNull()).alias("rate_missing"))


def smote(df: DataFrame, id_col: str, vec: str, label: Column, k: int = 5, **search) -> DataFrame:
    """Synthetic minority rows up to the majority size, between a minority row and one of the neighbours found for it."""
    counts = df.agg(F.count_if(label).alias("m"), row_count().alias("n")).first()
    minority = cut(df.filter(label).select(id_col, vec))
    need = counts["n"] - 2 * counts["m"]
    near = knn(minority.withColumn("base", F.lit(True)), k, id_col, vec, **search)
    numbered = hash_numbered(minority, [], id_col, "smote").select("__n", F.col(id_col).alias("qid"), F.col(vec).alias("a"))
    kk = min(k, counts["m"] - 1)
    draws = df.sparkSession.range(max(0, need)).select(
        F.col("id").alias("synthetic"), (F.col("id") % F.lit(counts["m"]) + 1).alias("__n"),
        (F.floor(hash_unit(hash_key("id", seed="neighbour")) * kk) + 1).cast("int").alias("rk"), hash_unit(hash_key("id", seed="gap")).alias("gap"))
    j = draws.join(numbered, "__n").join(near.select("qid", "rk", "bid"), ["qid", "rk"])
    j = j.join(minority.select(F.col(id_col).alias("bid"), F.col(vec).alias("b")), "bid")
    mixed = F.transform(F.arrays_zip("a", "b"), lambda s: s["a"] + (s["b"] - s["a"]) * F.col("gap"))
    return j.select("synthetic", F.col("qid").alias("base_id"), F.col("bid").alias("neighbour_id"), "gap", mixed.alias(vec))
