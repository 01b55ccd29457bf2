"""spark.ml training around the feature stages: fold loops, members, searches, leaderboards."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import row_count
from loomwright.operators.history import class_weights
from loomwright.operators.metrics import roc_auc
from loomwright.operators.sets import train_side, valid_side
from loomwright.plans.stage import StageChain
from loomwright.plans.store import cut


#: The column of a model that gives the probability of class 1 as a number.
POSITIVE = "probability_1"
#: Cells of binned features, up to which boosted trees are fitted on the cells instead of the rows.
CELLS = 1 << 17


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def positive_score(model_output: DataFrame) -> Column:
    """Probability of class 1, or the sigmoid of the margin where a model gives none."""
    if POSITIVE in model_output.columns:
        return F.col(POSITIVE)
    if "probability" in model_output.columns:
        return F.get(vector_to_array("probability"), F.lit(1))
    if "rawPrediction" in model_output.columns:
        return 1.0 / (1.0 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
    return F.col("prediction").cast("double")


def side_by_side(jobs: Sequence[Callable[[], object]], at_once: int) -> list:
    """Results of independent fits in their order, ``at_once`` of them at a time, so that one's small jobs fill another's gaps."""
    if at_once < 2 or len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPool(min(at_once, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(lambda job: job()), jobs, chunksize=1)


def oof_loop(
    df: DataFrame, folds: Sequence[int], fit: Callable[[DataFrame], object], keep: Sequence[str],
    prepare: Callable[[], StageChain] | None = None, test: DataFrame | None = None, at_once: int = 3,
) -> DataFrame:
    """Per fold: stages and model see the training side only; validation and test rows get scores.

    Every row of ``df`` is predicted once (split 'oof'), every test row once per fold (split 'test'). ``at_once``: folds
    fitted at a time; each holds its training side, so wide rows want one.
    """

    def one(f: int) -> list[DataFrame]:
        parts = []
        tr, va = train_side(df, f), valid_side(df, f)
        sides = [(va, "oof")] + ([(test, "test")] if test is not None else [])
        if prepare is not None:
            chain = prepare().fit(tr)
            tr, sides = chain.apply(tr), [(chain.apply(s), n) for s, n in sides]
        model = fit(tr)
        for side, name in sides:
            scored = model.transform(side)
            parts.append(scored.select(*keep, F.lit(name).alias("split"), F.lit(f).alias("fold_no"), positive_score(scored).alias("score")))
        return parts

    found = side_by_side([lambda f=f: one(f) for f in folds], at_once)
    return reduce(DataFrame.unionByName, [part for parts in found for part in parts])


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights as a column (one row per class joined back)."""
    w = class_weights(df, label).select(label, F.col("balanced").alias("weight"))
    return df.join(F.broadcast(w), label)


def logistic(balanced: bool = False, **kw) -> Callable[[DataFrame], object]:
    def fit(tr: DataFrame):
        est = LogisticRegression(featuresCol="features", labelCol="y", maxIter=kw.get("maxIter", 30), regParam=kw.get("regParam", 0.01),
                                 elasticNetParam=0.0)
        return est.setWeightCol("weight").fit(weighted(tr, "y")) if balanced else est.fit(tr)

    return fit


def forest(balanced: bool = False, trees: int = 20, depth: int = 5, seed: int = 42):
    def fit(tr: DataFrame):
        est = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)
        return est.setWeightCol("weight").fit(weighted(tr, "y")) if balanced else est.fit(tr)

    return fit


def boosted(rounds: int = 20, depth: int = 3, seed: int = 42, validation: str | None = None):
    """Boosted trees; with a validation flag column training stops when that side stops improving.

    Trees see a feature only by its bin. Where all features together have few cells of bins, rows are counted by cell and
    label, and the trees are fitted on those counts as weights: the same trees, and rows are read once, not for every level.
    """

    def fit(tr: DataFrame):
        early = {"validationIndicatorCol": validation, "validationTol": 1e-4} if validation else {}
        gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.1, **early)
        edges = bin_edges(gbt, tr) if validation is None else []
        if not edges or np.prod([len(e) + 1.0 for e in edges]) > CELLS:
            return gbt.fit(tr)
        cells = cut(cell_counts(tr, edges))
        # so many bins that each of a feature's bins is one, and that no cell is left out by a sample
        model = gbt.copy().setMaxBins(max(2, math.isqrt(2 * CELLS) + 1)).setWeightCol("weight").fit(cells.coalesce(1))
        trees = [_tree(t._call_java("rootNode"), edges) for t in model.trees]
        return CellBoosted(trees, [float(w) for w in model.treeWeights])

    return fit


def bin_edges(gbt: GBTClassifier, rows: DataFrame) -> list[list[float]]:
    """The thresholds that spark.ml would try for each feature of these rows, by the same sample of them."""
    jvm = rows.sparkSession._jvm

    def scala(name: str):
        return getattr(reduce(getattr, f"org.apache.spark.{name}$".split("."), jvm), "MODULE$")

    gbt._transfer_params_to_java()
    given = scala("ml.util.DatasetUtils").extractInstances(gbt._java_obj, rows.select("features", "y")._jdf, jvm.scala.Option.apply(2))
    kind = scala("mllib.tree.configuration.Algo").Regression()
    strategy = gbt._java_obj.getOldBoostingStrategy(jvm.PythonUtils.toScalaMap({}), kind).treeStrategy()
    seen = scala("ml.tree.impl.DecisionTreeMetadata").buildMetadata(given, strategy, 1, "all")
    found = scala("ml.tree.impl.RandomForest").findSplits(given, seen, gbt.getSeed())
    return [[s.threshold() for s in feature] for feature in found]


def cell_counts(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """(features, y, weight): the bins of each cell that has rows of a label, and how many."""
    sizes = [len(e) + 1 for e in edges]
    cells, steps = int(np.prod(sizes)), np.cumprod([1, *sizes[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * cells, np.int64)
        for batch in batches:
            y = batch.column("y").cast(pa.float64()).to_numpy(zero_copy_only=False)
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("labels of boosted trees are 0 and 1")
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(edges))
            # a bin is all values above the threshold before, up to its own
            cell = sum(np.searchsorted(e, x[:, k], "left") * steps[k] for k, e in enumerate(edges))
            total += np.bincount(2 * cell + y.astype(np.int64), minlength=2 * cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counted = rows.select(vector_to_array("features").alias("x"), "y").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").cast("double").alias("weight"))
    cell = F.floor(F.col("at") / 2)
    bins = [(F.floor(cell / int(step)) % int(size)).cast("double").alias(f"b{k}") for k, (step, size) in enumerate(zip(steps, sizes))]
    table = counted.select(*bins, (F.col("at") % 2).cast("double").alias("y"), "weight")
    return assemble(table, [f"b{k}" for k in range(len(edges))]).select("features", "y", "weight")


def _tree(node, edges: list[list[float]]) -> float | tuple:
    """A tree over bins as one over the features' own values: a leaf's value, or (feature, threshold, left, right)."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    k, at = node.split().featureIndex(), node.split().threshold()
    return k, edges[k][math.floor(at)], _tree(node.leftChild(), edges), _tree(node.rightChild(), edges)


@dataclass(frozen=True)
class CellBoosted:
    """Boosted trees and their weights, as expressions on the features."""

    trees: list
    weights: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        def value(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            k, at, left, right = tree
            return F.when(F.get("__x", F.lit(k)) <= at, value(left)).otherwise(value(right))

        margin = reduce(Column.__add__, [value(t) * w for t, w in zip(self.trees, self.weights)])
        scored = df.withColumn("__x", vector_to_array("features")).withColumn("__m", margin)
        return scored.withColumn(POSITIVE, 1.0 - 1.0 / (1.0 + F.exp(2.0 * F.col("__m")))).drop("__x", "__m")


def boosted_multiclass(df: DataFrame, rounds: int = 5, depth: int = 3, seed: int = 42):
    """One boosted model per class; scores are normalised per row by the caller."""
    est = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)
    return OneVsRest(classifier=est, featuresCol="features", labelCol="y").fit(df)


def linear_member(alpha: float, mix: float):
    """Ridge (mix 0), lasso (mix 1) or elastic net."""

    def fit(tr: DataFrame):
        return LinearRegression(featuresCol="features", labelCol="y", regParam=alpha, elasticNetParam=mix, maxIter=50).fit(tr)

    return fit


@dataclass(frozen=True)
class Perceptron:
    """A fitted net, and the validation loss after each round that it was trained for."""

    model: object
    losses: tuple[float, ...]
    best: int

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def log_loss_of(scored: DataFrame, label: str = "y", eps: float = 1e-15) -> float:
    """Mean log loss of class probabilities."""
    p = F.get(vector_to_array("probability"), F.col(label).cast("int"))
    return scored.agg(F.avg(-F.log(F.greatest(p, F.lit(eps))))).first()[0]


def regressions_oof(df: DataFrame, folds: Sequence[int], members: dict[str, Callable[[DataFrame], object]]) -> DataFrame:
    """Every row with one out-of-fold prediction column a member; a fold's models see the other folds alone."""
    parts = []
    for f in folds:
        train, out = train_side(df, f), valid_side(df, f)
        for name, fit in members.items():
            out = fit(train).transform(out).withColumnRenamed("prediction", name)
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)


def perceptron_with_stop(layers: Sequence[int], validation: str, seed: int = 42, round_iter: int = 10, max_rounds: int = 12, patience: int = 2, least_gain: float = 5e-4):
    """A net trained in rounds from the weights kept; it stops when the validation rows' loss has not fallen for ``patience``
    rounds and returns the best round. ``validation`` is a flag column; without such rows the training rows decide."""

    def fit(tr: DataFrame) -> Perceptron:
        rows = cut(tr.select("features", "y", F.coalesce(F.col(validation), F.lit(False)).alias("__held")))
        train, held = rows.filter(~F.col("__held")), rows.filter("__held")
        held = train if held.isEmpty() else held
        net = MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=list(layers), seed=seed, maxIter=round_iter, tol=0.0)
        losses, best, kept, model = [], -1, None, None
        for n in range(max_rounds):
            model = (net if model is None else net.copy().setInitialWeights(model.weights)).fit(train)
            losses.append(log_loss_of(model.transform(held)))
            if best < 0 or losses[n] < losses[best] - least_gain:
                best, kept = n, model
            elif n - best >= patience:
                break
        return Perceptron(kept, tuple(losses), best)

    return fit


def svc(reg: float = 0.1):
    def fit(tr: DataFrame):
        return LinearSVC(featuresCol="features", labelCol="y", regParam=reg, maxIter=30).fit(tr)

    return fit


def per_label(df: DataFrame, labels: Sequence[str], fit: Callable[[DataFrame], object], keep: Sequence[str]) -> DataFrame:
    """One model per label; a label with a single value gets its constant prior."""
    rates = df.agg(*[F.avg(F.col(l).cast("double")).alias(l) for l in labels]).first()
    parts = []
    for l in labels:
        if rates[l] in (0.0, 1.0):
            parts.append(df.select(*keep, F.lit(l).alias("label"), F.lit(rates[l]).alias("score"), F.col(l).alias("y")))
            continue
        scored = fit(df.withColumn("y", F.col(l))).transform(df.withColumn("y", F.col(l)))
        parts.append(scored.select(*keep, F.lit(l).alias("label"), positive_score(scored).alias("score"), "y"))
    return reduce(DataFrame.unionByName, parts)


def random_search(df: DataFrame, estimator: Estimator, space: dict, n_iter: int, n_folds: int, seed: int = 42, at_once: int = 4) -> list[tuple[dict, float]]:
    """Sampled parameter maps cross-validated on the given fold column, best first."""
    rng = np.random.default_rng(seed)
    maps = [{estimator.getParam(p): (values[int(rng.integers(len(values)))] if isinstance(values, list) else float(values(rng)))
             for p, values in space.items()} for _ in range(n_iter)]
    judge = BinaryClassificationEvaluator(labelCol="y")

    def one(f: int, point: dict) -> float:
        model = estimator.fit(df.filter(F.col("fold") != f), point)
        return judge.evaluate(model.transform(df.filter(F.col("fold") == f)))

    # only the folds' scores are asked for, so no model is fitted to all rows
    found = side_by_side([lambda f=f, m=m: one(f, m) for m in maps for f in range(n_folds)], at_once)
    scores = np.mean(np.reshape(found, (len(maps), n_folds)), axis=1)
    named = [({p.name: v for p, v in m.items()}, float(s)) for m, s in zip(maps, scores)]
    return sorted(named, key=lambda t: -t[1])


def importances(model, columns: Sequence[str], k: int) -> list[tuple[int, str, float]]:
    v = model.featureImportances.toArray()
    top = sorted(range(len(columns)), key=lambda i: (-v[i], i))[:k]
    return [(r + 1, columns[i], float(v[i])) for r, i in enumerate(top)]


def tier_benchmark(df: DataFrame, folds: Sequence[int], members: dict[str, Callable[[DataFrame], object]]) -> DataFrame:
    """Every registered member under the same folds: AUC per member over its out-of-fold rows."""
    parts = [oof_loop(df, folds, fit, ["row_id", "y"]).withColumn("run", F.lit(name)) for name, fit in members.items()]
    return roc_auc(reduce(DataFrame.unionByName, parts), ["run"])


def stack_logistic(df: DataFrame, columns: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """Cross-fitted logistic regression over member scores."""
    vec = cut(assemble(df, columns))  # every fold reads the assembled rows
    return oof_loop(vec, folds, logistic(regParam=0.0), ["row_id", "y"])


def fold_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("fold").agg(row_count().alias("n"))
