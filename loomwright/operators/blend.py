"""Blends and ensembles over prediction tables.

Weight fits run on sufficient statistics from one aggregation; greedy selection keeps integer pick
counts per member, so every step is a fresh linear combination and no lineage builds up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import array_literal, row_count
from loomwright.operators.decide import argmax_of, tune_weights
from loomwright.operators.metrics import roc_auc
from loomwright.operators.windows import value_ranks


def mean_score(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal mean over runs (or folds, or seeds); NULL where one of them has no score."""
    return long.groupBy(*keys).agg(_if_whole(F.avg("score")).alias("score"))


def _if_whole(value: Column) -> Column:
    return F.when(F.count("score") == row_count(), value)


def weighted_score(long: DataFrame, keys: Sequence[str], weights: dict[str, float]) -> DataFrame:
    total = sum(weights.values())
    w = reduce(lambda acc, kv: F.when(F.col("run") == kv[0], F.lit(kv[1] / total)).otherwise(acc), weights.items(), F.lit(0.0))
    return long.groupBy(*keys).agg(_if_whole(F.sum(F.col("score") * w)).alias("score"))


def ranked(long: DataFrame, by: Sequence[str], kind: str = "n") -> DataFrame:
    """Scores replaced by average ranks within ``by``: rank/n, or (rank-1)/(n-1); a missing score stays missing."""
    by = list(by)
    r = value_ranks(long.filter(F.col("score").isNotNull()), by, "score")
    size = r.groupBy(*by).agg(F.sum("n").alias("size"))
    scale = F.col("rank") / F.col("size") if kind == "n" else F.try_divide(F.col("rank") - 1, (F.col("size") - 1).cast("double"))
    table = r.join(size, by).select(*by, "score", scale.alias("__r"))
    return long.join(table, [*by, "score"], "left").drop("score").withColumnRenamed("__r", "score")


def rank_blend(long: DataFrame, by: Sequence[str], keys: Sequence[str], kind: str = "n", weights: dict[str, float] | None = None) -> DataFrame:
    r = ranked(long, by, kind)
    return weighted_score(r, keys, weights) if weights else mean_score(r, keys)


def grid_weight(wide: DataFrame, a: str, b: str, y: str, n: int = 21) -> DataFrame:
    """AUC of every convex weight of two runs, one job."""
    steps = [i / (n - 1) for i in range(n)]
    tried = wide.select(y, F.explode(F.array(*[
        F.struct(F.lit(w).alias("weight"), (F.lit(w) * F.col(a) + F.lit(1.0 - w) * F.col(b)).alias("score")) for w in steps])).alias("s"))
    return roc_auc(tried.select("s.*", F.col(y).alias("y")), ["weight"])


def best_weight(grid: DataFrame) -> float:
    """First best weight of the grid."""
    return grid.agg(F.min_by("weight", F.struct(-F.col("auc"), F.col("weight"))).alias("w")).first()["w"]


# ---- greedy selection --------------------------------------------------------------------------


def combine(runs: Sequence[str], picks: dict[str, int], n_classes: int) -> list[Column]:
    """Class scores of the summed picks, from the run array columns."""
    return [
        reduce(lambda a, b: a + b, [F.get(F.col(r), F.lit(c)) * F.lit(float(k)) for r, k in picks.items() if k])
        for c in range(n_classes)
    ]


@dataclass(frozen=True)
class Ensemble:
    """Members of a blend by their number of picks, its score, and the picks in order with the score after each."""

    counts: tuple[int, ...]
    score: float = float("-inf")
    history: tuple[tuple[int, float], ...] = ()

    def grown(self) -> list[tuple[int, ...]]:
        """The counts after one more pick of each member."""
        return [tuple(n + (i == j) for i, n in enumerate(self.counts)) for j in range(len(self.counts))]

    def take(self, member: int, score: float) -> Ensemble:
        return Ensemble(self.grown()[member], score, (*self.history, (member, score)))


def gains_more_than(eps: float) -> Callable[[Ensemble, Ensemble], bool]:
    """Stop rule: go on while a pick adds more than ``eps``."""
    return lambda now, then: then.score - now.score > eps


def hillclimb(
    batch_scorer: Callable[[list[dict[str, int]]], list[float]], runs: Sequence[str], steps: int = 60,
    worthwhile: Callable[[Ensemble, Ensemble], bool] = gains_more_than(1e-7),
) -> tuple[dict[str, int], float, list[tuple[int, str, float]]]:
    """Greedy selection with repetition from the empty blend; all candidates of a step are scored in one job."""
    now = Ensemble((0,) * len(runs))
    while len(now.history) < steps:
        values = batch_scorer([{r: n for r, n in zip(runs, c) if n} for c in now.grown()])
        then = now.take(*max(enumerate(values), key=lambda v: (v[1], -v[0])))
        if now.history and not worthwhile(now, then):
            break
        now = then
    order = [(at, runs[member], score) for at, (member, score) in enumerate(now.history, 1)]
    return {r: n for r, n in zip(runs, now.counts) if n}, now.score, order


def score_picks(wide: DataFrame, runs: Sequence[str], y: str, n_classes: int, metric: Callable[[list[Column], Column], Column],
                trials: Sequence[dict[str, int]]) -> list[float]:
    """One aggregation that scores every trial; pick counts enter as one array value."""
    table = array_literal([[t.get(r, 0) for r in runs] for t in trials])
    tried = wide.select(y, *runs, F.posexplode(table).alias("trial", "w"))
    cls = [reduce(lambda a, b: a + b, [F.get(F.col(r), F.lit(c)) * F.get(F.col("w"), F.lit(i)) for i, r in enumerate(runs)]) for c in range(n_classes)]
    summed = tried.select("trial", y, *[e.alias(f"s{c}") for c, e in enumerate(cls)])
    out = summed.groupBy("trial").agg(metric([F.col(f"s{c}") for c in range(n_classes)], F.col(y)).alias("v")).collect()
    return [r["v"] for r in sorted(out, key=lambda r: r["trial"])]


def score_tuned_picks(wide: DataFrame, runs: Sequence[str], y: str, n_classes: int, trials: Sequence[dict[str, int]],
                      prior: Sequence[float], **search) -> list[float]:
    """Balanced accuracy of every trial after its own class-weight search, all searches in step."""

    def scorer(pairs):
        table = array_literal([[*[trials[i].get(r, 0) for r in runs], *w] for i, w in pairs])
        tried = wide.select(y, *runs, F.posexplode(table).alias("cand", "w"))
        cls = [
            reduce(lambda a, b: a + b, [F.get(F.col(r), F.lit(c)) * F.get(F.col("w"), F.lit(i)) for i, r in enumerate(runs)])
            * F.get(F.col("w"), F.lit(len(runs) + c)) for c in range(n_classes)]
        summed = tried.select("cand", y, *[e.alias(f"s{c}") for c, e in enumerate(cls)])
        hit = (argmax_of([F.col(f"s{c}") for c in range(n_classes)]) == F.col(y)).cast("double")
        recall = summed.groupBy("cand", y).agg(F.avg(hit).alias("recall")).collect()
        per: dict[int, list[float]] = {}
        for r in sorted(recall, key=lambda r: (r["cand"], r[y])):
            per.setdefault(r["cand"], []).append(r["recall"])
        return [sum(v) / len(v) for _, v in sorted(per.items())]

    return [s for _, s in tune_weights(scorer, prior, searches=len(trials), **search)]


# ---- fits on the Gram matrix -------------------------------------------------------------------


def gram(df: DataFrame, cols: Sequence[str], y: str, by: Sequence[str] = (), intercept: bool = False) -> dict:
    """Sufficient statistics per group: {key: (n, sum x, sum y, X'X, X'y, y'y)}."""
    m = len(cols)
    x = [F.col(c).cast("double") for c in cols]
    t = F.col(y).cast("double")
    aggs = [row_count().alias("n"), F.sum(t).alias("t"), F.sum(t * t).alias("tt")]
    aggs += [F.sum(x[i]).alias(f"x{i}") for i in range(m)] + [F.sum(x[i] * t).alias(f"xt{i}") for i in range(m)]
    aggs += [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]
    out = {}
    for r in df.groupBy(*by).agg(*aggs).collect():
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
        key = tuple(r[b] for b in by)
        out[key] = (r["n"], np.array([r[f"x{i}"] for i in range(m)]), r["t"], g, np.array([r[f"xt{i}"] for i in range(m)]), r["tt"])
    return out


def add_stats(parts) -> tuple:
    return tuple(sum(p[i] for p in parts) for i in range(6))


def nnls(g: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """min |Xw - y| with w >= 0 from X'X and X'y: active set (Lawson and Hanson 1974); m is the number of runs."""
    m = len(b)
    w, free = np.zeros(m), np.zeros(m, dtype=bool)
    scale = tol * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(30 * m):
        pull = b - g @ w
        pull[free] = -np.inf
        j = int(np.argmax(pull))
        if pull[j] <= scale:
            break
        free[j] = True
        while True:
            s = np.zeros(m)
            s[free] = np.linalg.lstsq(g[np.ix_(free, free)], b[free], rcond=None)[0]
            if s[free].min() > 0:
                w = s
                break
            low = free & (s <= 0)
            step = np.min(w[low] / (w[low] - s[low]))
            w = w + step * (s - w)
            free &= w > scale * 1e-3
            w[~free] = 0.0
            if not free.any():
                break
    return w


def nnls_weights(stats: tuple) -> list[float]:
    """Non-negative weights with sum 1; equal weights when nothing helps."""
    w = nnls(stats[3], stats[4])
    return list(w / w.sum()) if w.sum() > 0 else [1 / len(w)] * len(w)


def fold_weights(stats: dict) -> dict:
    """Per fold: weights fitted on everything but the fold (total minus own part)."""
    total = add_stats(stats.values())
    return {k[0]: nnls_weights(tuple(total[i] - s[i] for i in range(6))) for k, s in stats.items()}


def pick_by_fold(fold: str, values: dict[int, Column]) -> Column:
    return reduce(lambda acc, kv: F.when(F.col(fold) == kv[0], kv[1]).otherwise(acc), values.items(), F.lit(None).cast("double"))


def linear(cols: Sequence[str], w: Sequence[float], b: float = 0.0) -> Column:
    return reduce(lambda a, e: a + e, [F.col(c) * F.lit(float(v)) for c, v in zip(cols, w)], F.lit(float(b)))


def ridge_solve(stats: tuple, alpha: float) -> tuple[np.ndarray, float]:
    """Centred ridge: (weights, intercept)."""
    n, sx, sy, g, b, _ = stats
    mx, my = sx / n, sy / n
    w = np.linalg.solve(g - n * np.outer(mx, mx) + alpha * np.eye(len(b)), b - n * mx * my)
    return w, float(my - mx @ w)


def ridge_by_fold(df: DataFrame, cols: Sequence[str], y: str, fold: str, alphas: Sequence[float]) -> dict[int, tuple[float, list[float], float]]:
    """Per fold: alpha by leave-one-out error on the training side, then the ridge weights.

    The leave-one-out residual is e / (1 - h); all folds and alphas are summed in one pass.
    """
    m = len(cols)
    stats = gram(df, cols, y, [fold])
    total = add_stats(stats.values())
    sides = {k[0]: tuple(total[i] - s[i] for i in range(6)) for k, s in stats.items()}
    # in the eigenbasis of the centred Gram every alpha is a diagonal shrinkage
    params = []
    for f, (n, sx, sy, g, b, _) in sides.items():
        mx, my = sx / n, sy / n
        lam, vec = np.linalg.eigh(g - n * np.outer(mx, mx))
        q = vec.T @ (b - n * mx * my)
        params.append(F.struct(F.lit(f).alias("f"), F.lit(float(n)).alias("n"), F.lit(float(my)).alias("my"),
                               array_literal([*mx, *vec.T.ravel(), *lam, *q]).alias("v")))
    one = df.select(F.col(fold).alias("__fold"), F.col(y).alias("__y"), *cols, F.explode(F.array(*params)).alias("s"))
    one = one.filter(F.col("__fold") != F.col("s.f"))

    def at(i: int) -> Column:
        return F.get(F.col("s.v"), F.lit(i))

    z = [reduce(lambda a, e: a + e, [(F.col(c) - at(j)) * at(m + k * m + j) for j, c in enumerate(cols)]) for k in range(m)]
    one = one.select(F.col("s.f").alias("f"), (F.col("__y") - F.col("s.my")).alias("r"), F.col("s.n").alias("n"),
                     *[e.alias(f"z{k}") for k, e in enumerate(z)], *[at(m + m * m + k).alias(f"l{k}") for k in range(m)],
                     *[at(2 * m + m * m + k).alias(f"q{k}") for k in range(m)])
    aggs = []
    for a, alpha in enumerate(alphas):
        shrunk = [F.col(f"z{k}") / (F.col(f"l{k}") + F.lit(float(alpha))) for k in range(m)]
        fit = reduce(lambda x, e: x + e, [shrunk[k] * F.col(f"q{k}") for k in range(m)])
        h = reduce(lambda x, e: x + e, [shrunk[k] * F.col(f"z{k}") for k in range(m)], 1 / F.col("n"))
        e = (F.col("r") - fit) / (1 - h)
        aggs.append(F.sum(e * e).alias(f"a{a}"))
    loss = {r["f"]: r for r in one.groupBy("f").agg(*aggs).collect()}
    out = {}
    for f, side in sides.items():
        a = min(range(len(alphas)), key=lambda i: loss[f][f"a{i}"])
        w, b = ridge_solve(side, alphas[a])
        out[f] = (alphas[a], list(w), b)
    return out


# ---- alignment and selection -------------------------------------------------------------------


def swap_average(ab, ba, order: Sequence[int]) -> Column:
    """Mean of the (A,B) scores and the (B,A) scores with their class columns swapped back."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (ab, ba))
    return F.array(*[(F.get(a, F.lit(i)) + F.get(b, F.lit(j))) / 2 for i, j in enumerate(order)])


def align_classes(scores: DataFrame, names: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """(row, class name, score) to canonical codes, classes a run never saw at 0."""
    wide = scores.groupBy(id_col).pivot("class", list(names)).agg(F.sum("score"))
    full = F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names])
    return wide.select(id_col, F.posexplode(full).alias("code", "score"))


def pick_best(board: DataFrame, name: str, score: str) -> DataFrame:
    return board.agg(F.min_by(name, F.struct(-F.col(score), F.col(name))).alias(name), F.max(score).alias(score))


def available_members(long: DataFrame, n_rows: int) -> DataFrame:
    """Runs with a finite score for every row."""
    ok = F.count_if(F.col("score").isNotNull() & ~F.isnan("score"))
    return long.groupBy("run").agg(ok.alias("n_scored"), row_count().alias("n_rows")).withColumn(
        "usable", (F.col("n_scored") == n_rows) & (F.col("n_rows") == n_rows))
