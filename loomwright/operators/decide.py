"""Decision rules: thresholds, class weights, votes and routing."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import array_literal, col, first_max_index, flag, row_count, safe_div
from loomwright.operators.metrics import pr_curve
from loomwright.operators.windows import cumulative_hits
from loomwright.plans.scan import lookback_windows


def threshold_f1(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Best-F1 threshold over 0, the midpoints of neighbouring scores, and 1; the lowest wins ties.

    One cumulative pass gives every candidate its counts, instead of one scan per candidate.
    """
    keys = list(keys)
    hits = cumulative_hits(df, keys, score, y)
    total = df.groupBy(*keys).agg(F.sum(F.col(y).cast("long")).alias("P"))
    # rows with score >= this distinct score are the positives of the midpoint just below it
    pairs = lookback_windows(hits, keys, [F.col(score)], 1, lambda w: {"below": F.lag(score).over(w)})
    s = F.col(score)
    nothing = F.lit(0).cast("long")
    options = pairs.select(*keys, F.explode(F.array(
        F.struct(F.when(F.col("below").isNull(), F.lit(0.0)).otherwise((s + F.col("below")) / 2).alias("threshold"),
                 F.col("tp").alias("tp"), F.col("fp").alias("fp")),
        # threshold 1 keeps only scores of at least 1
        F.struct(F.lit(1.0).alias("threshold"), F.when(s >= 1, F.col("tp")).otherwise(nothing).alias("tp"),
                 F.when(s >= 1, F.col("fp")).otherwise(nothing).alias("fp")),
    )).alias("o")).select(*keys, "o.*")
    counts = options.groupBy(*keys, "threshold").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    f1 = F.coalesce(safe_div(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")), F.lit(0.0))
    scored = counts.join(total, keys) if keys else counts.withColumn("P", F.lit(total.first()["P"]))
    scored = scored.withColumn("f1", f1)
    best = F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")
    return scored.groupBy(*keys).agg(best).select(*keys, "b.threshold", "b.f1")


def threshold_pr(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Max-F1 threshold among the observed scores, the lowest one on ties."""
    c = pr_curve(df, keys, score, y)
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-12))
    best = F.min_by(F.struct("threshold", f1.alias("f1")), F.struct(-f1, F.col("threshold"))).alias("b")
    return c.groupBy(*keys).agg(best).select(*keys, "b.threshold", "b.f1")


def precision_floor(df: DataFrame, keys: Sequence[str], floor: float, score: str = "score", y: str = "y") -> DataFrame:
    """Highest recall with precision at or above the floor; no such threshold is an error."""
    c = pr_curve(df, keys, score, y)
    ok = F.col("precision") >= floor
    pick = F.struct("threshold", "precision", "recall")
    best = F.min_by(F.when(ok, pick), F.when(ok, F.struct(-F.col("recall"), F.col("threshold")))).alias("b")
    out = c.groupBy(*keys).agg(best, F.max("precision").alias("top"))
    err = F.raise_error(F.concat(F.lit(f"no threshold reaches precision {floor}; the highest is "), F.col("top").cast("string")))
    return out.select(*keys, F.when(F.col("b").isNotNull(), F.col("b.threshold")).otherwise(err.cast("double")).alias("threshold"),
                      "b.precision", "b.recall")


def apply_threshold(score, t) -> Column:
    return (col(score) >= t).cast("int")


def weighted_argmax(p, weights: Sequence[float]) -> Column:
    return first_max_index(F.zip_with(col(p), F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b))


def prior_corrected(df: DataFrame, bins: str, y: str, n_classes: int) -> DataFrame:
    """Per bin: argmax of P(class | bin) / P(class), missing bins as their own bin."""
    table = df.groupBy(F.coalesce(F.col(bins), F.lit(-1)).alias("bin")).agg(
        row_count().alias("n"), *[F.count_if(F.col(y) == c).alias(f"s{c}") for c in range(n_classes)])
    total = df.agg(*[F.count_if(F.col(y) == c).alias(f"s{c}") for c in range(n_classes)]).first()
    n = sum(total)
    lift = F.array(*[
        (F.col(f"s{c}") + 1e-9) / (F.col("n") + n_classes * 1e-9) / F.lit(total[c] / n) for c in range(n_classes)])
    return table.select("bin", "n", first_max_index(lift).alias("label"))


# ---- class-weight search -----------------------------------------------------------------------


def argmax_of(scores: Sequence[Column]) -> Column:
    """First index of the largest of a few columns, inside whole-stage codegen."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(len(scores) - 1)
    for i in range(len(scores) - 2, -1, -1):
        out = F.when(scores[i] == top, F.lit(i)).otherwise(out)
    return out


def balanced_accuracy_of(pred: Column, y: Column, classes: Sequence[int]) -> Column:
    """Balanced accuracy as one aggregate expression over the classes that occur."""
    parts = [F.try_divide(F.count_if((y == c) & (pred == c)).cast("double"), F.count_if(y == c)) for c in classes]
    return reduce(lambda a, b: a + b, parts) / len(parts)


def score_weights(df: DataFrame, cols: Sequence[str], y: str, candidates: Sequence[Sequence[float]]) -> list[float]:
    """Balanced accuracy of every candidate weight vector, all in one aggregation job.

    The weights enter as one array value, so the compiled plan is the same for every call.
    """
    table = array_literal([list(c) for c in candidates])
    tried = df.select(y, *cols, F.posexplode(table).alias("cand", "w"))
    pred = argmax_of([F.col(c) * F.get(F.col("w"), F.lit(i)) for i, c in enumerate(cols)])
    recall = tried.groupBy("cand", y).agg(F.avg((pred == F.col(y)).cast("double")).alias("recall")).collect()
    by_cand: dict[int, list[float]] = {}
    for r in sorted(recall, key=lambda r: (r["cand"], r[y])):
        by_cand.setdefault(r["cand"], []).append(r["recall"])
    return [sum(v) / len(v) for _, v in sorted(by_cand.items())]


# scores a batch of (search, weights) pairs; several searches advance together, one job per step
Scorer = Callable[[list[tuple[int, list[float]]]], list[float]]


def _ascend(starts: list[list[float]], scorer: Scorer, grids, norm) -> list[tuple[list[float], float]]:
    best_w = list(starts)
    best = scorer(list(enumerate(starts)))
    for grid in grids:
        for j in range(len(starts[0])):
            pairs = []
            for i, w in enumerate(best_w):
                for v in grid(w[j]):
                    cand = list(w)
                    cand[j] = v
                    pairs.append((i, norm(cand)))
            # strict improvement and first candidate wins, as in a sequential scan
            for (i, cand), s in zip(pairs, scorer(pairs)):
                if s > best[i]:
                    best[i], best_w[i] = s, cand
    return list(zip(best_w, best))


def tune_weights(
    scorer: Scorer, prior: Sequence[float], rounds: int = 6, grid: int = 21, span: float = 2.0, searches: int = 1
) -> list[tuple[list[float], float]]:
    """Coordinate ascent from inverse-prior weights on a shrinking multiplicative grid; mean weight 1."""

    def norm(w):
        m = sum(w) / len(w)
        return [x / m for x in w]

    def level(r):
        width = math.log(span) * 0.5**r
        steps = [-width + 2 * width * i / (grid - 1) for i in range(grid)]
        return lambda base: [base * math.exp(s) for s in steps]

    start = norm([1.0 / max(p, 1e-9) for p in prior])
    return _ascend([start] * searches, scorer, [level(r) for r in range(rounds)], norm)


def tune_weights_geo(scorer: Scorer, n_classes: int, rounds: int = 4, grid: int = 41) -> list[tuple[list[float], float]]:
    """The same ascent from equal weights over a geometric grid; weights sum to 1."""

    def norm(w):
        t = sum(w)
        return [x / t for x in w]

    def level(r):
        s = 0.5**r

        def points(base):
            lo, hi = max(1e-3, base / (1 + s)), base * (1 + s)
            return [lo * (hi / lo) ** (i / (grid - 1)) for i in range(grid)]

        return points

    return _ascend([[1.0] * n_classes], scorer, [level(r) for r in range(rounds)], norm)


# ---- votes, routing, label repair --------------------------------------------------------------


def majority_vote(first, second, third) -> Column:
    """Vote of three where the first two disagree; a missing third vote sides with the first."""
    a, b, c = col(first), col(second), F.coalesce(col(third), col(first))
    return F.when(a != b, ((a + b + c) >= 2).cast("int")).otherwise(a)


def ambiguous(df: DataFrame, first: str, second: str) -> DataFrame:
    """The only rows a third vote can change."""
    return df.filter(F.col(first) != F.col(second))


def route(df: DataFrame, answers: DataFrame, id_col: str, first: str, second: str) -> DataFrame:
    j = df.join(answers.select(id_col, F.col("answer")), id_col, "left")
    return j.withColumn("routed", majority_vote(first, second, "answer")).withColumn("is_ambiguous", flag(F.col(first) != F.col(second)))


def repair_conflicts(df: DataFrame, text: str, label: str) -> DataFrame:
    """Duplicate texts with conflicting labels take the majority label, a tie becomes 0; rows without text keep theirs.

    Texts are told apart by their SHA-256, so that votes and join move digests.
    """
    keyed = df.withColumn("__k", F.sha2(F.col(text).cast("binary"), 256))
    vote = F.avg(F.col(label).cast("double"))
    majority = (keyed.filter("__k is not null").groupBy("__k").agg(vote.alias("__m"))
                .filter("__m > 0 and __m < 1").select("__k", (F.col("__m") > 0.5).cast("int").alias("__v")))
    return keyed.join(majority, "__k", "left").withColumn(label, F.coalesce("__v", label)).drop("__k", "__v")


def hierarchical(p1, p2) -> tuple[Column, Column, Column]:
    """Low, medium and high probability from a two-stage split."""
    p1, p2 = col(p1), col(p2)
    return p1, (1 - p1) * (1 - p2), (1 - p1) * p2


def route_rest(df: DataFrame, p1: str) -> DataFrame:
    return df.filter(F.col(p1) < 0.5)


def ovr_normalise(p) -> Column:
    total = F.aggregate(col(p), F.lit(0.0), lambda a, x: a + x)
    return F.transform(col(p), lambda x: F.try_divide(x, total))
