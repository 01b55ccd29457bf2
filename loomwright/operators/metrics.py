"""Metrics as distributed aggregations over (keys..., row_id, y, score); every run in one job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.expr import clip, clip_low, col, first_max_index, row_count, safe_div
from loomwright.operators.windows import average_rank, cumulative_hits, score_counts
from loomwright.plans.scan import running

EPS = 1e-15


def roc_auc(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Rank-sum AUC on score-grouped counts, ties averaged; one-class groups give NULL."""
    keys = list(keys)
    counts = score_counts(df, keys, score, y)
    cum = running(counts, keys, [F.col(score)], sums={"cum": F.col("n")})
    sums = cum.groupBy(*keys).agg(
        F.sum("pos").alias("P"), F.sum("n").alias("T"),
        F.sum(F.col("pos") * (F.col("cum") - (F.col("n") - 1) / 2.0)).alias("R"))
    p, n = F.col("P").cast("double"), (F.col("T") - F.col("P")).cast("double")
    return sums.select(*keys, F.try_divide(F.col("R") - p * (p + 1) / 2.0, p * n).alias("auc"))


def average_precision(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    hits = cumulative_hits(df, keys, score, y)
    step = F.col("pos") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    return hits.groupBy(*keys).agg(F.try_divide(F.sum(step), F.sum("pos").cast("double")).alias("ap"))


def pr_curve(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Precision and recall at every distinct threshold."""
    hits = cumulative_hits(df, keys, score, y)
    total = df.groupBy(*keys).agg(F.sum(F.col(y).cast("long")).alias("P"))
    joined = hits.join(total, list(keys)) if keys else hits.withColumn("P", F.lit(total.first()["P"]))
    return joined.select(
        *keys, F.col(score).alias("threshold"), safe_div("tp", F.col("tp") + F.col("fp")).alias("precision"),
        safe_div("tp", "P").alias("recall"), "tp", "fp", "P")


def log_loss_term(score, y) -> Column:
    p = clip(score, EPS, 1 - EPS)
    return -F.log(F.when(col(y) == 1, p).otherwise(1 - p))


def log_loss(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(log_loss_term(score, y)).alias("log_loss"))


def true_class_probability(p, y) -> Column:
    """Probability of the true class after row normalisation."""
    total = F.aggregate(col(p), F.lit(0.0), lambda a, x: a + x)
    return F.get(col(p), col(y)) / total


def log_loss_multi(df: DataFrame, n_classes: int, p: str = "p", y: str = "y") -> DataFrame:
    """Multiclass log loss beside the prior and the uniform predictor."""
    loss = df.agg(F.avg(-F.log(clip(true_class_probability(p, y), EPS, 1.0))).alias("log_loss"))
    counts = df.groupBy(y).agg(row_count().alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # one row per class
    prior = counts.select(share.alias("s")).agg(F.sum(-F.col("s") * F.log("s")).alias("v")).first()["v"]
    return loss.select("log_loss", F.lit(prior).alias("prior_log_loss"), F.log(F.lit(float(n_classes))).alias("uniform_log_loss"))


def brier(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    e = F.col(score) - F.col(y)
    return df.groupBy(*keys).agg(F.avg(e * e).alias("brier"))


def rmse(actual, predicted) -> Column:
    e = col(actual) - col(predicted)
    return F.sqrt(F.avg(e * e))


def rmsle(actual, predicted) -> Column:
    return rmse(F.log1p(col(actual)), F.log1p(clip_low(predicted, 0.0)))


def accuracy(actual, predicted) -> Column:
    return F.avg((col(actual) == col(predicted)).cast("double"))


def recall_by_class(df: DataFrame, predicted: str, y: str = "y") -> DataFrame:
    return df.groupBy(y).agg(accuracy(y, predicted).alias("recall"), row_count().alias("support"))


def balanced_accuracy(df: DataFrame, predicted: str, y: str = "y") -> DataFrame:
    return recall_by_class(df, predicted, y).agg(F.avg("recall").alias("balanced_accuracy"))


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, y: str = "y") -> DataFrame:
    hit, pos = predicted == 1, F.col(y) == 1
    return df.groupBy(*keys).agg(
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))


def f1_binary(df: DataFrame, keys: Sequence[str], predicted: Column, y: str = "y") -> DataFrame:
    c = confusion(df, keys, predicted, y)
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return c.select(
        *keys, F.coalesce(safe_div(tp, tp + fp), zero).alias("precision"), F.coalesce(safe_div(tp, tp + fn), zero).alias("recall"),
        F.coalesce(safe_div(2 * tp, 2 * tp + fp + fn), zero).alias("f1"), safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def f1_by_class(df: DataFrame, predicted: str, y: str = "y") -> DataFrame:
    """Per-class F1 from one (truth, prediction) count table."""
    cell = df.groupBy(F.col(y).alias("t"), F.col(predicted).alias("q")).agg(row_count().alias("n"))
    side = cell.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("q").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("s")).select("s.*")
    per = side.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    return per.select("class", "support", F.coalesce(safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"))


def f1_macro(df: DataFrame, predicted: str, y: str = "y") -> DataFrame:
    return f1_by_class(df, predicted, y).agg(F.avg("f1").alias("f1_macro"))


def true_rank(scores: Sequence[Column], y) -> Column:
    """Rank of the true class, ties by class code, without sorting the row."""
    y = col(y)
    own = reduce(lambda acc, ic: F.when(y == ic[0], ic[1]).otherwise(acc), enumerate(scores), F.lit(None).cast("double"))
    better = [F.when((s > own) | ((s == own) & (F.lit(i) < y)), 1).otherwise(0) for i, s in enumerate(scores)]
    return reduce(lambda a, b: a + b, better, F.lit(1))


def mapk(scores: Sequence[Column], y, k: int = 3) -> Column:
    """Mean of 1/rank of the one true label within the top k."""
    r = true_rank(scores, y)
    return F.avg(F.when(r <= k, F.lit(1.0) / r).otherwise(F.lit(0.0)))


def class_scores(p: str, n_classes: int) -> list[Column]:
    return [F.get(F.col(p), F.lit(c)) for c in range(n_classes)]


def flatten(df: DataFrame, p: str = "p", y: str = "y", id_col: str = "row_id") -> DataFrame:
    """Probability matrix to (row_id, class, score, y 0/1)."""
    long = df.select(id_col, F.col(y).alias("__y"), F.posexplode(p).alias("class", "score"))
    return long.select(id_col, "class", "score", (F.col("__y") == F.col("class")).cast("int").alias("y"))


def pooled_auc(flat: DataFrame) -> DataFrame:
    return roc_auc(flat, [])


def macro_auc(flat: DataFrame) -> DataFrame:
    """Mean of the per-class AUCs; classes with a single label value are skipped."""
    per = roc_auc(flat, ["class"])
    return per.agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_classes"))


def pooled_auc_ranknorm(flat: DataFrame) -> DataFrame:
    ranked = average_rank(flat, ["class"], "score", "rank")
    return roc_auc(ranked.select("class", "y", F.col("rank").alias("score")), [])


def fold_summary(df: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Per-fold AUC condensed to mean, population deviation, min and max."""
    per = roc_auc(df, [*keys, fold])
    return per.groupBy(*keys).agg(
        F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.min("auc").alias("worst"), F.max("auc").alias("best"))


def covered_only(labels: DataFrame, preds: DataFrame, id_col: str) -> DataFrame:
    """F1 on rows that have a prediction, with the share covered."""
    j = labels.join(preds, id_col, "left")
    cover = j.agg(F.avg(F.col("label").isNotNull().cast("double"))).first()[0]
    return f1_binary(j.filter("label is not null"), [], F.col("label")).withColumn("coverage", F.lit(cover))


def leaderboard(scores: DataFrame, run: str = "run", score: str = "auc") -> DataFrame:
    """Runs by score with the distance to the best one (one row per run)."""
    best = F.max(score).over(Window.partitionBy())
    return scores.select(run, score, (F.col(score) - best).alias("delta")).orderBy(F.desc(score), run)


def argmax(p: str = "p") -> Column:
    return first_max_index(p)
