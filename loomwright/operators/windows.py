"""Per-entity ordered windows, group transforms and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import row_count
from loomwright.plans.quantile import group_quantiles
from loomwright.plans.scan import chunk_edges, lookback_windows, running
from loomwright.plans.store import cut


def lags(df: DataFrame, key: str, ts: str, value: str, steps: Sequence[int]) -> DataFrame:
    return lookback_windows(
        df, [key], [F.col(ts)], max(steps), lambda w: {f"lag_{k}": F.lag(value, k).over(w) for k in steps})


def add_diffs(df: DataFrame, value: str, steps: Sequence[int]) -> DataFrame:
    return df.withColumns({
        **{f"diff_{k}": F.col(value) - F.col(f"lag_{k}") for k in steps},
        **{f"absdiff_{k}": F.abs(F.col(value) - F.col(f"lag_{k}")) for k in steps},
    })


def rolling(df: DataFrame, key: str, ts: str, value: str, width: int, min_periods: int, eps: float = 1e-6) -> DataFrame:
    """Mean, sample deviation and z-score against the previous ``width`` rows."""

    def build(w):
        frame = w.rowsBetween(-width, -1)
        seen = F.count(value).over(frame) >= min_periods
        return {"roll_mean": F.when(seen, F.avg(value).over(frame)), "roll_std": F.when(seen, F.stddev_samp(value).over(frame))}

    out = lookback_windows(df, [key], [F.col(ts)], width, build)
    return out.withColumn("roll_z", (F.col(value) - F.col("roll_mean")) / (F.col("roll_std") + eps))


def flatline_run(df: DataFrame, key: str, ts: str, value: Column, out: str = "run") -> DataFrame:
    """Length so far of the current run of equal values; a run of missing values counts as constant.

    position - (latest position where the value changed) + 1, both as running aggregates.
    """
    order = [F.col(ts)]
    hot = chunk_edges(df, [key], order)
    marked = lookback_windows(
        df.withColumn("__v", value), [key], order, 1,
        lambda w: {"__change": F.lag(F.lit(1)).over(w).isNull() | ~F.col("__v").eqNullSafe(F.lag("__v").over(w))},
        hot=hot)
    placed = running(marked, [key], order, sums={"__p": F.lit(1).cast("long")}, hot=hot)
    last = running(placed, [key], order, maxes={"__s": F.when(F.col("__change"), F.col("__p"))}, hot=hot)
    return last.withColumn(out, (F.col("__p") - F.col("__s") + 1).cast("int")).drop("__v", "__change", "__p", "__s")


def group_transform(df: DataFrame, key: str, value: str, median: bool = False) -> DataFrame:
    """Group size, sum, mean (and median) on every row: pre-aggregated, then joined back."""
    stats = df.groupBy(key).agg(row_count().alias("group_size"), F.sum(value).alias("group_sum"),
                                F.try_divide(F.sum(value).cast("double"), F.count(value)).alias("group_mean"))
    if median:
        stats = stats.join(group_quantiles(df, [key], value, {"group_median": 0.5}), key)
    return df.join(stats, key, "left")


def group_nunique(df: DataFrame, keys: Sequence[str], label: str, out: str = "n_labels") -> DataFrame:
    """Distinct labels of the row's feature vector, on every row."""
    per = df.select(*keys, label).distinct().groupBy(*keys).agg(F.count(label).alias(out))
    return df.join(per, list(keys), "left")


def token_count(df: DataFrame, text: str, out: str) -> DataFrame:
    """Rows sharing the last whitespace token; a missing text counts zero."""
    tok = df.withColumn("__t", F.element_at(F.split(F.trim(F.col(text)), r"\s+"), -1))
    per = tok.filter("__t is not null").groupBy("__t").agg(row_count().alias(out))
    return tok.join(per, "__t", "left").withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("__t")


def joint_group_stats(train: DataFrame, test: DataFrame, key: str, value: str) -> DataFrame:
    """Group statistics over train and test together, rows keep their split."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
    return group_transform(both, key, value)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average rank of every distinct value: (keys, value, n, rank, size).

    Counts per value are scanned in value order, so nothing as large as the rows is ever sorted in one task.
    """
    keys = list(keys)
    counts = cut(df.groupBy(*keys, value).agg(row_count().alias("n")))
    cum = running(counts, keys, [F.col(value)], sums={"__cum": F.col("n")})
    return cum.withColumn("rank", F.col("__cum") - (F.col("n") - 1) / 2.0).drop("__cum")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average rank with ties on every row."""
    keys = list(keys)
    ranks = value_ranks(df, keys, value).select(*keys, value, F.col("rank").alias(out))
    return df.join(ranks, [*keys, value], "left")


def score_counts(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    """Positives and rows per distinct score, written once: the size check and the scan both read it."""
    return cut(df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("pos"), row_count().alias("n")))


def cumulative_hits(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    """Cumulative true and false positives by descending score, one row per distinct score."""
    keys, s = list(keys), F.col(score)
    counts = score_counts(df, keys, score, y)
    return running(counts, keys, [s.desc()], by=[s.isNull(), ~F.isnan(s.cast("double")), -s],
                   sums={"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")})
