"""Column and label profiles. Each report is one or two aggregations; only small tables reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.expr import right_closed_bin, row_count, safe_div
from loomwright.operators.missing import sample_skew
from loomwright.plans.quantile import column_quantiles, group_quantiles


def by_column(df: DataFrame, columns: Sequence[str], stats) -> DataFrame:
    """One scan, one output row per column; ``stats(name)`` gives the named aggregates."""
    rows = [F.struct(F.lit(c).alias("column"), *[e.alias(n) for n, e in stats(c).items()]) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), kind: str = "double") -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])).alias("s")).select(*keep, "s.*")


def missing(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """Missing count and share per column, train against test, with the column kind."""
    kinds = dict(df.dtypes)

    def stats(c):
        out = {"kind": F.lit("categorical" if kinds[c] == "string" else "numeric")}
        for s in ("train", "test"):
            here = F.col(split) == s
            n = F.count_if(here & F.col(c).isNull())
            out[f"{s}_missing"] = n
            out[f"{s}_percent"] = safe_div(n * 100, F.count_if(here))
        return out

    return by_column(df, columns, stats)


def missing_shift(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    m = missing(df, columns, split)
    return m.select("column", (F.abs(F.col("train_percent") - F.col("test_percent")) / 100).alias("shift"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    return by_column(df, columns, lambda c: {
        "count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(F.col(c).cast("double")),
        "q1": F.lit(q[c][0]), "median": F.lit(q[c][1]), "q3": F.lit(q[c][2]), "max": F.max(F.col(c).cast("double"))})


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def skew_kurt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return by_column(df, columns, lambda c: {
        "skew": sample_skew(F.col(c)), "kurt": sample_kurtosis(F.col(c)), "log_skew": sample_skew(F.log1p(c))})


def skew_flag(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    s = by_column(df, columns, lambda c: {"skew": F.skewness(c)})
    size = F.abs("skew")
    return s.withColumn("flag", F.when(size > 1, "high").when(size > 0.5, "moderate").otherwise("symmetric"))


def cardinality(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """Distinct levels per column and split, without and with the missing level."""
    lv = long_values(df, columns, [split], "string").distinct()
    return lv.groupBy("column", split).agg(F.count("value").alias("n_levels"), row_count().alias("n_with_missing"))


def value_counts(df: DataFrame, column: str, with_missing: bool = True) -> DataFrame:
    rows = df if with_missing else df.filter(F.col(column).isNotNull())
    n = rows.groupBy(column).agg(row_count().alias("n"))
    total = rows.count()
    return n.withColumn("share", F.col("n") / F.lit(total))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(label).agg(row_count().alias("n"))
    every = Window.partitionBy()  # one row per class
    return c.select(label, "n", (F.col("n") / F.sum("n").over(every)).alias("share"),
                    (F.max("n").over(every) / F.min("n").over(every)).alias("imbalance"))


def corr_target(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    return by_column(df, columns, lambda c: {"r": F.corr(c, y)}).orderBy(F.abs("r").desc())


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations, one aggregation."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
             for i, a in enumerate(columns) for b in columns[i + 1:]]
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def point_biserial(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Correlation with a 0/1 target, its t value and two-sided p-value: one row a column."""
    r = by_column(df, columns, lambda c: {"r": F.corr(c, y), "n": F.count(F.when(F.col(y).isNotNull(), F.col(c)))})
    t = r.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(a) or m < 3 else t_two_sided_p(a, m - 2) for a, m in zip(t.astype(float), n)], dtype=float)

    return t.withColumn("p", p_value("t", "n"))


def rate_by_level(df: DataFrame, columns: Sequence[str], y: Column) -> DataFrame:
    """Target mean by level, and the spread between levels of the column."""
    lv = long_values(df.withColumn("__y", y), columns, ["__y"], "string")
    per = lv.groupBy("column", "value").agg(F.avg("__y").alias("rate"), row_count().alias("n"))
    spread = per.groupBy("column").agg((F.max("rate") - F.min("rate")).alias("spread"))
    return per.join(spread, "column")


def median_by_level(df: DataFrame, level: str, y: str) -> DataFrame:
    return group_quantiles(df, [level], y, {"median": 0.5})


def class_means_z(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Per-class means, standardised across the classes (one row per class)."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
    every = Window.partitionBy()
    return means.select(label, *[
        F.try_divide(F.col(c) - F.avg(c).over(every), F.stddev_samp(c).over(every)).alias(c) for c in columns])


def binned(df: DataFrame, columns: Sequence[str], q: int = 10) -> DataFrame:
    """Numeric columns to right-closed equal-frequency bins."""
    edges = column_quantiles(df, columns, [i / q for i in range(1, q)])
    return df.withColumns({c: right_closed_bin(c, sorted(set(edges[c]))) for c in columns})


def mutual_info(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Mutual information with the target in nats, from joint counts of discrete columns."""
    lv = long_values(df, columns, [y], "string").withColumn("value", F.coalesce("value", F.lit("<MISSING>")))
    cell = lv.groupBy("column", "value", y).agg(row_count().alias("n"))
    x = cell.groupBy("column", "value").agg(F.sum("n").alias("nx"))
    t = cell.groupBy("column", y).agg(F.sum("n").alias("ny"))
    total = cell.groupBy("column").agg(F.sum("n").alias("size"))
    j = cell.join(x, ["column", "value"]).join(t, ["column", y]).join(total, "column")
    p = F.col("n") / F.col("size")
    return j.groupBy("column").agg(F.sum(p * F.log(F.col("n") * F.col("size") / (F.col("nx") * F.col("ny")))).alias("mi"))


def level_means(df: DataFrame, level: str, y: str, out: str) -> DataFrame:
    per = df.groupBy(level).agg(F.avg(y).alias(out))
    return df.join(per, level, "left")


def equal_width_bin(x: str, lo: float, hi: float, bins: int) -> Column:
    """Right-closed equal-width bins, the lowest value included in the first."""
    width = (hi - lo) / bins
    return right_closed_bin(x, [lo + width * i for i in range(1, bins)])


def bucket_map3(table: DataFrame, bucket: str, n_classes: int) -> DataFrame:
    """MAP@3 of ranking classes by their share in the bucket, from (bucket, n, s0..) counts alone."""
    long = table.select(bucket, F.posexplode(F.array(*[F.col(f"s{c}") for c in range(n_classes)])).alias("c", "s"))
    w = Window.partitionBy(bucket).orderBy(F.desc("s"), "c")  # n_classes rows per bucket
    r = long.withColumn("rk", F.row_number().over(w))
    gain = F.when(F.col("rk") <= 3, F.col("s") / F.col("rk")).otherwise(0.0)
    return r.agg((F.sum(gain) / F.sum("s")).alias("map3"))


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    q = column_quantiles(df, columns, [0.25, 0.75, 0.99])

    def stats(c):
        q1, q3, p99 = q[c]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        out = F.count_if((F.col(c) < lo) | (F.col(c) > hi))
        return {"lo": F.lit(lo), "hi": F.lit(hi), "p99": F.lit(p99), "n_outliers": out, "percent": safe_div(out * 100, F.count(c))}

    return by_column(df, columns, stats)


def sentinels(df: DataFrame, listed: dict[str, Sequence]) -> DataFrame:
    """Counts of listed sentinel values per column, one scan."""
    cells = [F.struct(F.lit(c).alias("column"), F.lit(str(v)).alias("sentinel"), F.count_if(F.col(c) == v).alias("n"))
             for c, vs in listed.items() for v in vs]
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = df.groupBy(*keys).agg(row_count().alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), row_count().alias("n_distinct"), F.sum(F.col("n") - 1).alias("n_surplus"),
                   F.count_if(F.col("n") > 1).alias("n_groups"))


def label_conflicts(df: DataFrame, vector: Sequence[str], label: str) -> DataFrame:
    """Feature vectors seen with more than one label, and the rows they cover."""
    cell = df.groupBy(*vector, label).agg(row_count().alias("n"))
    per = cell.groupBy(*vector).agg(F.count(label).alias("labels"), F.sum("n").alias("n"))
    return per.agg(row_count().alias("n_vectors"), F.count_if(F.col("labels") > 1).alias("n_conflicting"),
                   F.coalesce(F.sum(F.when(F.col("labels") > 1, F.col("n"))), F.lit(0)).alias("rows_covered"))


def missing_informative(df: DataFrame, columns: Sequence[str], y: str, classes: Sequence[int]) -> DataFrame:
    """P(class | missing) - P(class) per column."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("class"),
                 (safe_div(F.count_if(F.col(c).isNull() & (F.col(y) == k)), F.count_if(F.col(c).isNull()))
                  - safe_div(F.count_if(F.col(y) == k), row_count())).alias("lift"))
        for c in columns for k in classes]
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def missing_by_group(df: DataFrame, keys: Sequence[Column], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(column).isNull().cast("double")).alias("missing_rate"), row_count().alias("n"))


def structural_missing(df: DataFrame, governing: str, column: str) -> DataFrame:
    return df.groupBy(governing).agg(F.avg(F.col(column).isNull().cast("double")).alias("missing_share"),
                                     F.avg(column).alias("mean"), row_count().alias("n"))


def semantic_none(df: DataFrame, levels: dict[str, Sequence[str]], near_zero: dict[str, float]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isin(list(v)).cast("double")).alias("share")) for c, v in levels.items()]
    cells += [F.struct(F.lit(c).alias("column"), F.avg((F.col(c) < t).cast("double")).alias("share")) for c, t in near_zero.items()]
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def rate_by(df: DataFrame, keys: dict[str, Column], y: Column) -> DataFrame:
    """Target rate by each time part, long form, one shuffle."""
    long = df.select(y.alias("y"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("part"), e.cast("int").alias("value")) for n, e in keys.items()])).alias("s")).select("y", "s.*")
    return long.groupBy("part", "value").agg(F.avg("y").alias("rate"), row_count().alias("n"))


def near_zero_variance(df: DataFrame, array: str, limit: float = 1e-8) -> DataFrame:
    cells = df.select(F.posexplode(array).alias("position", "x"))
    v = cells.groupBy("position").agg(F.var_pop("x").alias("variance"))
    return v.withColumn("near_zero", F.col("variance") < limit)


def pca_scree(df: DataFrame, array: str, shares: Sequence[float] = (0.9, 0.95)) -> tuple[np.ndarray, dict[float, int]]:
    """Explained variance of the z-scored columns: distributed correlation matrix, small eigen-solve."""
    vec = df.select(array_to_vector(F.col(array).cast("array<double>")).alias("v"))
    m = Correlation.corr(vec, "v").first()[0].toArray()
    lam = np.sort(np.linalg.eigvalsh(m))[::-1]
    cum = np.cumsum(lam) / lam.sum()
    return cum, {s: int(np.argmax(cum >= s)) + 1 for s in shares}


def histogram(df: DataFrame, column: str, by: Sequence[str], lo: float, width: float) -> DataFrame:
    b = F.floor((F.col(column) - lo) / width).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(row_count().alias("n"))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + num * d) or tiny)
        c = (1.0 + num / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p-value of a t statistic."""
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))
