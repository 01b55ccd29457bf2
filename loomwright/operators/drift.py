"""Distribution shift between two splits of one frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import right_closed_bin, row_count
from loomwright.operators.profile import by_column, long_values
from loomwright.plans.quantile import column_quantiles
from loomwright.plans.scan import running


def kolmogorov_p(lam: Column, terms: int = 20) -> Column:
    """Asymptotic two-sample p-value, 2 * sum (-1)^(k-1) exp(-2 k^2 lambda^2), within [0, 1]."""
    s = reduce(lambda a, b: a + b, [F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam) for k in range(1, terms + 1)])
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))


def ks(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """Two-sample statistic: largest gap of cumulative shares over value counts."""
    v = long_values(df, columns, [split]).filter(F.col("value").isNotNull())
    cells = v.groupBy("column", "value").agg(F.count_if(F.col(split) == "train").alias("a"), F.count_if(F.col(split) == "test").alias("b"))
    cum = running(cells, ["column"], [F.col("value")], sums={"ca": F.col("a"), "cb": F.col("b")})
    total = cells.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    out = cum.join(total, "column").groupBy("column").agg(F.max(gap).alias("ks"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    lam = F.col("ks") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    return out.select("column", "ks", kolmogorov_p(lam).alias("p_value"))


def psi(df: DataFrame, columns: Sequence[str], split: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability over train quantile bins, open at both ends, shares floored."""
    train = df.filter(F.col(split) == "train")
    q = column_quantiles(train, columns, [i / bins for i in range(bins + 1)])
    edges = {c: sorted(set(v))[1:-1] for c, v in q.items()}
    cells = []
    for c in columns:
        b = right_closed_bin(c, edges[c])
        cells.append(F.struct(F.lit(c).alias("column"), b.alias("bin")))
    sized = df.select(split, F.explode(F.array(*cells)).alias("s")).select(split, "s.*").filter(F.col("bin").isNotNull())
    n = sized.groupBy("column", "bin").agg(F.count_if(F.col(split) == "train").alias("a"), F.count_if(F.col(split) == "test").alias("b"))
    total = n.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    a = F.greatest(F.col("a") / F.col("na"), F.lit(floor))
    b = F.greatest(F.col("b") / F.col("nb"), F.lit(floor))
    return n.join(total, "column").groupBy("column").agg(F.sum((b - a) * F.log(b / a)).alias("psi"))


def _shares(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    v = long_values(df, columns, [split], "string").withColumn("value", F.coalesce("value", F.lit("<MISSING>")))
    n = v.groupBy("column", "value").agg(F.count_if(F.col(split) == "train").alias("a"), F.count_if(F.col(split) == "test").alias("b"))
    total = n.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return n.join(total, "column").select("column", "value", F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb")).alias("gap"))


def total_variation(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    return _shares(df, columns, split).groupBy("column").agg((F.sum("gap") * 0.5).alias("total_variation"))


def max_share_gap(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    return _shares(df, columns, split).groupBy("column").agg(F.max("gap").alias("max_gap"))


def mean_shift(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    def stats(c):
        a, b = (F.avg(F.when(F.col(split) == s, F.col(c))) for s in ("train", "test"))
        return {"train_mean": a, "test_mean": b, "shift": F.abs(a - b)}

    return by_column(df, columns, stats)


def entity_overlap(df: DataFrame, entity: str, split: str) -> DataFrame:
    per = df.groupBy(entity).agg(F.max((F.col(split) == "train").cast("int")).alias("a"), F.max((F.col(split) == "test").cast("int")).alias("b"))
    return per.agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.sum(F.col("a") * F.col("b")).alias("n_both"), row_count().alias("n_all"))
