"""Top-k per row, per group and overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.expr import col


def topk_codes(p, k: int) -> Column:
    """Indices of the k largest entries, stable: equal scores keep class order."""
    ranked = F.array_sort(F.transform(col(p), lambda x, i: F.struct((-x).alias("s"), i.alias("c"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["c"])


def topk_names(p, k: int, names: Sequence[str], sep: str = " ") -> Column:
    table = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(topk_codes(p, k), lambda c: F.get(table, c)), sep)


def topk_overall(df: DataFrame, k: int, by: Column, tie: str) -> DataFrame:
    return df.orderBy(by.desc(), tie).limit(k)


def topk_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """row_number <= k: Spark keeps k rows per group and task before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
