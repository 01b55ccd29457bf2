"""Checks and reshapes of the published output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import row_count


def validate(output: DataFrame, template: DataFrame, id_col: str, value: str, lo: float, hi: float, columns: Sequence[str]) -> DataFrame:
    """Violation counts in one row; all zero means the output may be published."""
    bad_columns = int(list(output.columns) != list(columns))
    t = template.select(id_col, F.lit(1).alias("__t"))
    o = output.groupBy(id_col).agg(row_count().alias("__n"), F.max(value).alias("__v"), F.count(value).alias("__ok"),
                                   F.count_if(F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf"))).alias("__nf"),
                                   F.count_if((F.col(value) < lo) | (F.col(value) > hi)).alias("__out"))
    j = t.join(o, id_col, "full")
    zero = F.lit(0).cast("long")
    return j.agg(
        F.count_if(F.col("__n").isNull()).alias("n_missing_ids"), F.count_if(F.col("__t").isNull()).alias("n_extra_ids"),
        F.count_if(F.col("__n") > 1).alias("n_duplicate_ids"),
        F.coalesce(F.sum(F.col("__n") - F.col("__ok")), zero).alias("n_null"), F.coalesce(F.sum("__nf"), zero).alias("n_not_finite"),
        F.coalesce(F.sum("__out"), zero).alias("n_out_of_range"), F.lit(bad_columns).cast("long").alias("n_bad_columns"))


def require_valid(report: DataFrame) -> None:
    row = report.first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ValueError("output failed validation: " + ", ".join(f"{k}={v}" for k, v in bad.items()))


def topk_valid(text: str, names: Sequence[str], k: int) -> Column:
    """Exactly k distinct known names."""
    parts = F.split(F.col(text), " ")
    known = F.array(*[F.lit(n) for n in names])
    return (F.size(parts) == k) & (F.size(F.array_distinct(parts)) == k) & (F.size(F.array_except(parts, known)) == 0)


def wide_to_long(df: DataFrame, id_col: str, array: str) -> DataFrame:
    """Matrix rows to (row id, probability) lines."""
    return df.select(id_col, F.posexplode(array).alias("position", "probability")).select(
        F.concat_ws("_", F.col(id_col).cast("string"), F.col("position").cast("string")).alias("id"), "probability")


def label_distribution(df: DataFrame, label: str, total: int) -> DataFrame:
    return df.groupBy(label).agg(row_count().alias("n"), (row_count() / F.lit(total)).alias("share"))


def score_distribution(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(score).alias("lo"), F.avg(score).alias("mean"), F.max(score).alias("hi"))
