"""Schema and data checks. Each returns a small report frame; ``require_*`` raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    gone = missing_columns(df, required)
    if gone:
        raise ValueError(f"{what} is missing columns: {', '.join(gone)}")
    return df


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells per column from one scan."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "n_null")


def require_no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = [f"{r['column']} ({r['n_null']})" for r in null_counts(df, columns).filter("n_null > 0").collect()]
    if bad:
        raise ValueError("missing values in: " + ", ".join(bad))
    return df


def unknown_levels(df: DataFrame, column: str, levels: Sequence) -> DataFrame:
    """Values outside a fixed level list, with their row counts."""
    return (df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(levels)))
            .groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n")))


def domain_report(df: DataFrame, column: str, levels: Sequence) -> DataFrame:
    """Rows inside and outside the domain, and how many known levels occur."""
    known = F.col(column).isin(list(levels))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("n_unknown"),
        F.count_distinct(F.when(known, F.col(column))).alias("n_known_levels"),
    )


def require_levels(df: DataFrame, column: str, levels: Sequence) -> DataFrame:
    bad = [str(r["level"]) for r in unknown_levels(df, column, levels).limit(20).collect()]
    if bad:
        raise ValueError(f"unseen levels in {column}: {', '.join(bad)}")
    return df


def range_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    items = []
    for c, (lo, hi) in bounds.items():
        v = F.col(c).cast("double")
        items.append(F.struct(
            F.lit(c).alias("column"), F.min(v).alias("lo"), F.max(v).alias("hi"),
            F.coalesce((F.min(v) >= lo) & (F.max(v) <= hi), F.lit(False)).alias("inside"),
        ))
    return df.agg(F.array(*items).alias("r")).select(F.inline("r"))


def binary_matrix_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = [F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))) for c in columns]
    total = bad[0]
    for b in bad[1:]:
        total = total + b
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(columns)).cast("long").alias("n_labels"),
                  total.alias("n_not_binary"))


def duplicate_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_id_report(df: DataFrame, key: str, text: str) -> DataFrame:
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(text).isNull()).alias("m"))
    return per_id.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"),
                      F.count_if(F.col("n") > 1).alias("n_duplicated"), F.sum("m").alias("n_missing_text"))
