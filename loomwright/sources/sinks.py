"""Output files and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_ordered_csv(template: DataFrame, values: DataFrame, id_col: str, pos: str, path: str) -> None:
    """Rows in template order. Part files follow the order, so reading them in name order restores it;
    nothing is squeezed through one task."""
    (template.join(values, id_col, "left").orderBy(pos).drop(pos)
     .write.mode("overwrite").option("header", True).csv(path))


def upsert_results(old: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """Latest row per run key."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("__v"))
    return (both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__v").orderBy(order))


def write_predictions(df: DataFrame, path: str, by: Sequence[str] = ("run", "split")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def merge_partitions(df: DataFrame, path: str, by: str = "split") -> None:
    """Replace only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
