"""Append, replace and repeatable sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.expr import hash_key, hash_unit, row_count
from loomwright.plans.scan import row_numbers


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def augment_train(folded: DataFrame, extra: DataFrame) -> DataFrame:
    """External rows carry fold NULL: on the train side of every fold, on the validation side of none."""
    return folded.unionByName(extra.withColumn("fold", F.lit(None).cast("int")), allowMissingColumns=True)


def train_side(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold").isNull() | (F.col("fold") != fold))


def valid_side(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") == fold)


def replace_splits(old: DataFrame, new: DataFrame, column: str = "split") -> DataFrame:
    return old.join(new.select(column).distinct(), column, "left_anti").unionByName(new)


def hash_numbered(df: DataFrame, keys: Sequence[str], id_col: str, seed: int | str = "") -> DataFrame:
    """Rows numbered per key in hash order (column ``__n``): the base of every repeatable draw."""
    keyed = df.withColumn("__h", hash_key(id_col, seed=seed))
    return row_numbers(keyed, keys, [F.col("__h"), F.col(id_col)], "__n").drop("__h")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int | str = "") -> DataFrame:
    return hash_numbered(df, [], id_col, seed).filter(F.col("__n") <= n).drop("__n")


def keep_positives(df: DataFrame, id_col: str, positive: Column, n_negatives: int) -> DataFrame:
    negatives = sample_n(df.filter(~positive), id_col, n_negatives)
    return df.filter(positive).unionByName(negatives)


def undersample(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """Every class cut to the size of the smallest one."""
    smallest = df.groupBy(label).agg(row_count().alias("n")).agg(F.min("n").alias("m")).first()["m"]
    return hash_numbered(df, [label], id_col).filter(F.col("__n") <= (smallest or 0)).drop("__n")


def weighted_replace(spark: SparkSession, df: DataFrame, id_col: str, label: str) -> DataFrame:
    """As many draws as rows, with replacement, every class equally likely (inverse class frequency)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(row_count().alias("n")).collect()}
    classes = sorted(counts)
    total = sum(counts.values())
    u1, u2 = hash_unit(hash_key("draw", seed="class")), hash_unit(hash_key("draw", seed="row"))
    draws = spark.range(total).withColumnRenamed("id", "draw")
    pick = F.floor(u1 * len(classes)).cast("int")
    size = F.get(F.array(*[F.lit(counts[c]) for c in classes]), pick)
    draws = draws.select("draw", F.get(F.array(*[F.lit(c) for c in classes]), pick).alias(label),
                         (F.floor(u2 * size) + 1).cast("long").alias("__n"))
    return draws.join(hash_numbered(df, [label], id_col), [label, "__n"]).drop("__n")


def few_shot(df: DataFrame, exclude: DataFrame, id_col: str, label: str, k: int) -> DataFrame:
    """k examples per class in hash order, none of them from the excluded ids."""
    pool = df.join(exclude.select(id_col), id_col, "left_anti")
    return hash_numbered(pool, [label], id_col).filter(F.col("__n") <= k).withColumnRenamed("__n", "shot")
