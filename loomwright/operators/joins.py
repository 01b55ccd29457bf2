"""Key joins of feature tables, lookups and id alignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID_LIMIT = 100_000


def left_enrich(base: DataFrame, features: DataFrame, key) -> DataFrame:
    """One row per base row; the feature side has one row per key, so AQE may broadcast it by size."""
    return base.join(features, key, "left")


def full_outer_chain(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Outer join on one key; every input is already partitioned by it after its own aggregation.

    What an outer join gives is not, and is dealt anew for the next one. So the narrowest frames come first, and the widest
    is not dealt again; columns stand in the order of ``frames``.
    """
    names = [c for f in frames for c in f.columns if c != key]
    if len(set(names)) < len(names):
        return reduce(lambda a, b: a.join(b, key, "full"), frames)
    narrow_first = sorted(frames, key=lambda f: len(f.columns))
    return reduce(lambda a, b: a.join(b, key, "full"), narrow_first).select(key, *[F.col(f"`{c}`") for c in names])


def inner_rekey(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Attach the parent key to child aggregates."""
    return child.join(parent.select(child_key, parent_key), child_key, "inner")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def attach_folds(df: DataFrame, folds: DataFrame, id_col: str) -> DataFrame:
    """Persisted folds joined on; a row without a fold raises when it is read."""
    out = df.join(folds, id_col, "left")
    missing = F.raise_error(F.concat(F.lit("no fold for id "), F.col(id_col).cast("string"))).cast("int")
    return out.withColumn("fold", F.when(F.col("fold").isNotNull(), F.col("fold")).otherwise(missing))


def template_order(template: DataFrame, values: DataFrame, id_col: str, pos: str) -> DataFrame:
    return template.join(values, id_col, "left").orderBy(pos)


def align_runs(preds: DataFrame, runs: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """Runs side by side by id; ids that lack a run raise when the row is read."""
    wide = preds.groupBy(id_col).pivot("run", list(runs)).agg(F.max("score"))
    whole = reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in runs])
    err = F.raise_error(F.concat(F.lit("runs differ in ids, first seen at "), F.col(id_col).cast("string")))
    return wide.withColumn(runs[0], F.when(whole, F.col(runs[0])).otherwise(err.cast("double")))


def semi_overlap(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return left.join(right, key, "left_semi")


def anti_unseen(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return left.join(right, key, "left_anti")


def class_grid(ids: DataFrame, classes: DataFrame, column: str, limit: int = GRID_LIMIT) -> DataFrame:
    """Every id with every class of a size-checked class list, as an exploded literal (no join)."""
    found = [r[0] for r in classes.select(column).distinct().orderBy(column).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"class list above {limit} entries")
    return ids.withColumn(column, F.explode(F.array(*[F.lit(v) for v in found])))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
