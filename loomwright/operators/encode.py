"""Encoders and scalers: fitted on the training side, applied as plain expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import col, map_value
from loomwright.plans.quantile import column_quantiles
from loomwright.plans.scan import row_numbers
from loomwright.plans.stage import FittedStage, StageChain
from loomwright.plans.store import cut

MAX_LEVELS = 10_000


def levels_of(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted non-missing levels; a column with too many levels for columns of their own is an
    error (``sparse_onehot`` takes any number)."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return sorted(r[0] for r in found)


def ordinal(x, order: dict, unseen: int = -1) -> Column:
    return map_value(x, order, unseen)


def encode_label(df: DataFrame, column: str, classes: Sequence[str], out: str) -> DataFrame:
    """Class name to code; an unknown class raises when the row is read."""
    code = map_value(column, {c: i for i, c in enumerate(classes)})
    fail = F.raise_error(F.concat(F.lit(f"unknown class in {column}: "), F.coalesce(F.col(column), F.lit("NULL"))))
    return df.withColumn(out, F.when(code.isNotNull(), code).otherwise(fail.cast("int")))


def decode_label(x, classes: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), col(x))


def level_union(frames: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Dense codes of the sorted levels over several tables: (level, code)."""
    both = None
    for df, c in frames:
        one = df.select(F.col(c).alias("level")).filter("level is not null")
        both = one if both is None else both.unionByName(one)
    numbered = row_numbers(both.distinct(), [], [F.col("level")], "__n")
    return numbered.select("level", (F.col("__n") - 1).cast("int").alias("code"))


def onehot(column: str, drop_first: bool = False, missing_level: bool = False) -> FittedStage:
    """Indicator columns for the levels seen in training; unseen values are all zero."""

    def apply(df: DataFrame, levels: list):
        use = levels[1:] if drop_first else levels
        out = {f"{column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for v in use}
        if missing_level:
            out[f"{column}_nan"] = F.col(column).isNull().cast("int")
        return df.withColumns(out)

    return FittedStage(lambda train: levels_of(train, column), apply)


def sparse_onehot(columns: Sequence[str], out: str = "onehot", missing_level: bool = False) -> FittedStage:
    """Indicators of any number of levels as (size, indices): the places of a row's ones in the joined level lists.

    The level dictionary is a table (column, level, place) with places in level order, column after column; rows find
    theirs by joins. Levels not seen in training have no place; with ``missing_level`` NULL has one behind its column's.
    """

    def fit(train: DataFrame):
        tables, first = [], 0
        for c in columns:
            levels = cut(level_union([(train.select(F.col(c).cast("string").alias(c)), c)]))
            n = levels.count()
            tables.append((c, levels.select("level", (F.col("code") + first).cast("int").alias("place")), first + n))
            first += n + missing_level
        return tables, first

    def apply(df: DataFrame, spec):
        tables, size = spec
        found = df
        for i, (c, levels, null_place) in enumerate(tables):
            one = levels.select(F.col("level").alias(f"__l{i}"), F.col("place").alias(f"__p{i}"))
            found = found.join(one, F.col(c).cast("string") == F.col(f"__l{i}"), "left").drop(f"__l{i}")
            if missing_level:
                found = found.withColumn(f"__p{i}", F.when(F.col(c).isNull(), null_place).otherwise(F.col(f"__p{i}")))
        places = [f"__p{i}" for i in range(len(tables))]
        ones = F.filter(F.array(*places), lambda p: p.isNotNull())
        return found.withColumn(out, F.struct(F.lit(size).alias("size"), ones.alias("indices"))).drop(*places)

    return FittedStage(fit, apply)


def onehot_to_code(flags: Sequence[str]) -> Column:
    return (F.array_position(F.array(*[F.col(c) for c in flags]), 1) - 1).cast("int")


def standard_scaler(columns: Sequence[str]) -> FittedStage:
    """(x - mean) / population standard deviation; a zero spread divides by one."""

    def fit(train: DataFrame):
        row = train.agg(*[a for c in columns for a in (F.avg(c).alias(f"{c}|m"), F.stddev_pop(c).alias(f"{c}|s"))]).first()
        return {c: (row[f"{c}|m"], row[f"{c}|s"] or 1.0) for c in columns}

    return FittedStage(fit, lambda df, spec: df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in spec.items()}))


def robust_scaler(columns: Sequence[str]) -> FittedStage:
    """(x - median) / interquartile range on a column subset, exact quantiles."""

    def fit(train: DataFrame):
        q = column_quantiles(train, columns, [0.25, 0.5, 0.75])
        return {c: (v[1], (v[2] - v[0]) or 1.0) for c, v in q.items()}

    return FittedStage(fit, lambda df, spec: df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in spec.items()}))


def minmax_scaler(columns: Sequence[str]) -> FittedStage:
    def fit(train: DataFrame):
        row = train.agg(*[a for c in columns for a in (F.min(c).alias(f"{c}|a"), F.max(c).alias(f"{c}|b"))]).first()
        return {c: (float(row[f"{c}|a"]), float(row[f"{c}|b"])) for c in columns}

    def apply(df: DataFrame, spec: dict):
        return df.withColumns({
            c: (F.col(c) - lo) / (hi - lo) if hi > lo else F.when(F.col(c).isNotNull(), F.lit(0.0))
            for c, (lo, hi) in spec.items()
        })

    return FittedStage(fit, apply)


def zscore_index(positive: Sequence[str], negative: Sequence[str], out: str) -> FittedStage:
    """Sum of z-scores of the positive columns minus that of the negative ones."""
    columns = [*positive, *negative]

    def fit(train: DataFrame):
        row = train.agg(*[a for c in columns for a in (F.avg(c).alias(f"{c}|m"), F.stddev_pop(c).alias(f"{c}|s"))]).first()
        return {c: (row[f"{c}|m"], row[f"{c}|s"] or 1.0) for c in columns}

    def apply(df: DataFrame, spec: dict):
        z = {c: (F.col(c) - m) / s for c, (m, s) in spec.items()}
        total = F.lit(0.0)
        for c in positive:
            total = total + F.coalesce(z[c], F.lit(0.0))
        for c in negative:
            total = total - F.coalesce(z[c], F.lit(0.0))
        return df.withColumn(out, total)

    return FittedStage(fit, apply)


def family_chain(kind: str, numeric: Sequence[str], ordinals: dict[str, dict], nominal: Sequence[str]) -> StageChain:
    """Preparation per model family: 'tree' keeps numbers raw and codes levels, 'linear' scales and one-hots."""
    if kind not in ("tree", "linear"):
        raise ValueError(f"kind must be 'tree' or 'linear', not {kind!r}")
    coded = FittedStage(lambda _: None, lambda df, _: df.withColumns({c: ordinal(c, m) for c, m in ordinals.items()}))
    if kind == "tree":
        def codes(c: str) -> FittedStage:
            return FittedStage(
                lambda train: {v: i for i, v in enumerate(levels_of(train, c))},
                lambda df, spec: df.withColumn(c, ordinal(c, spec)),
            )

        return StageChain([coded, *[codes(c) for c in nominal]])
    drop = FittedStage(lambda _: None, lambda df, _: df.drop(*nominal))
    return StageChain([coded, standard_scaler([*numeric, *ordinals]), *[onehot(c) for c in nominal], drop])
