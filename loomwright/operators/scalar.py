"""Row-level feature expressions, filters and column-group registries."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import clip_low, col, flag, row_sum, safe_div

KEY_SEPARATOR = "\x1f"


def offset_ratio(a, b) -> Column:
    """a / (b + 1): bounded for b >= 0."""
    return col(a) / (col(b) + 1.0)


def years_from_days(days) -> Column:
    """Negative day offset to elapsed years, never below zero."""
    return clip_low(-col(days) / 365.25, 0.0)


def age_at(year, start_year) -> Column:
    """Years since a start year; a start of zero means the thing is absent."""
    return F.when(col(start_year) > 0, col(year) - col(start_year)).otherwise(F.lit(0))


def log1p_clipped(x) -> Column:
    return F.log1p(clip_low(x, 0.0))


def invert_log(x, low: float = 0.0) -> Column:
    return clip_low(F.expm1(col(x)), low)


def mean_pressure(systolic, diastolic) -> Column:
    return col(diastolic) + (col(systolic) - col(diastolic)) / 3.0


def demand(temperature, humidity, wind) -> Column:
    """Heat times dryness (humidity in percent) times a wind factor."""
    dryness = (F.lit(100.0) - col(humidity)) / 100.0
    return col(temperature) * dryness * (F.lit(1.0) + col(wind) / 20.0)


def hour_of_day(seconds) -> Column:
    return (col(seconds) / 3600.0) % 24


def hour_bucket(seconds, width: int = 4) -> Column:
    return F.floor(hour_of_day(seconds) / width).cast("int")


def circular(degrees) -> tuple[Column, Column]:
    """Sine and cosine of an angle in degrees, missing as zero degrees."""
    rad = F.radians(F.coalesce(col(degrees).cast("double"), F.lit(0.0)))
    return F.sin(rad), F.cos(rad)


def cross_key(*cols, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[col(c).cast("string") for c in cols])


def pairwise(columns: Sequence[str], kinds: Sequence[str]) -> dict[str, Column]:
    """Products, differences and offset ratios of every column pair."""
    out: dict[str, Column] = {}
    for a, b in itertools.combinations(columns, 2):
        if "product" in kinds:
            out[f"{a}_x_{b}"] = col(a) * col(b)
        if "difference" in kinds:
            out[f"{a}_minus_{b}"] = col(a) - col(b)
        if "ratio" in kinds:
            out[f"{a}_over_{b}"] = offset_ratio(a, b)
    return out


def combos(columns: Sequence[str], low: int, high: int) -> list[tuple[str, ...]]:
    """All column combinations of size low..high in column order."""
    return [c for r in range(low, high + 1) for c in itertools.combinations(columns, r)]


def combo_keys(df: DataFrame, id_cols: Sequence[str], groups: Sequence[tuple[str, ...]], keep: Sequence[str] = ()) -> DataFrame:
    """Long form: one (combo, key) row per input row and combination, so one shuffle serves them all."""
    items = [
        F.struct(F.lit("+".join(g)).alias("combo"),
                 F.concat_ws(KEY_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in g]).alias("key"))
        for g in groups
    ]
    return df.select(*id_cols, *keep, F.explode(F.array(*items)).alias("s")).select(*id_cols, *keep, "s.combo", "s.key")


class FeatureGroups:
    """Named optional groups of columns; a group is a function from nothing to named expressions."""

    def __init__(self) -> None:
        self._groups: dict[str, Callable[[], dict[str, Column]]] = {}

    def add(self, name: str, build: Callable[[], dict[str, Column]]) -> "FeatureGroups":
        self._groups[name] = build
        return self

    def columns(self, names: Sequence[str]) -> list[str]:
        return [c for n in names for c in self._groups[n]()]

    def apply(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        return df.select("*", *[e.alias(c) for n in names for c, e in self._groups[n]().items()])


def drop_outliers(df: DataFrame, rule: Column) -> DataFrame:
    """Drop rows that meet the rule; an unknown outcome keeps the row."""
    return df.filter(~F.coalesce(rule, F.lit(False)))


def near_constant_columns(df: DataFrame, columns: Sequence[str], share: float) -> list[str]:
    """Columns whose most frequent value covers at least ``share`` of the rows."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s")).select("s.*")
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("c").agg((F.max("n") / F.sum("n")).alias("share")).filter(F.col("share") >= share)
    found = {r["c"] for r in top.collect()}
    return [c for c in columns if c in found]


def first_entities(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n smallest entity keys (n is the caller's choice of entities, not a row cap)."""
    keep = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(keep, key, "left_semi")


def min_support(df: DataFrame, key: str, target: Column, k: int) -> DataFrame:
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate"))
            .filter(F.col("n") >= k).orderBy(F.desc("rate"), key))


__all__ = [n for n in dir() if not n.startswith("_")] + ["flag", "row_sum", "safe_div"]
