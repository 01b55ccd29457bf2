"""Missing values, sentinels and fitted imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import clip_low, finite, flag, sentinel_to_null
from loomwright.plans.quantile import column_quantiles, group_quantiles
from loomwright.plans.stage import FittedStage


def flag_sentinel(df: DataFrame, column: str, sentinel, flag_name: str) -> DataFrame:
    hit = flag(F.col(column) == sentinel)
    return df.withColumns({flag_name: hit, column: sentinel_to_null(column, sentinel)})


def null_sentinels(df: DataFrame, columns: Sequence[str], sentinel) -> DataFrame:
    return df.withColumns({c: sentinel_to_null(c, sentinel) for c in columns})


def fill_not_applicable(df: DataFrame, column: str, not_applicable, fill, flag_name: str) -> DataFrame:
    """Where the governing condition says the value cannot exist, fill it and flag the row."""
    hit = F.coalesce(not_applicable, F.lit(False))
    return df.withColumns({flag_name: hit.cast("int"), column: F.when(hit, F.lit(fill)).otherwise(F.col(column))})


def recode(df: DataFrame, mapping: dict[str, dict]) -> DataFrame:
    """Per-column value remap; unmapped values and NULL stay as they are."""
    out = {}
    for c, m in mapping.items():
        expr = None
        for old, new in m.items():
            expr = F.when(F.col(c) == old, F.lit(new)) if expr is None else expr.when(F.col(c) == old, F.lit(new))
        out[c] = expr.otherwise(F.col(c))
    return df.withColumns(out)


def fill_constants(df: DataFrame, none_columns: Sequence[str] = (), zero_columns: Sequence[str] = (), token: str = "None") -> DataFrame:
    return df.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(token)) for c in none_columns},
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in zero_columns},
    })


def add_indicators(df: DataFrame, columns: Sequence[str], suffix: str = "_isna") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in columns})


def median_imputer(columns: Sequence[str], indicators: bool = True) -> FittedStage:
    def fit(train: DataFrame):
        return {c: q[0] for c, q in column_quantiles(train, columns, [0.5]).items()}

    def apply(df: DataFrame, spec: dict):
        if indicators:
            df = add_indicators(df, columns)
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(spec[c]).cast("double")) for c in columns})

    return FittedStage(fit, apply)


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent value per column, smallest on ties, from one shuffle over all columns."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s")).select("s.*")
    counts = long.filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    return {r["c"]: r["v"] for r in best.collect()}


def mode_imputer(columns: Sequence[str]) -> FittedStage:
    return FittedStage(
        lambda train: mode_values(train, columns),
        lambda df, spec: df.withColumns({c: F.coalesce(F.col(c), F.lit(spec.get(c))) for c in columns}),
    )


def impute_group_median(df: DataFrame, group: str, column: str) -> DataFrame:
    """Group median, then the global median where a group has no value."""
    overall = column_quantiles(df, [column], [0.5])[column][0]
    med = group_quantiles(df, [group], column, {"__med": 0.5}).withColumnRenamed(group, "__g")
    joined = df.join(med, df[group].eqNullSafe(med["__g"]), "left")
    # rows without a group take the global value, as grouped statistics skip missing keys
    own = F.when(F.col(group).isNotNull(), F.col("__med"))
    filled = F.coalesce(F.col(column).cast("double"), own, F.lit(overall).cast("double"))
    return joined.withColumn(column, filled).drop("__g", "__med")


def infer_bool(column: str, spend, default: bool = False):
    """A missing flag is false when money was spent, and the default otherwise."""
    c = F.col(column)
    return F.coalesce(F.when(c.isNull() & (spend > 0), F.lit(False)).otherwise(c), F.lit(default))


def finite_or(x, fill: float = 0.0):
    return F.coalesce(finite(x), F.lit(fill))


def sample_skew(x):
    """Bias-corrected skewness from the population one."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def skew_log(columns: Sequence[str], threshold: float, min_distinct: int = 10, replace: bool = False, prefix: str = "LOG1P_") -> FittedStage:
    """Learn which non-negative, skewed, many-valued columns get a log1p form."""

    def fit(train: DataFrame):
        clean = train.select(*[finite(c).alias(c) for c in columns])
        aggs = []
        for c in columns:
            aggs += [F.min(c).alias(f"{c}|min"), sample_skew(F.col(c)).alias(f"{c}|skew")]
        row = clean.agg(*aggs).first()
        skewed = [c for c in columns if row[f"{c}|min"] is not None and row[f"{c}|min"] >= 0
                  and row[f"{c}|skew"] is not None and abs(row[f"{c}|skew"]) > threshold]
        if not skewed:
            return []
        # each distinct count on its own shuffle key instead of one task per column
        long = clean.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in skewed])).alias("s")).select("s.*")
        many = (long.filter(F.col("v").isNotNull()).distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > min_distinct))
        keep = {r["c"] for r in many.collect()}
        return [c for c in skewed if c in keep]

    def apply(df: DataFrame, spec: list[str]):
        return df.withColumns({(c if replace else f"{prefix}{c}"): F.log1p(clip_low(c, 0.0)) for c in spec})

    return FittedStage(fit, apply)


def cast_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
