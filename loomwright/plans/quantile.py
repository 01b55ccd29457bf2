"""Exact linear-interpolated quantiles, by group or for whole columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.plans.scan import hot_keys, running
from loomwright.plans.store import cut


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], limit: int | None = None
) -> DataFrame:
    """One row per key with exact quantiles of ``value``; names come from ``probs``.

    ``percentile`` keeps every distinct value of a group in one task, so above the group limit the
    quantile is read off a distributed cumulative count instead.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    if hot_keys(rows, keys, limit) is None:
        return rows.groupBy(*keys).agg(*[F.percentile("__v", p).alias(n) for n, p in probs.items()])
    counts = cut(rows.filter(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")))
    cum = running(counts, keys, [F.col("__v")], sums={"__cum": F.col("__n")}, limit=limit)
    if keys:
        joined = cum.join(counts.groupBy(*keys).agg(F.sum("__n").alias("__size")), keys)
    else:
        joined = cum.withColumn("__size", F.lit(counts.agg(F.sum("__n")).first()[0] or 0))
    aggs = []
    for n, p in probs.items():
        at = F.lit(float(p)) * (F.col("__size") - 1)
        aggs.append(F.min(F.when(F.col("__cum") > F.floor(at), F.col("__v"))).alias(f"__lo_{n}"))
        aggs.append(F.min(F.when(F.col("__cum") > F.ceil(at), F.col("__v"))).alias(f"__hi_{n}"))
    edge = joined.groupBy(*keys).agg(F.max("__size").alias("__size"), *aggs)
    outs = []
    for n, p in probs.items():
        at = F.lit(float(p)) * (F.col("__size") - 1)
        lo, hi = F.col(f"__lo_{n}"), F.col(f"__hi_{n}")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(n))
    found = edge.select(*keys, *outs)
    if not keys:
        return found
    # keys whose values are all missing keep a row of NULLs
    return rows.select(*keys).distinct().join(found, keys, "left")


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], limit: int | None = None
) -> dict[str, list[float]]:
    """Exact quantiles of whole columns as small fitted values on the driver."""
    columns = list(columns)
    if hot_keys(df.select(*columns), [], limit) is None:
        row = df.agg(*[
            F.percentile(F.col(c).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias(c)
            for c in columns
        ]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("s")).select("s.*")
    names = {f"q{i}": p for i, p in enumerate(probs)}
    got = {r["column"]: [r[n] for n in names] for r in group_quantiles(long, ["column"], "value", names, limit).collect()}
    return {c: got[c] for c in columns}
