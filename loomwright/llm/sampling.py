"""Bounded samples by hash, picked where the rows are: no task and no driver sorts or merges more than the sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def about(df: DataFrame, n: int, *key: str, seed: int = 17) -> DataFrame:
    """About ``n`` rows (never more than twice as many): those whose hash of ``key`` is in the lowest n / count of all hashes."""
    return drawn(df, n, *key, seed=seed).limit(2 * n)


def drawn(df: DataFrame, n: int, *key: str, seed: int = 17) -> DataFrame:
    """The same without the bound: rows of one ``key`` come together or not at all, and reruns draw the same."""
    total = df.count()
    if total <= n:
        return df
    below = -(1 << 63) + (1 << 64) * n // total
    return df.filter(F.xxhash64(F.lit(seed), *key) < F.lit(below))
