"""Fit on one frame, apply to any: the fitted spec is small and apply() is a plain projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class FittedStage:
    """``fit_fn(train) -> spec`` (driver-sized values) and ``apply_fn(df, spec) -> df`` (expressions)."""

    fit_fn: Callable[[DataFrame], Any]
    apply_fn: Callable[[DataFrame, Any], DataFrame]
    spec: Any = None
    fitted: bool = False

    def fit(self, train: DataFrame) -> "FittedStage":
        self.spec = self.fit_fn(train)
        self.fitted = True
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("stage must be fitted before it is applied")
        return self.apply_fn(df, self.spec)


@dataclass
class StageChain:
    """Stages fitted in order, each on the output of the ones before it."""

    stages: Sequence[FittedStage] = field(default_factory=list)

    def fit(self, train: DataFrame) -> "StageChain":
        for s in self.stages:
            train = s.fit(train).apply(train)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.apply(df)
        return df

    def feature_names(self, df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
        return [c for c in self.apply(df).columns if c not in drop]
