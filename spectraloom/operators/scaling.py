"""Min-max scaling of one numeric column, its inverse, and scaling of unseen values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class MinMaxScale:
    """Fitted bounds. Values outside them scale outside [0, 1]; a constant column scales to 0."""

    low: float
    high: float

    @property
    def span(self) -> float:
        return (self.high - self.low) or 1.0

    def transform(self, value: Column) -> Column:
        return (value - self.low) / self.span

    def inverse(self, scaled: Column) -> Column:
        return scaled * self.span + self.low


def fit_min_max(df: DataFrame, column: str) -> MinMaxScale:
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        raise ValueError(f"column {column!r} holds no values")
    return MinMaxScale(float(low), float(high))
