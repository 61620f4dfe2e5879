"""Grid search of linear regression from sums: one scan, then every fold and penalty by subtraction.

For each fold the products of all columns with each other (features, one, label) are added up. What a fit on the other
folds needs is the sum of all less the fold's own; its score on the fold needs the fold's own. So the number of
penalties and folds adds no scan.

The penalised problem is that of ``LinearRegression`` with ``elasticNetParam`` 0: half the mean square plus half the
penalty, divided by the label's deviation, times the squared coefficients, each times its feature's variance if
``standardize``. The intercept is free. Sums are of the size (features + 2)^2 per fold, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class LinearFit:
    coefficients: np.ndarray
    intercept: float


def fold_products(folded: DataFrame, k: int, label: str, features: str = "features", fold: str = "fold") -> np.ndarray:
    """(fold, column, column): sums of products of (features..., 1, label)."""
    vector = dict(folded.dtypes)[features] == "vector"
    rows = folded.select(F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"),
                         (vector_to_array(features) if vector else F.col(features).cast("array<double>")).alias("x"))

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            all_columns = np.column_stack([x, np.ones(len(x)), y])
            numbers = batch.column("fold").to_numpy(zero_copy_only=False)
            for number in np.unique(numbers):
                some = all_columns[numbers == number]
                sums[int(number)] = sums.get(int(number), 0.0) + some.T @ some
        for number, products in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([products.tobytes()], pa.binary())], names=["fold", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column("fold").to_pylist(), batch.column("sums")):
                sums[number] = sums.get(number, 0.0) + np.frombuffer(data.as_buffer(), np.float64)
        for number, products in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([products.tobytes()], pa.binary())], names=["fold", "sums"])

    found = (rows.mapInArrow(partial, "fold int, sums binary").repartition(k, "fold")
             .mapInArrow(add, "fold int, sums binary").collect())  # one row per fold
    if not found:
        raise ValueError("no rows to search with")
    flat = {r["fold"]: np.frombuffer(bytes(r["sums"]), np.float64) for r in found}
    width = int(round(len(next(iter(flat.values()))) ** 0.5))
    return np.array([flat[i].reshape(width, width) if i in flat else np.zeros((width, width)) for i in range(k)])


def solve(products: np.ndarray, penalty: float, standardize: bool = True) -> LinearFit:
    """The fit on rows with these sums."""
    n = products[-2, -2]
    mean = products[:, -2] / n
    centred = products / n - np.outer(mean, mean)
    spread, deviation = np.diag(centred)[:-2], np.sqrt(max(centred[-1, -1], 0.0))
    x, xy = centred[:-2, :-2], centred[:-2, -1]
    weight = np.where(spread > 0, spread, 1.0) if standardize else np.ones(len(spread))
    ridge = np.diag(weight) * (penalty / deviation if deviation > 0 else 0.0)
    coefficients = np.linalg.lstsq(x + ridge, xy, rcond=None)[0]
    return LinearFit(coefficients, float(mean[-1] - mean[:-2] @ coefficients))


def r_squared(products: np.ndarray, fit: LinearFit) -> float:
    """Of the fit on rows with these sums."""
    error = np.concatenate([-fit.coefficients, [-fit.intercept, 1.0]])
    total = products[-1, -1] - products[-1, -2] ** 2 / products[-2, -2]
    return float(1 - error @ products @ error / total)


def search_penalties(products: np.ndarray, penalties: Sequence[float], standardize: bool = True) -> tuple[list[float], int]:
    """Mean R-squared over the folds for every penalty, and the position of the best."""
    whole = products.sum(axis=0)
    held = [own for own in products if own[-2, -2] > 0]
    scores = [float(np.mean([r_squared(own, solve(whole - own, p, standardize)) for own in held])) for p in penalties]
    return scores, max(range(len(scores)), key=scores.__getitem__)
