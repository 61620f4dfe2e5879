"""Baseline by asymmetrically reweighted penalised least squares (Baek et al., Analyst 140, 2015).

Per spectrum: minimise ``sum w (y - z)^2 + lam * sum (D^order z)^2``, then lower the weight of the
points above the fit by a logistic rule on the residuals below it, until the weights settle.
The normal equations are banded; a batch of spectra is factorised together, one position at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from spectraloom.functions.kernels import add_columns, matrices, to_lists

RESULT = {"baseline": T.ArrayType(T.DoubleType()), "iterations": T.IntegerType(), "converged": T.BooleanType()}

# Stopping rule.
TOLERANCE = 1e-3
MAX_ITERATIONS = 50

ROWS_AT_ONCE = 1024  # bounds the memory of a task whatever the Arrow batch size


def penalty_bands(points: int, order: int, lam: float) -> np.ndarray:
    """Lower bands of ``lam * D'D``: row ``k`` holds the entries ``(i + k, i)``."""
    stencil = np.array([1.0])
    for _ in range(order):
        stencil = np.convolve(stencil, [1.0, -1.0])
    bands = np.zeros((order + 1, points))
    for first in range(points - order):
        for k in range(order + 1):
            bands[k, first:first + order + 1 - k] += stencil[:order + 1 - k] * stencil[k:]
    return lam * bands


def solve_banded(weights: np.ndarray, bands: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solve ``(diag(w) + P) z = w y`` for every spectrum of a batch; arrays are points x spectra."""
    points, _ = weights.shape
    order = len(bands) - 1
    diag = weights + bands[0][:, None]
    lower = np.empty((order, *weights.shape))
    z = weights * y
    for i in range(points):
        for k in range(1, min(order, i) + 1):
            scaled = lower[k - 1, i - k]
            diag[i] -= scaled * scaled * diag[i - k]
            z[i] -= scaled * z[i - k]
        for k in range(1, min(order, points - 1 - i) + 1):
            entry = np.full(weights.shape[1], bands[k, i])
            for m in range(1, order - k + 1):
                if i - m >= 0:
                    entry -= lower[m - 1, i - m] * lower[m + k - 1, i - m] * diag[i - m]
            lower[k - 1, i] = entry / diag[i]
    z /= diag
    for i in range(points - 2, -1, -1):
        for k in range(1, min(order, points - 1 - i) + 1):
            z[i] -= lower[k - 1, i] * z[i + k]
    return z


def reweight(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New weights from residuals, and which spectra have too few points below the fit to go on."""
    below = residual < 0
    count = below.sum(axis=0)
    stuck = count < 2
    safe = np.maximum(count, 2)
    mean = np.where(below, residual, 0.0).sum(axis=0) / safe
    spread = np.sqrt(np.where(below, (residual - mean) ** 2, 0.0).sum(axis=0) / (safe - 1))
    spread = np.maximum(spread, np.finfo(float).tiny)
    exponent = 2.0 * (residual - (2.0 * spread - mean)) / spread
    return 1.0 / (1.0 + np.exp(np.clip(exponent, -700.0, 700.0))), stuck


def fit_baselines(y: np.ndarray, lam: float, order: int,
                  tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS):
    """Baselines, iterations used and convergence flags for the rows of ``y``.

    Spectra leave the working set as they settle, so one slow spectrum does not hold up a batch.
    """
    rows, points = y.shape
    baseline = np.zeros_like(y)
    iterations = np.zeros(rows, dtype=np.int32)
    converged = np.zeros(rows, dtype=bool)
    if points <= order:
        raise ValueError(f"difference order {order} needs more than {points} points")
    bands = penalty_bands(points, order, lam)
    signal = np.ascontiguousarray(y.T)
    active = np.arange(rows)
    weights = np.ones_like(signal)
    for step in range(1, max_iterations + 2):
        if not len(active):
            break
        z = solve_banded(weights, bands, signal)
        updated, stuck = reweight(signal - z)
        change = np.linalg.norm(updated - weights, axis=0) / np.maximum(np.linalg.norm(weights, axis=0),
                                                                          np.finfo(float).eps)
        settled = ~stuck & (change < tolerance)
        done = settled | stuck
        baseline[active] = z.T
        iterations[active] = step
        converged[active[settled]] = True
        active, weights, signal = active[~done], updated[:, ~done], signal[:, ~done]
    return baseline, iterations, converged


def arpls(df: DataFrame, column: str, lam: float = 1e6, diff_order: int = 2) -> DataFrame:
    """Add ``baseline, iterations, converged``; all NULL where ``column`` is NULL."""

    def solve(spectra: pa.Array) -> list[pa.Array]:
        total = len(spectra)
        found = []
        steps = np.zeros(total, dtype=np.int32)
        settled = np.zeros(total, dtype=bool)
        for rows, matrix in matrices(spectra):
            fitted = np.empty_like(matrix)
            for start in range(0, len(rows), ROWS_AT_ONCE):
                part = slice(start, start + ROWS_AT_ONCE)
                fitted[part], steps[rows[part]], settled[rows[part]] = fit_baselines(matrix[part], lam, diff_order)
            found.append((rows, fitted))
        missing = spectra.is_null().to_numpy(zero_copy_only=False)
        return [to_lists(found, total), pa.array(steps, mask=missing), pa.array(settled, mask=missing)]

    return add_columns(df, column, RESULT, solve)
