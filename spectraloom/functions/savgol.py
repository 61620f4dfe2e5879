"""Savitzky-Golay smoothing: local polynomial least squares, ends taken from the end windows' fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, types as T

from spectraloom.functions.kernels import add_columns, map_matrix


def fit_matrix(window: int, polyorder: int) -> np.ndarray:
    """``window x window`` matrix that maps the points of a window to its fitted polynomial's values.

    The middle row is the filter for inner points, the rows above and below it are those for the ends.
    """
    if window < 1 or window % 2 == 0:
        raise ValueError(f"window must be odd and positive, got {window}")
    if not 0 <= polyorder < window:
        raise ValueError(f"polyorder must be at least 0 and less than window, got {polyorder}")
    half = window // 2
    basis, _ = np.linalg.qr(np.vander(np.arange(-half, half + 1) / max(half, 1), polyorder + 1))
    return basis @ basis.T


def smooth_matrix(x: np.ndarray, fit: np.ndarray) -> np.ndarray:
    window = len(fit)
    half = window // 2
    rows, points = x.shape
    if rows and points < window:
        raise ValueError(f"window {window} is longer than a spectrum of {points} points")
    out = np.zeros((rows, points))
    inner = out[:, half:points - half]
    for j in range(window):
        inner += fit[half, j] * x[:, j:j + inner.shape[1]]
    if half:
        out[:, :half] = x[:, :window] @ fit[:half].T
        out[:, -half:] = x[:, -window:] @ fit[half + 1:].T
    return out


def savgol(df: DataFrame, column: str, output: str, window: int = 11, polyorder: int = 2) -> DataFrame:
    fit = fit_matrix(window, polyorder)
    return add_columns(df, column, {output: T.ArrayType(T.DoubleType())},
                       lambda spectra: [map_matrix(spectra, lambda matrix: smooth_matrix(matrix, fit))])
