"""Cleaning steps on tables of spectra. Each takes and returns a DataFrame with an intensities array.

No step shuffles the spectra. Despiking with data-set scope first computes two numbers over the whole
table (see ``quantile``); every other step looks at one row at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spectraloom.functions import arrays
from spectraloom.functions.arpls import arpls
from spectraloom.functions.savgol import savgol
from spectraloom.operators.quantile import difference_stats

INTENSITIES = "intensities"


Stats = tuple[float | None, float | None]


def _scope_stats(df: DataFrame, column: str, scope: str, stats: Stats | None) -> Stats | None:
    """Statistics of all differences for data-set scope, None where each spectrum is its own measure."""
    if scope == "dataset":
        return stats or difference_stats(df, column)
    if scope == "spectrum":
        return None
    raise ValueError(f"scope must be 'dataset' or 'spectrum', got {scope!r}")


def first_difference(df: DataFrame, column: str = INTENSITIES, output: str = "difference") -> DataFrame:
    return df.withColumn(output, arrays.first_difference(F.col(column)))


def modified_z(df: DataFrame, column: str = INTENSITIES, output: str = "z", scope: str = "dataset",
               stats: Stats | None = None) -> DataFrame:
    return df.withColumn(output, arrays.modified_z(F.col(column), _scope_stats(df, column, scope, stats)))


def despike(df: DataFrame, ma: int = 10, threshold: float = 50, scope: str = "dataset",
            stats: Stats | None = None, column: str = INTENSITIES, output: str | None = None) -> DataFrame:
    """Replace points that jump to their successor by the mean of their quiet neighbourhood.

    ``scope='dataset'`` judges jumps against all spectra of ``df``, ``scope='spectrum'`` against their
    own spectrum; the results differ. ``stats`` gives a known (median, deviation) pair and saves the
    passes over the data, for example when new spectra are cleaned like earlier ones.
    """
    found = _scope_stats(df, column, scope, stats)
    return df.withColumn(output or column, arrays.despike(F.col(column), ma, threshold, found))


def smooth(df: DataFrame, window: int = 11, polyorder: int = 2,
           column: str = INTENSITIES, output: str | None = None) -> DataFrame:
    return savgol(df, column, output or column, window, polyorder)


def demean(df: DataFrame, column: str = INTENSITIES, output: str | None = None) -> DataFrame:
    return df.withColumn(output or column, arrays.demean(F.col(column)))


def normalize(df: DataFrame, column: str = INTENSITIES, output: str | None = None) -> DataFrame:
    return df.withColumn(output or column, arrays.l2_normalize(F.col(column)))


def needs_baseline(x: Column, lam: float) -> Column:
    """Only spectra whose points sum to more than ``lam`` in absolute value are corrected."""
    return F.abs(arrays.array_sum(x)) > lam


def correct_baseline(df: DataFrame, lam: float = 1e6, diff_order: int = 2, return_baselines: bool = False,
                     column: str = INTENSITIES, output: str | None = None) -> DataFrame:
    """Subtract the fitted baseline; unguarded spectra keep a zero baseline.

    With ``return_baselines`` the columns ``baseline, iterations, converged`` are added; the last two
    are NULL for spectra that were not fitted.
    """
    x = F.col(column)
    df = arpls(df.withColumn("_guarded", F.when(needs_baseline(x, lam), x)), "_guarded", lam, diff_order)
    baseline = F.coalesce(F.col("baseline"), F.transform(x, lambda _: F.lit(0.0)))
    corrected = F.when(F.col("baseline").isNull(), x).otherwise(
        F.zip_with(x, F.col("baseline"), lambda v, b: v - b))
    df = df.withColumns({output or column: corrected, **({"baseline": baseline} if return_baselines else {})})
    return df.drop("_guarded", *([] if return_baselines else ["baseline", "iterations", "converged"]))


def baseline_guard_report(df: DataFrame, lam: float = 1e6, column: str = INTENSITIES) -> DataFrame:
    """How many spectra the guard lets through to the fit, and the range of their sums."""
    total = arrays.array_sum(F.col(column))
    return (df.select(total.alias("total"), (F.abs(total) > lam).alias("corrected"))
            .groupBy("corrected")
            .agg(F.count("*").alias("n"), F.min("total").alias("min_sum"), F.max("total").alias("max_sum")))


STEPS = {"despike": despike, "smooth": smooth, "baseline": correct_baseline,
         "normalize": normalize, "demean": demean}

DEFAULT_STEPS = [("despike", {}), ("smooth", {}), ("baseline", {}), ("normalize", {})]


def preprocess(df: DataFrame, steps: Sequence[tuple[str, dict]] = DEFAULT_STEPS,
               column: str = INTENSITIES) -> DataFrame:
    """Apply named steps with their parameters in order; default: despike, smooth, baseline, normalise."""
    for name, params in steps:
        if name not in STEPS:
            raise ValueError(f"unknown step {name!r}; choose from {sorted(STEPS)}")
        df = df.transform(STEPS[name], column=column, **params)
    return df


def preview_steps(df: DataFrame, n: int = 6, steps: Sequence[tuple[str, dict]] = DEFAULT_STEPS,
                  order_by: str = "spectrum_id", column: str = INTENSITIES) -> DataFrame:
    """The first ``n`` spectra with one added column per step, named after the step.

    As in the interactive preview, despiking statistics are those of the ``n`` spectra alone.
    """
    df = df.orderBy(order_by).limit(n)
    current = column
    for name, params in steps:
        df = df.transform(STEPS[name], column=current, output=name, **params)
        current = name
    return df


def explode_points(df: DataFrame, columns: Sequence[str] = (INTENSITIES,), keys: Sequence[str] = ("spectrum_id",),
                   index: str = "idx") -> DataFrame:
    """Long form: one row per point with the given array columns side by side.

    The outer generator keeps Catalyst from adding an emptiness filter below it, which would compute
    the arrays (and call their Python kernels) a second time.
    """
    if len(columns) == 1:
        long = df.select(*keys, F.posexplode_outer(columns[0]).alias(index, columns[0]))
        return long.where(F.col(index).isNotNull())
    long = df.select(*keys, F.posexplode_outer(F.arrays_zip(*columns)).alias(index, "_p"))
    return (long.where(F.col(index).isNotNull())
            .select(*keys, index, *[F.col(f"_p.{c}").alias(c) for c in columns]))
