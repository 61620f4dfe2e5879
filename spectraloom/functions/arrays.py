"""Column expressions on the points of one spectrum (an ``ARRAY<DOUBLE>`` cell).

All of them run in the JVM inside a projection: no shuffle, no Python worker.

Catalyst merges stacked projections by substituting expressions, also into lambdas, where they would
be evaluated once per point. So every step binds its input with ``let`` before it uses it twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def first_difference(x: Column) -> Column:
    """``d[i] = x[i+1] - x[i]``; one point shorter than ``x``."""
    def shifted(v: Column) -> Column:
        length = F.greatest(F.size(v) - 1, F.lit(0))
        return F.zip_with(F.slice(v, 2, length), F.slice(v, 1, length), lambda after, before: after - before)
    return let(x, shifted)


def finite(x: Column) -> Column:
    """The points that are neither NULL nor NaN."""
    return F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, v: total + v)


def array_median(x: Column) -> Column:
    """Median of the finite points; NULL when there are none."""
    def middle(s: Column) -> Column:
        lower = F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))
        upper = F.get(s, F.floor(F.size(s) / 2).cast("int"))
        return (lower + upper) / 2
    return let(F.sort_array(finite(x)), middle)


def median_mad(x: Column) -> Column:
    """Struct of the median and the median absolute deviation of the points."""
    def pair(v: Column) -> Column:
        return let(array_median(v), lambda median: F.struct(
            median.alias("median"),
            array_median(F.transform(v, lambda point: F.abs(point - median))).alias("mad")))
    return let(x, pair)


# Fixed values of the modified z-score.
Z_SCALE = 0.6745
MIN_MAD = 0.001


def modified_z(x: Column, stats: tuple[float, float] | None = None) -> Column:
    """Modified z-score of the first differences; all zero when their deviation is degenerate.

    ``stats`` is the (median, deviation) to judge by, by default those of the spectrum itself.
    """
    def scores(d: Column, median: Column, mad: Column) -> Column:
        return F.when(F.abs(mad) < MIN_MAD, F.transform(d, lambda _: F.lit(0.0))).otherwise(
            F.transform(d, lambda v: F.lit(Z_SCALE) * (v - median) / mad))
    if stats is not None:
        median, mad = (F.lit(s).cast("double") for s in stats)
        return let(first_difference(x), lambda d: scores(d, median, mad))
    return let(first_difference(x), lambda d: let(
        median_mad(d), lambda own: scores(d, own["median"], own["mad"])))


def spike_flags(x: Column, threshold: float, stats: tuple[float, float] | None = None) -> Column:
    """One flag per point; the last point has no difference and is never a spike."""
    flags = F.transform(modified_z(x, stats),
                        lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) > threshold), F.lit(False)))
    return F.concat(flags, F.array(F.lit(False)))


def despike(x: Column, ma: int, threshold: float, stats: tuple[float, float] | None = None) -> Column:
    """Replace spikes by the mean of the other original points at most ``ma`` away.

    NULL when every point in reach is a spike. Spectra without spikes are returned as they are.
    """
    def repaired(v: Column, flags: Column) -> Column:
        def window_mean(i: Column) -> Column:
            # slice() stops at the end of the array by itself
            start = F.when(i > ma, i - (ma - 1)).otherwise(1)
            length = F.when(i > ma, 2 * ma + 1).otherwise(i - (-ma - 1))
            kept = F.filter(
                F.zip_with(F.slice(v, start, length), F.slice(flags, start, length),
                           lambda point, spike: F.when(~spike, point)),
                lambda point: point.isNotNull())
            return let(kept, lambda points: F.try_divide(array_sum(points), F.size(points)))
        return F.when(F.exists(flags, lambda spike: spike),
                      F.transform(v, lambda point, i: F.when(F.get(flags, i), window_mean(i)).otherwise(point))
                      ).otherwise(v)
    return let(x, lambda v: let(spike_flags(v, threshold, stats), lambda flags: repaired(v, flags)))


def demean(x: Column) -> Column:
    return let(x, lambda v: let(array_sum(v) / F.size(v), lambda mean: F.transform(v, lambda point: point - mean)))


# Fixed values of the vector normalisation.
NORM_SCALE = 100.0
MIN_NORM = 0.001


def l2_normalize(x: Column) -> Column:
    """Unit length times 100. A norm that is tiny, NaN or NULL counts as 1."""
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, point: total + point * point))
        return let(norm, lambda n: let(
            F.when((n >= MIN_NORM) & ~F.isnan(n), n).otherwise(1.0),
            lambda divisor: F.transform(v, lambda point: point / divisor * NORM_SCALE)))
    return let(x, scaled)
