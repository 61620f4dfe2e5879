"""Descriptive statistics: counts, and mean curves with deviation bands.

Curves are aggregated per point with partial sums in every task, so a class that holds most rows
costs no more shuffle than a small one: each task sends one row per (class, point).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from spectraloom.operators.joins import join_small
from spectraloom.operators.labels import label_id
from spectraloom.operators.signal import explode_points


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_per_group(df: DataFrame, group: str, value: str, approximate: bool = False) -> DataFrame:
    """Number of distinct non-NULL values per group, e.g. cultures per species."""
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(counter(value).alias("n"))


def distinct_labels(df: DataFrame, label: str, key: str = "spectrum_id") -> DataFrame:
    """Distinct labels with the first id that carries them; order by ``first_id`` for a stable order."""
    return df.groupBy(label).agg(F.min(key).alias("first_id"))


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def _band(df: DataFrame, groups: Sequence[str], intensities: str, *extra) -> DataFrame:
    points = explode_points(df, [intensities], list(groups) + [c for c in df.columns if c.startswith("_keep")])
    value = F.nanvl(F.col(intensities), F.lit(None).cast("double"))
    return (points.groupBy(*groups, "idx")
            .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), *extra))


def _with_limits(df: DataFrame) -> DataFrame:
    return df.withColumns({"lower": F.col("mean") - F.col("std"), "upper": F.col("mean") + F.col("std")})


def mean_band(df: DataFrame, intensities: str = "intensities") -> DataFrame:
    """Mean and mean -/+ sample deviation per point over all spectra; missing points are left out."""
    return _with_limits(_band(df, [], intensities))


def class_offsets(df: DataFrame, label: str, delta: float, key: str = "spectrum_id") -> DataFrame:
    """Classes numbered in the order of their first id, times ``delta``. One row per class."""
    order = Window.orderBy("first_id")
    return (distinct_labels(df, label, key)
            .select(label, ((F.row_number().over(order) - 1) * F.lit(float(delta))).alias("offset")))


def class_mean_band(df: DataFrame, label: str, delta: float = 3.0, classes: Sequence[str] | None = None,
                    key: str = "spectrum_id", intensities: str = "intensities") -> DataFrame:
    """Mean curve and band per class, each class shifted by its rank times ``delta``.

    The rank is the position in ``classes``, else the order of first ids.
    """
    band = _band(df.select(label, intensities), [label], intensities)
    if classes is not None:
        band = band.withColumn("offset", label_id(F.col(label), classes) * F.lit(float(delta)))
    else:
        band = join_small(band, class_offsets(df, label, delta, key), [label])
    return _with_limits(band.withColumn("mean", F.col("mean") + F.col("offset")).drop("offset"))


def culture_mean_band(df: DataFrame, culture: str = "culture", label: str = "species", delta: float = 3.0,
                      classes: Sequence[str] | None = None, key: str = "spectrum_id",
                      intensities: str = "intensities") -> DataFrame:
    """Mean curve per culture. Its class is that of its first spectrum and shifts ``shifted_mean`` only."""
    first = F.min_by(label, key).alias(label)
    curves = _with_limits(_band(df.select(culture, intensities), [culture], intensities))
    classes_of = df.groupBy(culture).agg(first)
    if classes is not None:
        offset = label_id(F.col(label), classes) * F.lit(float(delta))
        joined = curves.join(classes_of, culture).withColumn("offset", offset)
    else:
        joined = join_small(curves.join(classes_of, culture), class_offsets(df, label, delta, key), [label])
    return joined.withColumn("shifted_mean", F.col("mean") + F.col("offset")).drop("offset")


def culture_means(df: DataFrame, culture: str = "culture", intensities: str = "intensities") -> DataFrame:
    """One mean spectrum per culture as an array again (input of the projection of cultures).

    A group here has one row per point, so the array is as long as a spectrum.
    """
    points = _band(df.select(culture, intensities), [culture], intensities)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "mean")))
    return (points.groupBy(culture).agg(ordered.alias("_p"))
            .select(culture, F.col("_p.mean").alias(intensities)))


def epoch_summary(log: DataFrame, metrics: Sequence[str], timestamp: str = "timestamp") -> DataFrame:
    """Mean of every metric per epoch, number of iterations and duration."""
    return (log.groupBy("epoch")
            .agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("iterations"),
                 (F.max(timestamp) - F.min(timestamp)).alias("duration")))


def last_n_mean(log: DataFrame, metrics: Sequence[str], n: int) -> DataFrame:
    """Mean over the last ``n`` iterations, reported at every ``n``-th iteration of an epoch.

    The reported windows do not overlap, so this is a grouping by (epoch, block), not a window over
    an epoch: a long epoch is spread over all tasks. An unfinished last block is not reported.
    """
    block = F.floor(F.col("iter") / n).alias("_block")
    return (log.groupBy("epoch", block)
            .agg(F.max("iter").alias("iter"), F.count("*").alias("_n"), *[F.avg(m).alias(m) for m in metrics])
            .where(F.col("_n") == n).drop("_block", "_n"))
