"""Exact medians of columns of any size.

Spark's own ``median`` keeps a map of all distinct values in one task, which a data set of measured
doubles outgrows. Here the bits of a double, in an order-preserving form, are narrowed from the top:
each pass counts the values per next group of bits among those that share the bits found so far.
Tasks count whole Arrow batches and send one row per counted group; the data are never shuffled, a hot
value or class changes nothing, and outliers cost no extra pass. Once few enough values are left they
are picked directly, so a pass or two after the first are usual.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spectraloom.functions.kernels import matrices

LEVELS = (16, 14, 14, 14, 6)  # bits per pass; the first holds sign, exponent and four digits
PICK_LIMIT = 200_000
SIGN = np.uint64(1 << 63)


def sort_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the finite values."""
    values = values[np.isfinite(values)] + 0.0  # adding zero turns -0.0 into 0.0
    bits = values.view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def key_value(key: int) -> float:
    bits = np.array([key], dtype=np.uint64)
    return float(np.where(bits & SIGN, bits ^ SIGN, ~bits).view(np.float64)[0])


Extract = Callable[[pa.Array], np.ndarray]


def _count_level(df: DataFrame, extract: Extract, prefixes: list[int], taken: int, bits: int) -> dict[int, tuple]:
    """Per prefix: the next ``bits`` bits found below it, ascending, and how many values have them."""
    def count(batches):
        totals = np.zeros((len(prefixes), 1 << bits), dtype=np.int64)
        for batch in batches:
            keys = sort_keys(extract(batch.column(0)))
            for i, prefix in enumerate(prefixes):
                inside = keys[keys >> np.uint64(64 - taken) == np.uint64(prefix)] if taken else keys
                part = (inside >> np.uint64(64 - taken - bits)) & np.uint64((1 << bits) - 1)
                totals[i] += np.bincount(part.astype(np.int64), minlength=1 << bits)
        which, found = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(found), pa.array(totals[which, found])],
                                         names=["target", "part", "n"])

    table = (df.mapInArrow(count, "target long, part long, n long")
             .groupBy("target", "part").agg(F.sum("n").alias("n")).toArrow())
    target, part, n = (table.column(c).to_numpy() for c in ("target", "part", "n"))
    levels = {}
    for i, prefix in enumerate(prefixes):
        rows = np.flatnonzero(target == i)
        rows = rows[np.argsort(part[rows])]
        levels[prefix] = (part[rows], n[rows])
    return levels


def _pick(df: DataFrame, extract: Extract, prefixes: list[int], taken: int) -> dict[int, np.ndarray]:
    """All values below each prefix in ascending order (few by the caller's check)."""
    def keep(batches):
        for batch in batches:
            keys = sort_keys(extract(batch.column(0)))
            top = keys >> np.uint64(64 - taken)
            keys = keys[np.isin(top, np.array(prefixes, dtype=np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array((keys ^ SIGN).view(np.int64))], names=["key"])

    signed = df.mapInArrow(keep, "key long").toArrow().column("key").to_numpy()
    keys = np.sort(signed).view(np.uint64) ^ SIGN
    return {prefix: keys[keys >> np.uint64(64 - taken) == np.uint64(prefix)] for prefix in prefixes}


def _median(df: DataFrame, extract: Extract, pick_limit: int) -> float | None:
    """Median of the numbers that ``extract`` takes from the only column of ``df``."""
    targets: dict[int, list[int]] = {0: []}
    taken = 0
    for bits in LEVELS:
        levels = _count_level(df, extract, list(targets), taken, bits)
        if not taken:
            total = int(levels[0][1].sum())
            if not total:
                return None
            targets = {0: [(total - 1) // 2, total // 2]}
        narrowed: dict[int, list[int]] = {}
        left = 0
        for prefix, ranks in targets.items():
            part, n = levels[prefix]
            upto = np.cumsum(n)
            for rank in ranks:
                i = int(np.searchsorted(upto, rank, side="right"))
                key = (prefix << bits) | int(part[i])
                left += 0 if key in narrowed else int(n[i])
                narrowed.setdefault(key, []).append(rank - int(upto[i] - n[i]))
        targets, taken = narrowed, taken + bits
        if left <= pick_limit and taken < 64:
            values = _pick(df, extract, list(targets), taken)
            found = [key_value(int(values[prefix][rank])) for prefix, ranks in targets.items() for rank in ranks]
            return sum(found) / 2
    found = [key_value(prefix) for prefix, ranks in targets.items() for _ in ranks]
    return sum(found) / 2


def exact_median(df: DataFrame, value: Column, pick_limit: int = PICK_LIMIT) -> float | None:
    """Median of the finite values of ``value``; mean of the middle two for an even count."""
    numbers = df.select(value.cast("double").alias("v"))
    return _median(numbers, lambda column: column.drop_null().to_numpy(zero_copy_only=False), pick_limit)


def _differences(spectra: pa.Array) -> np.ndarray:
    found = [np.diff(matrix, axis=1).ravel() for _, matrix in matrices(spectra)]
    return np.concatenate(found) if found else np.empty(0)


def difference_stats(df: DataFrame, intensities: str = "intensities",
                     pick_limit: int = PICK_LIMIT) -> tuple[float | None, float | None]:
    """Median and median absolute deviation of the first differences of all spectra together."""
    spectra = df.select(intensities)
    median = _median(spectra, _differences, pick_limit)
    if median is None:
        return None, None
    return median, _median(spectra, lambda column: np.abs(_differences(column) - median), pick_limit)
