"""Arrow kernels: numpy on a whole batch of spectra, for the steps that are dense linear algebra.

Array lambdas cost about 0.25 microseconds per point for an 11-point filter, the same filter on an

Kernels are applied with ``mapInArrow``, not as column functions: Catalyst would merge a column
function with the array lambdas before and after it, and cannot hand nested lambdas to Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T


def matrices(spectra: pa.Array):
    """Yield ``(row numbers, matrix)`` for each length found in a batch; NULL rows are left out.

    All spectra of a data set share one length as a rule, so there is one matrix per batch.
    """
    lengths = spectra.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    points = spectra.flatten()
    values = points.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]]).astype(np.int64)
    for length in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == length)
        if len(rows) == len(lengths):
            yield rows, values.reshape(len(rows), length)
        else:
            yield rows, values[starts[rows, None] + np.arange(length)]


def to_lists(results: list[tuple[np.ndarray, np.ndarray]], total: int) -> pa.ListArray:
    """Matrices with their row numbers back to one list column; rows without a result are NULL."""
    lengths = np.full(total, -1, dtype=np.int64)
    for rows, matrix in results:
        lengths[rows] = matrix.shape[1]
    offsets = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    values = np.empty(offsets[-1])
    for rows, matrix in results:
        if len(rows) == total:
            values = np.ascontiguousarray(matrix).ravel()
        elif matrix.size:
            values[offsets[rows, None] + np.arange(matrix.shape[1])] = matrix
    missing = pa.array(lengths < 0) if (lengths < 0).any() else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=missing)


def map_matrix(spectra: pa.Array, kernel: Callable[[np.ndarray], np.ndarray]) -> pa.ListArray:
    return to_lists([(rows, kernel(matrix)) for rows, matrix in matrices(spectra)], len(spectra))


def add_columns(df: DataFrame, column: str, outputs: dict[str, T.DataType],
                kernel: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Add or replace the ``outputs`` computed from one column, batch by batch; no shuffle."""
    fields = {field.name: field for field in df.schema.fields}
    fields.update({name: T.StructField(name, kind) for name, kind in outputs.items()})

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            columns.update(zip(outputs, kernel(columns[column])))
            yield pa.RecordBatch.from_arrays([columns[name] for name in fields], names=list(fields))

    return df.mapInArrow(run, T.StructType(list(fields.values())))
