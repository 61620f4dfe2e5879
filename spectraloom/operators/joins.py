"""Key joins. Nothing is paired by row order; tables meet on ``spectrum_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from spectraloom.sinks.shared import SharedTables

SMALL_TABLE_ROWS = 20_000
SMALL_TABLE_BYTES = 32 * 1024 * 1024  # as written, compressed


def join_small(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
               max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Join a table that is expected to be small, NULL keys matching NULL keys.

    It is written to the shared folder, so it is computed once. Up to a number of rows and bytes it is broadcast, and
    ``df`` is not shuffled; beyond it the tables meet in a shuffle join. Its rows never pass through the driver.
    """
    renamed = table.withColumnsRenamed({key: f"_right_{key}" for key in on})
    kept = SharedTables(df.sparkSession, "small").keep(renamed, "table")
    if kept.limit(max_rows + 1).count() <= max_rows and written_bytes(kept) <= SMALL_TABLE_BYTES:
        kept = F.broadcast(kept)
    condition = [df[key].eqNullSafe(kept[f"_right_{key}"]) for key in on]
    return df.join(kept, condition, how).drop(*[f"_right_{key}" for key in on])


def written_bytes(kept: DataFrame) -> int:
    """Size of a written table's files, as the planner knows it."""
    return int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def assert_unique(df: DataFrame, key: str = "spectrum_id") -> DataFrame:
    """Fail when a key occurs twice (the same file stem in two folders would fan out every join)."""
    doubled = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if doubled:
        raise ValueError(f"{key} {doubled[0][key]!r} occurs {doubled[0]['count']} times; "
                         "use folder-qualified ids")
    return df


def join_metadata(spectra: DataFrame, metadata: DataFrame, key: str = "spectrum_id") -> DataFrame:
    """Spectra with their metadata. Both sides grow with the data, so no broadcast is forced:
    Catalyst broadcasts a side only when its statistics say it fits."""
    return spectra.join(metadata, key, "inner")


def predictions_table(projection: DataFrame, predictions: DataFrame, metadata: DataFrame,
                      label: str = "label", key: str = "spectrum_id") -> DataFrame:
    """``id, x, y, filename, label, pred_labelname, correct`` for every projected spectrum."""
    return (projection.select(key, "x", "y")
            .join(metadata.select(key, "filename", label), key)
            .join(predictions.select(key, "pred_labelname"), key)
            .select(F.col(key).alias("id"), "x", "y", "filename", F.col(label).alias("label"),
                    "pred_labelname", (F.col(label) == F.col("pred_labelname")).alias("correct")))
