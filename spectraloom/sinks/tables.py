"""Writers. Tables stay Parquet; the wide one-column-per-wavenumber form exists in CSV only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from spectraloom.operators.splits import group_shuffle_split
from spectraloom.sources.files import assert_common_axis


def spectra_to_wide(df: DataFrame, key: str = "spectrum_id", wavenumbers: str = "wavenumbers",
                    intensities: str = "intensities") -> DataFrame:
    """One column per wavenumber, then the id. All spectra must share the axis."""
    axis = assert_common_axis(df, wavenumbers).select(wavenumbers).first()
    if axis is None:
        raise ValueError("no spectra to write")
    points = [F.get(F.col(intensities), F.lit(i)).alias(str(w)) for i, w in enumerate(axis[0])]
    return df.select(*points, key)


def write_spectra(df: DataFrame, folder: str, meta_columns: Sequence[str], form: str = "parquet",
                  mode: str = "errorifexists") -> None:
    """Write ``folder/spectra`` and ``folder/metadata``, keyed by ``spectrum_id``.

    The Parquet spectra keep their metadata columns too: source files are parsed once, the metadata
    table is a column-pruned copy, and most readers need no join. CSV is the exchange format.
    """
    if form == "parquet":
        columns = list(dict.fromkeys(["spectrum_id", *meta_columns, "wavenumbers", "intensities"]))
        df.select(*columns).write.mode(mode).parquet(f"{folder}/spectra")
        written = df.sparkSession.read.parquet(f"{folder}/spectra")
        written.select(*meta_columns).write.mode(mode).parquet(f"{folder}/metadata")
    elif form == "csv":
        spectra_to_wide(df).write.mode(mode).option("header", True).csv(f"{folder}/spectra.csv")
        df.select(*meta_columns).write.mode(mode).option("header", True).csv(f"{folder}/metadata.csv")
    else:
        raise ValueError(f"form must be 'parquet' or 'csv', got {form!r}")


def write_splits(metadata: DataFrame, folder: str, group: str = "sample", n_splits: int = 3,
                 train_size: float = 0.8, seed: int = 0, mode: str = "errorifexists") -> None:
    """Train and validation metadata per split, one folder per (split, role)."""
    splits = group_shuffle_split(metadata, group, n_splits, train_size, seed)
    splits.write.mode(mode).partitionBy("split", "role").parquet(folder)


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "spectrum_id",
                   mode: str = "errorifexists") -> None:
    """Save as a table bucketed by the key: later joins of such tables on the key need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def export_results(results: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One CSV folder per result. Array columns are written as space separated numbers."""
    for name, df in results.items():
        flat = [F.array_join(F.transform(field.name, lambda v: v.cast("string")), " ").alias(field.name)
                if field.dataType.typeName() == "array" else F.col(field.name) for field in df.schema.fields]
        df.select(*flat).write.mode(mode).option("header", True).csv(f"{folder}/{name}")
