"""Folders of spectrum text files as one scan. Files are the unit of parallelism."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spectraloom.sources import sidecar as sidecars
from spectraloom.sources.paths import path_fields

# 0-based columns of (wavenumber, intensity) in the column layouts, and the folder of old forms.
COLUMN_LAYOUTS = {"oem": (1, 2), "oem_oldform": (2, 3)}
OLD_FORM_FOLDER = "OldForm"


def _rows(text: Column) -> Column:
    """Lines without comments and blanks, as in a plain numeric text table."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(F.regexp_replace(line, r"#.*$|\t", " ")))
    return F.filter(lines, lambda line: line != "")


def _numbers(line: Column) -> Column:
    return F.transform(F.split(F.trim(line), r"\s+"), lambda token: token.cast("double"))


def parse_spectrum(text: Column, layout: str) -> Column:
    """Struct of ``wavenumbers, intensities``. A token that is not a number fails the job."""
    rows = _rows(text)
    if layout == "two_row":
        axis, values = _numbers(F.get(rows, F.lit(0))), _numbers(F.get(rows, F.lit(1)))
    elif layout in COLUMN_LAYOUTS:
        at = lambda k: F.transform(rows, lambda line: F.split(line, r"\s+")[k].cast("double"))
        axis, values = (at(k) for k in COLUMN_LAYOUTS[layout])
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return F.struct(axis.alias("wavenumbers"), values.alias("intensities"))


def _scan(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return (spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
            .select(path.alias("path"), "value"))


def read_spectrum_files(spark: SparkSession, root: str, layout: str = "two_row") -> DataFrame:
    """All ``root/<folder>/*.txt`` with path columns and points.

    With the ``oem`` layout, ``root/<folder>/OldForm/*.txt`` are read in the old column order as well.
    """
    parts = F.split(F.col("path"), "/")
    depth = len([p for p in root.split("://")[-1].split("/") if p]) + 2
    levels = F.size(F.filter(F.split(F.regexp_replace("path", r"^[a-z0-9+.-]+:/*(?=/)", ""), "/"), lambda p: p != ""))
    old = (levels == depth + 1) & (F.get(parts, F.size(parts) - 2) == OLD_FORM_FOLDER)
    files = _scan(spark, root, "*.txt").withColumn("old_form", old)
    if layout == "oem":
        files = files.where((levels == depth) | F.col("old_form"))
        parsed = F.when(F.col("old_form"), parse_spectrum(F.col("value"), "oem_oldform")).otherwise(
            parse_spectrum(F.col("value"), "oem"))
    else:
        files = files.where(levels == depth)
        parsed = parse_spectrum(F.col("value"), layout)
    folder = F.get(parts, F.size(parts) - F.when(F.col("old_form"), 3).otherwise(2))
    files = files.withColumns(path_fields(F.col("path"), folder)).withColumn("parsed", parsed)
    same = F.size("parsed.wavenumbers") == F.size("parsed.intensities")
    checked = F.when(same, F.col("parsed.intensities")).otherwise(F.raise_error(F.concat(
        F.lit("wavenumbers and intensities differ in length: "), F.col("path"))).cast("array<double>"))
    return (files.withColumns({"wavenumbers": F.col("parsed.wavenumbers"), "intensities": checked})
            .drop("value", "parsed", "old_form"))


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """``folder, sidecar`` for every ``metadata.json`` that holds a JSON object."""
    parts = F.split(F.col("path"), "/")
    return (_scan(spark, root, "metadata.json")
            .select(F.get(parts, F.size(parts) - 2).alias("folder"),
                    sidecars.parse_sidecar(F.col("value")).alias("sidecar")))


def read_dataset(spark: SparkSession, root: str, species: Sequence[str], fallback_source: str,
                 layout: str = "two_row", qualify_ids: bool = False) -> DataFrame:
    """Spectra with metadata, one row per file.

    ``qualify_ids`` puts the folder in front of the id, for data where a stem occurs in two folders.
    """
    files = read_spectrum_files(spark, root, layout)
    files = sidecars.attach_sidecar(files, read_sidecars(spark, root), species, fallback_source)
    table = sidecars.metadata_columns(files)
    if qualify_ids:
        table = table.withColumn("spectrum_id", F.concat_ws("/", "folder", "spectrum_id"))
    return table


def assert_common_axis(df: DataFrame, wavenumbers: str = "wavenumbers") -> DataFrame:
    """Fail unless all spectra share one frequency axis."""
    low, high = df.agg(F.min(wavenumbers), F.max(wavenumbers)).first()
    if low != high:
        raise ValueError("spectra have different frequency axes; resample them first")
    return df
