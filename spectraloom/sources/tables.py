"""Processed tables: wide CSV pairs, legacy tab files, and the data-set registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spectraloom.sources.files import read_dataset


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def wide_to_spectra(df: DataFrame, keys: Sequence[str] = ("spectrum_id",), drop: Sequence[str] = ()) -> DataFrame:
    """One column per wavenumber to one array per spectrum; the axis comes from the column names."""
    points = [c for c in df.columns if c not in keys and c not in drop]
    axis = F.array(*[F.lit(float(c)) for c in points])
    values = F.array(*[_quoted(c).cast("double") for c in points])
    return df.select(*keys, axis.alias("wavenumbers"), values.alias("intensities"))


def to_long(df: DataFrame, key: str, points: str, value: str = "value", index: str = "idx") -> DataFrame:
    return df.select(key, F.posexplode(points).alias(index, value))


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_wide_csv(spark: SparkSession, path: str, drop: Sequence[str] = ("measurement",)) -> DataFrame:
    """Wide spectra CSV: numeric columns named by wavenumber and ``spectrum_id``; malformed rows fail."""
    names = _header(spark, path, ",")
    text = {"spectrum_id", *drop}
    schema = T.StructType([T.StructField(n, T.StringType() if n in text else T.DoubleType()) for n in names])
    wide = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return wide_to_spectra(wide, drop=[d for d in drop if d in names])


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    names = _header(spark, path, ",")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def union_groups(members: Sequence[tuple[DataFrame, str, str, str]], row_id: str) -> DataFrame:
    """Stack tables as ``group, target, filename, id_in_file`` plus their common columns.

    Each member is (table, group, target, file name).
    """
    parts = [df.withColumnRenamed(row_id, "id_in_file")
               .withColumns({"group": F.lit(group), "target": F.lit(target), "filename": F.lit(name)})
             for df, group, target, name in members]
    return reduce(DataFrame.unionByName, parts)


def read_group_files(spark: SparkSession, root: str, groups: Mapping[str, Mapping]) -> DataFrame:
    """Legacy tab files: ``groups`` maps a group to its ``fnames`` and ``target``.

    The first column of a file is its row id, the others are wavenumbers.
    """
    members = []
    for group, spec in groups.items():
        for name in spec["fnames"]:
            path = f"{root}/{name}"
            first, *points = _header(spark, path, "\t")
            schema = T.StructType([T.StructField("row_id", T.StringType())]
                                  + [T.StructField(p, T.DoubleType()) for p in points])
            table = (spark.read.schema(schema).option("header", True).option("sep", "\t")
                     .option("mode", "FAILFAST").option("enforceSchema", True).csv(path))
            members.append((wide_to_spectra(table, keys=("row_id",)), group, spec["target"], name))
    rows = union_groups(members, "row_id")
    return rows.withColumn("is_target", F.when(F.col("target") == "notarget", "no target").otherwise("target"))


@dataclass(frozen=True)
class DataSet:
    """Registry entry. ``layout``: a file layout, ``processed`` (CSV pair) or ``groups`` (tab files)."""

    path: str
    layout: str = "two_row"
    species: Sequence[str] = ()
    fallback_source: str = "unknown"
    groups: Mapping[str, Mapping] = field(default_factory=dict)
    options: Mapping[str, object] = field(default_factory=dict)


def load_dataset(spark: SparkSession, name: str, registry: Mapping[str, DataSet]) -> DataFrame:
    """Spectra and metadata of a registered data set in one table."""
    if name not in registry:
        raise KeyError(f"unknown data set {name!r}; registered: {sorted(registry)}")
    entry = registry[name]
    if entry.layout == "groups":
        return read_group_files(spark, entry.path, entry.groups)
    if entry.layout == "processed":
        spectra = read_wide_csv(spark, f"{entry.path}/spectra.csv")
        return spectra.join(read_metadata_csv(spark, f"{entry.path}/metadata.csv"), "spectrum_id")
    return read_dataset(spark, entry.path, entry.species, entry.fallback_source, entry.layout, **entry.options)
