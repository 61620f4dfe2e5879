"""Folder metadata: sidecar JSON, fallbacks and precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spectraloom.operators.joins import join_small
from spectraloom.operators.labels import first_match, join_label_list

DEFAULT_NULL = ("growth_time", "substrate", "strain")
SIDECAR_KEYS = ("source", "species", "pcr")
PATH_KEYS = ("measurement", "filename", "spectrum_id")


def parse_sidecar(text: Column) -> Column:
    """JSON object as a string map; NULL when the text is not a JSON object."""
    return F.from_json(text, "map<string,string>")


def attach_sidecar(files: DataFrame, sidecars: DataFrame, species: Sequence[str], fallback_source: str,
                   key: str = "folder", sidecar: str = "sidecar", text: str | None = None) -> DataFrame:
    """Left-join the sidecar map of each folder.

    Without one, the species is the first listed name found in ``text`` (default: the folder) and the
    source is ``fallback_source``; files with neither are dropped.
    """
    joined = join_small(files, sidecars.select(key, sidecar).where(F.col(sidecar).isNotNull()), [key])
    fallback = first_match(F.col(text or key), species)
    made = F.create_map(F.lit("source"), F.lit(fallback_source), F.lit("species"), fallback,
                        F.lit("pcr"), F.lit(None).cast("string"))
    return joined.withColumn(sidecar, F.when(F.col(sidecar).isNotNull(), F.col(sidecar))
                             .when(fallback.isNotNull(), made)).where(F.col(sidecar).isNotNull())


def metadata_columns(files: DataFrame, sidecar: str = "sidecar") -> DataFrame:
    """Explicit columns with precedence: NULL defaults, then path fields, then sidecar keys.

    A sidecar key overrides even with a null value. The sample comes from the folder name alone.
    Other sidecar keys stay in the map column ``extra``.
    """
    keys = F.col(sidecar)

    def resolve(name: str) -> Column:
        below = F.col(name) if name in PATH_KEYS else F.lit(None).cast("string")
        return F.when(F.map_contains_key(keys, name), F.try_element_at(keys, F.lit(name))).otherwise(below)

    known = [*DEFAULT_NULL, *PATH_KEYS, *SIDECAR_KEYS]
    columns = {name: resolve(name) for name in known}
    columns["pcr"] = join_label_list(columns["pcr"])
    columns["extra"] = F.map_filter(keys, lambda name, _: ~name.isin([*known, "sample"]))
    return files.withColumns(columns).drop(sidecar)
