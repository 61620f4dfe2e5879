"""Columns read off a spectrum file's path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MEASUREMENT_SUFFIX = 7  # fixed value: characters at the end of a stem that number the single shot


def file_name(path: Column) -> Column:
    return F.get(F.slice(F.split(path, "/"), -1, 1), F.lit(0))


def file_stem(name: Column) -> Column:
    return F.when(F.rlike(name, F.lit(r"^.+\.[^.]*$")), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def measurement(stem: Column) -> Column:
    return F.substring(stem, F.lit(1), F.greatest(F.length(stem) - MEASUREMENT_SUFFIX, F.lit(0)))


def shot_index(name: Column) -> Column:
    """Last two digits of the second-last ``_`` part; NULL when the name has no such part."""
    parts = F.split(name, "_")
    part = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))
    return F.substring(part, -2, 2).try_cast("int")


def sample_id(folder: Column) -> Column:
    """Second part of ``date_sample``, else the first part of the folder name."""
    parts = F.split(folder, "_")
    return F.when(F.size(parts) == 2, parts[1]).otherwise(parts[0])


def path_fields(path: Column, folder: Column | None = None) -> dict[str, Column]:
    name = file_name(path)
    stem = file_stem(name)
    parts = F.split(path, "/")
    folder = F.get(parts, F.size(parts) - 2) if folder is None else folder
    return {"filename": name, "spectrum_id": stem, "measurement": measurement(stem),
            "idx": shot_index(name), "folder": folder, "sample": sample_id(folder)}
