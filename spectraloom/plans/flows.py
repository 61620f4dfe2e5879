"""The end-to-end jobs: prepare a data set, describe it, classify with cross-validation, train and test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from spectraloom.models import embedding, evaluate
from spectraloom.models.classifiers import get_model
from spectraloom.operators import joins, labels, metrics, signal, stats
from spectraloom.schema import METADATA
from spectraloom.sinks import tables as sinks
from spectraloom.sources.files import read_dataset


PROJECTIONS = {"neighbours": embedding.embed_2d, "principal": evaluate.project_2d}


def prepare(spark: SparkSession, root: str, out: str, species: Sequence[str], fallback_source: str,
            layout: str = "two_row", n_splits: int = 3, train_size: float = 0.8, seed: int = 0) -> None:
    """Read folders of files once, write spectra, metadata and grouped splits by sample."""
    table = read_dataset(spark, root, species, fallback_source, layout)
    sinks.write_spectra(table, out, METADATA.fieldNames())
    metadata = spark.read.parquet(f"{out}/metadata")
    joins.assert_unique(metadata)
    sinks.write_splits(metadata, f"{out}/splits", "sample", n_splits, train_size, seed)


def describe(table: DataFrame, species: Sequence[str] | None = None, cultures: Sequence[str] | None = None,
             delta: float = 3.0) -> dict[str, DataFrame]:
    """Tables behind the data view: counts, mean curves of everything, of classes and of cultures."""
    if species is not None:
        table = labels.keep_values(table, "species", species)
    if cultures is not None:
        table = labels.keep_values(table, "culture", cultures)
    return {
        "total": stats.total_count(table),
        "spectra_per_species": stats.class_counts(table, "species"),
        "cultures_per_species": stats.distinct_per_group(table, "species", "culture"),
        "mean": stats.mean_band(table),
        "species_means": stats.class_mean_band(table, "species", delta),
        "culture_means": stats.culture_mean_band(table, delta=delta),
        "culture_plane": embedding.embed_2d(stats.culture_means(table), "culture"),
        "culture_sizes": stats.group_sizes(table, ["culture", "species", "measurement"]),
    }


@dataclass
class Classification:
    tables: Mapping[str, DataFrame]
    cached: Sequence[DataFrame]

    def close(self) -> None:
        for df in self.cached:
            df.unpersist()


def classify(table: DataFrame, level: str, classes: Sequence[str], method: str, params: dict | None = None,
             steps: Sequence[tuple[str, dict]] = (), k: int = 5, seed: int = 0,
             projection: str = "neighbours") -> Classification:
    """Select classes, clean, cross-validate, and give all tables that are shown or exported.

    ``projection``: ``neighbours`` (near spectra stay near) or ``principal`` (the first two components).
    """
    if len(classes) < 2:
        raise ValueError("the number of classes has to be greater than one")
    if projection not in PROJECTIONS:
        raise ValueError(f"projection is one of {sorted(PROJECTIONS)}, not {projection!r}")
    raw = labels.encode_labels(table, classes, level)
    cleaned = signal.preprocess(raw, steps).persist(StorageLevel.MEMORY_AND_DISK)
    done = evaluate.cross_validate(cleaned, get_model(method, params, seed), k=k, seed=seed)
    predictions = done.predictions.select("spectrum_id", "fold", "y", "y_pred").persist(StorageLevel.MEMORY_AND_DISK)
    named = labels.decode_labels(predictions, classes, "y_pred", "pred_labelname")
    ids = list(range(len(classes)))
    per_class = metrics.sens_spec(predictions, ids)
    name = F.coalesce(labels.label_name(F.col("class").try_cast("int"), classes), F.col("class"))
    plane = PROJECTIONS[projection](cleaned)
    return Classification({
        "spectra_raw": raw.select("spectrum_id", "intensities"),
        "spectra_proc": cleaned.select("spectrum_id", "intensities"),
        "projection": plane,
        "confmat": metrics.confusion_matrix(predictions, ids),
        "confmat_norm": metrics.confusion_matrix_norm(predictions, ids),
        "per_class": per_class.withColumn("class", name),
        "accuracy": metrics.accuracy(predictions),
        "cv_scores": metrics.cv_scores(predictions),
        "predictions": joins.predictions_table(plane, named, raw, level),
    }, [cleaned, predictions, done.features])
