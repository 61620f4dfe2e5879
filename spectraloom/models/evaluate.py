"""Cross-validation, multi-label models, reports, scoring of saved models, 2-D projection."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from spectraloom.models.classifiers import Trainer, predict
from spectraloom.models.stages import ToVector
from spectraloom.operators import metrics, splits
from spectraloom.session import ensure_checkpoint_dir


@dataclass
class CrossValidation:
    """Out-of-fold predictions of every row and the scores per fold. ``close`` frees the cached features."""

    predictions: DataFrame
    scores: DataFrame
    features: DataFrame

    def close(self) -> None:
        self.features.unpersist()


def cross_validate(df: DataFrame, trainer: Trainer, label: str = "y", k: int = 5, key: str = "spectrum_id",
                   seed: int = 0, intensities: str = "intensities", parallelism: int = 2) -> CrossValidation:
    """Stratified k-fold with one fit per fold; predictions and scores come from the same fits."""
    folded = splits.stratified_folds(df, label, k, key, seed).persist(StorageLevel.MEMORY_AND_DISK)

    @inheritable_thread_target(df.sparkSession)
    def run(fold: int) -> DataFrame:
        model = trainer.fit(folded.where(F.col("fold") != fold), label, intensities)
        return predict(model, folded.where(F.col("fold") == fold))

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(run, range(k)))
    predictions = reduce(DataFrame.unionByName, parts)
    return CrossValidation(predictions, metrics.cv_scores(predictions, label), folded)


def train_test_report(df: DataFrame, trainer: Trainer, label: str = "y", role: str = "role",
                      intensities: str = "intensities") -> tuple[PipelineModel, DataFrame]:
    """Fit on the rows with role ``train`` and give the accuracy of every role."""
    model = trainer.fit(df.where(F.col(role) == "train"), label, intensities)
    return model, metrics.accuracy(predict(model, df), label, "y_pred", [role])


def fit_multilabel(df: DataFrame, trainer: Trainer, n_labels: int, targets: str = "targets",
                   intensities: str = "intensities") -> list[PipelineModel]:
    """One binary classifier per label on a shared cached table."""
    cached = df.select(intensities, targets).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return [trainer.fit(cached.withColumn("_y", F.get(targets, F.lit(k))), "_y", intensities)
                for k in range(n_labels)]
    finally:
        cached.unpersist()


def predict_multilabel(models: Sequence[PipelineModel], df: DataFrame, output: str = "predicted") -> DataFrame:
    """0/1 array with the decision of every label's classifier."""
    for k, model in enumerate(models):
        df = predict(model, df, f"_label_{k}")
    names = [f"_label_{k}" for k in range(len(models))]
    return df.withColumn(output, F.array(*names)).drop(*names)


def fit_multilabel_network(df: DataFrame, n_labels: int, targets: str = "targets", intensities: str = "intensities",
                           hidden: Sequence[int] = (32, 32), max_iter: int = 50, seed: int = 0) -> PipelineModel:
    """One feed-forward network per label, each giving the probability of its label.

    A counterpart of one network with a sigmoid output per label: hidden units are sigmoid, the loss is
    the same cross-entropy, the optimiser is L-BFGS.
    """
    points = df.select(F.max(F.size(intensities))).first()[0]
    to_vector = ToVector(inputCol=intensities, outputCol="features")
    cached = to_vector.transform(df).select("features", targets).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        networks = []
        for k in range(n_labels):
            rows = cached.select("features", F.get(targets, F.lit(k)).cast("double").alias("label"))
            network = MultilayerPerceptronClassifier(
                layers=[points, *hidden, 2], maxIter=max_iter, seed=seed + k, probabilityCol=f"_p_{k}",
                predictionCol=f"_c_{k}", rawPredictionCol=f"_r_{k}")
            networks.append(network.fit(rows))
        return PipelineModel([to_vector, *networks])
    finally:
        cached.unpersist()


def label_probabilities(model: PipelineModel, df: DataFrame, output: str = "probabilities") -> DataFrame:
    scored = model.transform(df)
    labels = range(len(model.stages) - 1)
    helpers = [f"_{kind}_{k}" for kind in "pcr" for k in labels]
    return (scored.withColumn(output, F.array(*[vector_to_array(f"_p_{k}")[1] for k in labels]))
            .drop("features", *helpers))


def save_model(model: PipelineModel, folder: str, spark: SparkSession, meta: Mapping[str, object] | None = None) -> None:
    """Save the model and one row of metadata next to it."""
    model.write().overwrite().save(f"{folder}/model")
    spark.createDataFrame([{k: str(v) for k, v in (meta or {"note": ""}).items()}]).write.mode("overwrite").json(f"{folder}/meta")


def load_model(folder: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{folder}/model"), spark.read.json(f"{folder}/meta").first().asDict()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"


def project_2d(df: DataFrame, key: str = "spectrum_id", intensities: str = "intensities") -> DataFrame:
    """``key, x, y``: the first two principal components (in place of a single-machine embedding).

    The sign of a component is fixed by its largest loading, so results do not flip between runs.
    """
    rows = df.select(key, array_to_vector(F.col(intensities)).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="projected").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    projected = vector_to_array(F.col("projected"))
    return (model.transform(rows)
            .select(key, (projected[0] * signs[0]).alias("x"), (projected[1] * signs[1]).alias("y")))
