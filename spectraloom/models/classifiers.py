"""Classifiers by method name. Training data: an array column and a label 0..K-1.

Every trainer returns a ``PipelineModel`` that adds a ``prediction`` column. Two methods are the exact
single-machine algorithm only up to a size, and its distributed counterpart beyond: the kernel SVM beyond its number of
landmarks, the perceptron beyond the rows of one block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from spectraloom import schema
from spectraloom.models import forest, kernel_machines
from spectraloom.models.stages import LinearScores, ToVector, WeightedVote
from spectraloom.session import ensure_checkpoint_dir


def _with_vector(df: DataFrame, fit) -> PipelineModel:
    to_vector = ToVector(inputCol="intensities", outputCol="features")
    return PipelineModel([to_vector, fit(to_vector.transform(df))])


def _size(df: DataFrame) -> tuple[int, int]:
    """Rows and classes."""
    rows, top = df.agg(F.count("*"), F.max("label")).first()
    if not rows:
        raise ValueError("no training rows")
    return rows, int(top) + 1


def kernel_width(df: DataFrame, intensities: str = "intensities") -> float:
    """``1 / (points * variance of all entries)``."""
    point_stats = df.select(Summarizer.metrics("mean", "variance", "count").summary(
        array_to_vector(F.col(intensities))).alias("s")).first()["s"]
    mean, variance, n = point_stats["mean"].toArray(), point_stats["variance"].toArray(), point_stats["count"]
    spread = float(np.mean(variance * (n - 1) / n + mean ** 2) - np.mean(mean) ** 2)
    return 1.0 / (len(mean) * spread) if spread > 0 else 1.0


def _svm(df, params, seed):
    df = df.where(F.col("intensities").isNotNull())
    marks = params.get("landmarks", params.get("num_features", kernel_machines.LANDMARKS))
    return PipelineModel([kernel_machines.fit_machines(
        df, kernel_width(df), float(params.get("C", 1000.0)), marks, seed, params.get("max_iter", kernel_machines.STEPS))])


def _random_forest(df, params, seed):
    depth = params.get("max_depth")
    return PipelineModel([forest.fit_forest(df, params.get("num_trees", 100), None if depth is None else int(depth), seed)])


def _logistic_regression(df, params, seed):
    n, _ = _size(df)
    penalty = params.get("penalty", "l2")
    if penalty not in ("l2", "l1", None):
        raise ValueError(f"unknown penalty {penalty!r}")
    strength = 0.0 if penalty is None else 1.0 / (float(params.get("C", 1.0)) * n)
    regression = LogisticRegression(regParam=strength, elasticNetParam=1.0 if penalty == "l1" else 0.0,
                                    standardization=False, family="multinomial",
                                    maxIter=params.get("max_iter", 100))
    return _with_vector(df, regression.fit)


PERCEPTRON_ROWS = 50_000  # that one task passes over by itself
PERCEPTRON_PASSES = 5     # between two averages


def perceptron_passes(weights: np.ndarray, x: np.ndarray, signs: np.ndarray, step: float, alpha: float,
                      passes: int) -> tuple[np.ndarray, float]:
    """Single-row steps of all classes' machines, and the mean loss of the last pass.

    The decay is kept as one factor per row, so that a step touches the machines that err only.
    """
    weights, factor = weights.copy(), 1.0
    for _ in range(passes):
        loss = 0.0
        for row, sign in zip(x, signs):
            margin = sign * (weights @ row) * factor
            factor *= 1.0 - step * alpha
            wrong = margin <= 0
            if wrong.any():
                loss -= float(margin[wrong].sum())
                weights[wrong, :] += (step / factor) * sign[wrong, None] * row
    return weights * factor, loss / max(len(x), 1)


def _perceptron_round(blocks: DataFrame, weights: np.ndarray, step: float, alpha: float, passes: int):
    """Weights averaged over the tasks by their rows, and the mean loss."""
    classes = len(weights)

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        x = np.concatenate([b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for b in held])
        labels = np.concatenate([b.column("label").to_numpy(zero_copy_only=False) for b in held]).astype(int)
        signs = np.where(labels[:, None] == np.arange(classes), 1.0, -1.0)
        new, loss = perceptron_passes(weights, np.hstack([x, np.ones((len(x), 1))]), signs, step, alpha, passes)
        sums = np.concatenate([new.ravel(), [loss, 1.0]]) * len(x)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["s"])

    sums = blocks.mapInArrow(run, "s array<double>")
    vectors = sums.select(array_to_vector("s").alias("s"), (F.spark_partition_id() % 64).alias("part"))
    level = vectors.groupBy("part").agg(Summarizer.sum(F.col("s")).alias("s"))
    total = level.agg(Summarizer.sum(F.col("s")).alias("s")).first()["s"].toArray()
    return (total[:-2] / total[-1]).reshape(weights.shape), total[-2] / total[-1]


def _perceptron(df, params, seed):
    """Stochastic steps on the perceptron loss with weight decay ``alpha``, one machine per class against the rest.

    Rows are dealt to blocks of about PERCEPTRON_ROWS by a hash of their content and passed over in the order of that
    hash, so the result does not depend on how the table is partitioned. After PERCEPTRON_PASSES passes the blocks'
    weights are averaged by their rows. The step is cut to a fifth when the loss has not fallen for that many passes;
    below 1e-6 the training ends, or after ``max_iter`` passes. Up to PERCEPTRON_ROWS rows it is one machine's training.
    """
    df = df.where(F.col("intensities").isNotNull())
    n, classes = _size(df)
    points = df.select(F.max(F.size("intensities"))).first()[0]
    alpha, tolerance = float(params.get("alpha", 0.1)), params.get("tol", 1e-3)
    step, least, most = params.get("eta0", 0.001), params.get("least_step", 1e-6), params.get("max_iter", 500)
    blocks = max(1, math.ceil(n / PERCEPTRON_ROWS))
    hashed = df.select(F.xxhash64("intensities", "label", F.lit(seed)).alias("h"), F.col("intensities").alias("x"), "label")
    dealt = hashed.repartition(blocks, "h").sortWithinPartitions("h", "label").drop("h").persist(StorageLevel.MEMORY_AND_DISK)
    weights, best, passed = np.zeros((classes, points + 1)), math.inf, 0
    try:
        while passed < most and step > least:
            passes = min(PERCEPTRON_PASSES, most - passed)
            weights, loss = _perceptron_round(dealt, weights, step, alpha, passes)
            passed += passes
            if loss > best - tolerance:
                step /= 5.0
            best = min(best, loss)
    finally:
        dealt.unpersist()
    return PipelineModel([LinearScores(inputCol="intensities", outputCol="prediction", weights=weights.tolist())])


def _boosting(df, params, seed):
    """Multi-class AdaBoost over shallow trees. Row weights live in the table; each round is one fit and
    one sum. Lineage is cut on reliable storage every ``checkpoint_every`` rounds."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)  # read once per round
    n, classes = _size(df)
    rate, rounds = params.get("learning_rate", 0.01), params.get("rounds", 50)
    every = params.get("checkpoint_every", 10)
    to_vector = ToVector(inputCol="intensities", outputCol="features")
    weighted = to_vector.transform(df).select("features", "label", F.lit(1.0).alias("weight"))
    trees, alphas, names = [], [], []
    for m in range(rounds):
        name = f"tree_{m}"
        tree = DecisionTreeClassifier(maxDepth=params.get("boosting_depth", 2), weightCol="weight", seed=seed + m,
                                      predictionCol=name, rawPredictionCol=f"raw_{m}", probabilityCol=f"p_{m}"
                                      ).fit(weighted)
        tree.setRawPredictionCol("").setProbabilityCol("")
        miss = (F.col(name) != F.col("label")).cast("double")
        scored = tree.transform(weighted)
        total, wrong = scored.agg(F.sum("weight"), F.sum(F.col("weight") * miss)).first()
        error = wrong / total
        if error >= 1.0 - 1.0 / classes:
            if not trees:
                raise ValueError("the first tree is no better than chance; boosting cannot start")
            break
        trees.append(tree)
        names.append(name)
        if error <= 0:
            alphas.append(1.0)
            break
        alpha = rate * (math.log((1.0 - error) / error) + math.log(classes - 1.0))
        alphas.append(alpha)
        weighted = scored.select("features", "label",
                                 (F.col("weight") * F.exp(alpha * miss) / (total / n)).alias("weight"))
        if (m + 1) % every == 0 and m + 1 < rounds:
            ensure_checkpoint_dir(df.sparkSession)
            weighted = weighted.checkpoint()
    df.unpersist()
    vote = WeightedVote(outputCol="prediction", voters=names, voteWeights=alphas, numClasses=classes)
    return PipelineModel([to_vector, *trees, vote])


METHODS = {
    schema.METHOD_SVM: _svm,
    schema.METHOD_RANDOM_FOREST: _random_forest,
    schema.METHOD_LOGISTIC_REGRESSION: _logistic_regression,
    schema.METHOD_PERCEPTRON: _perceptron,
    schema.METHOD_BOOSTING: _boosting,
}


@dataclass(frozen=True)
class Trainer:
    method: str
    params: dict = field(default_factory=dict)
    seed: int = 0

    def fit(self, df: DataFrame, label: str = "y", intensities: str = "intensities") -> PipelineModel:
        rows = df.select(F.col(intensities).alias("intensities"), F.col(label).cast("double").alias("label"))
        return METHODS[self.method](rows, self.params, self.seed)


def get_model(method: str, params: dict | None = None, seed: int = 0) -> Trainer:
    if method not in METHODS:
        raise ValueError(f"unknown classification method {method!r}")
    return Trainer(method, dict(params or {}), seed)


HELPERS = ("features", "rawPrediction", "probability")


def predict(model: PipelineModel, df: DataFrame, output: str = "y_pred") -> DataFrame:
    """``df`` with the predicted class id as an integer column."""
    scored = model.transform(df)
    return scored.withColumn(output, F.col("prediction").cast("int")).drop("prediction", *HELPERS)
