"""Pipeline stages on array columns. All state is in Params, so pipelines of them save and load as usual."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F, types as T

from spectraloom.functions.kernels import add_columns, map_matrix, matrices
from spectraloom.operators import signal


class ToVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Array of points to an MLlib vector."""

    @keyword_only
    def __init__(self, *, inputCol="intensities", outputCol="features"):
        super().__init__()
        self._setDefault(inputCol="intensities", outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(F.col(self.getInputCol())))


class CleaningStep(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """One named cleaning step with numeric parameters; despiking judges by the data it transforms."""

    step = Param(Params._dummy(), "step", "name of the step", TypeConverters.toString)
    names = Param(Params._dummy(), "names", "parameter names", TypeConverters.toListString)
    values = Param(Params._dummy(), "values", "parameter values", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol="intensities", step="normalize", names=None, values=None):
        super().__init__()
        self._setDefault(inputCol="intensities", step="normalize", names=[], values=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.getOrDefault(self.step)
        params = dict(zip(self.getOrDefault(self.names), self.getOrDefault(self.values)))
        whole = {k: int(v) if float(v).is_integer() else v for k, v in params.items()}
        return signal.preprocess(df, [(name, whole)], self.getInputCol())


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed,
                            DefaultParamsReadable, DefaultParamsWritable):
    """Seeded random features whose dot products approximate the kernel ``exp(-gamma |x - y|^2)``."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="intensities", outputCol="features", gamma=1.0, numFeatures=256, seed=0):
        super().__init__()
        self._setDefault(inputCol="intensities", outputCol="features", gamma=1.0, numFeatures=256, seed=0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, width, seed = self.getOrDefault(self.gamma), self.getOrDefault(self.numFeatures), self.getSeed()

        def project(x: np.ndarray) -> np.ndarray:
            rng = np.random.default_rng(seed)
            shift = rng.uniform(0.0, 2.0 * np.pi, width)
            directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (x.shape[1], width))
            return np.sqrt(2.0 / width) * np.cos(x @ directions + shift)

        out = self.getOutputCol()
        projected = add_columns(df, self.getInputCol(), {out: T.ArrayType(T.DoubleType())},
                                lambda spectra: [map_matrix(spectra, project)])
        return projected.withColumn(out, array_to_vector(F.col(out)))


class LinearScores(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Class with the highest linear score. One weight row per class, the intercept last."""

    weights = Param(Params._dummy(), "weights", "one row per class", TypeConverters.toListListFloat)

    @keyword_only
    def __init__(self, *, inputCol="intensities", outputCol="prediction", weights=None):
        super().__init__()
        self._setDefault(inputCol="intensities", outputCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        w = np.array(self.getOrDefault(self.weights))

        def predict(spectra: pa.Array) -> list[pa.Array]:
            best = np.zeros(len(spectra))
            for rows, x in matrices(spectra):
                best[rows] = np.argmax(x @ w[:, :-1].T + w[:, -1], axis=1)
            return [pa.array(best, mask=spectra.is_null().to_numpy(zero_copy_only=False))]

        return add_columns(df, self.getInputCol(), {self.getOutputCol(): T.DoubleType()}, predict)


class WeightedVote(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Class with the largest sum of voter weights."""

    voters = Param(Params._dummy(), "voters", "prediction columns", TypeConverters.toListString)
    voteWeights = Param(Params._dummy(), "voteWeights", "one weight per voter", TypeConverters.toListFloat)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, outputCol="prediction", voters=None, voteWeights=None, numClasses=2):
        super().__init__()
        self._setDefault(outputCol="prediction", numClasses=2)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        voters = self.getOrDefault(self.voters)
        pairs = list(zip(voters, self.getOrDefault(self.voteWeights)))
        scores = F.array(*[sum((F.when(F.col(v) == k, w).otherwise(0.0) for v, w in pairs), F.lit(0.0))
                           for k in range(self.getOrDefault(self.numClasses))])
        best = (F.array_position(scores, F.array_max(scores)) - 1).cast("double")
        return df.withColumn(self.getOutputCol(), best).drop(*voters)
