"""A pipeline stage whose state is arrays: saved as one row per array next to its parameters."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class ArrayWriter(MLWriter):
    def __init__(self, stage: "ArrayStage"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        rows = [(name, str(a.dtype), list(a.shape), bytearray(np.ascontiguousarray(a).tobytes()))
                for name, a in self.stage.arrays.items()]
        self.sparkSession.createDataFrame(rows, "name string, kind string, shape array<int>, data binary"
                                          ).write.parquet(f"{path}/arrays")


class ArrayReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> "ArrayStage":
        held = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(held["uid"])
        DefaultParamsReader.getAndSetParams(stage, held)
        stage.arrays = {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"])
                        for r in self.sparkSession.read.parquet(f"{path}/arrays").collect()}
        return stage


class ArrayStage(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Parameters as usual; ``arrays`` by name, of a size that does not grow with the data."""

    def __init__(self, arrays: dict[str, np.ndarray] | None = None, **params):
        super().__init__()
        self.arrays = arrays or {}
        self._setDefault(inputCol="intensities")
        self._set(**params)

    def write(self) -> ArrayWriter:
        return ArrayWriter(self)

    @classmethod
    def read(cls) -> ArrayReader:
        return ArrayReader(cls)
