"""One network for all labels: shared ReLU layers with dropout, a sigmoid per label, trained by Adam.

Each round takes the next batch of rows (dealt anew every epoch by a hash of the key), adds up the gradients of the
mean cross-entropy on the executors, whole Arrow batches at a time, and moves the weights on the driver. The weights
are of a size given by the layers, not by the data: they are sent once per round, and their gradients come back added up
by chunks.

Scale. A round reads the cached rows, of which the batch's few are sent to a bounded number of tasks, so the number of
gradients that are added up does not grow with the table. Rounds are set by ``rounds``; an epoch takes
rows / ``batch_rows`` of them.

Rows without points or with null targets are left out of the fit; probabilities of rows without points are null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F, types as T

from spectraloom.functions.kernels import add_columns, map_matrix
from spectraloom.models.array_stage import ArrayStage

HIDDEN = (1000, 1000, 1000, 1000)
DROPOUT = 0.1
RATE = 0.001
ROUNDS = 100
BATCH_ROWS = 8192
TASK_ROWS = 512         # of a batch that one task takes
CHUNK = 1 << 18         # numbers of a gradient that are added up together
PATIENCE = 20           # rounds without a better loss that end the training


def first_layers(sizes: Sequence[int], seed: int, kind=np.float32) -> list[np.ndarray]:
    """Weights and offsets, uniform within one over the root of the inputs."""
    rng = np.random.default_rng(seed)
    found = []
    for before, after in zip(sizes[:-1], sizes[1:]):
        bound = 1 / math.sqrt(before)
        found += [rng.uniform(-bound, bound, (before, after)).astype(kind), rng.uniform(-bound, bound, after).astype(kind)]
    return found


def logits(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    for weight, offset in zip(layers[:-2:2], layers[1:-2:2]):
        x = np.maximum(x @ weight + offset, 0)
    return x @ layers[-2] + layers[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def loss_and_gradient(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None,
                      dropout: float = DROPOUT) -> tuple[float, list[np.ndarray]]:
    """Summed cross-entropy over rows and labels, and its gradient. Dropout only with ``rng``."""
    inputs, gates = [x], []
    for weight, offset in zip(layers[:-2:2], layers[1:-2:2]):
        z = inputs[-1] @ weight + offset
        gate = (z > 0).astype(z.dtype)
        if rng is not None and dropout > 0:
            gate *= (rng.random(z.shape, np.float32) >= dropout) / z.dtype.type(1 - dropout)
        gates.append(gate)
        inputs.append(z * gate)
    z = inputs[-1] @ layers[-2] + layers[-1]
    loss = float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum())
    delta = sigmoid(z) - y
    found = []
    for k in range(len(layers) // 2 - 1, -1, -1):
        found = [inputs[k].T @ delta, delta.sum(axis=0)] + found
        if k:
            delta = (delta @ layers[2 * k].T) * gates[k - 1]
    return loss, found


class LabelNetwork(ArrayStage):
    """Adds the array of label probabilities."""

    def layers(self) -> list[np.ndarray]:
        return [self.arrays[f"layer_{i}"] for i in range(len(self.arrays))]

    def _transform(self, df: DataFrame) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self.layers())
        probabilities = lambda x: sigmoid(logits(held.value, x.astype(held.value[0].dtype))).astype(np.float64)
        return add_columns(df, self.getInputCol(), {self.getOutputCol(): T.ArrayType(T.DoubleType())},
                           lambda spectra: [map_matrix(spectra, probabilities)])


def round_gradient(batch: DataFrame, layers: list[np.ndarray], seed: int, number: int, dropout: float, tasks: int):
    """(loss, rows, gradient): sums over the batch."""
    shapes = [x.shape for x in layers]
    kind = layers[0].dtype
    sent = batch.sparkSession.sparkContext.broadcast(layers)
    size = sum(x.size for x in layers)

    def partial(batches):
        total, loss, rows = np.zeros(size, kind), 0.0, 0
        for held in batches:
            if not len(held):
                continue
            x = held.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1).astype(kind)
            y = held.column("y").flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1).astype(kind)
            rng = np.random.default_rng([seed, number, abs(int(held.column("h")[0].as_py()))])
            part, gradient = loss_and_gradient(sent.value, x, y, rng, dropout)
            loss, rows = loss + part, rows + len(held)
            total += np.concatenate([g.ravel() for g in gradient])
        if rows:
            numbers = range(-(-size // CHUNK))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(numbers), pa.int32()), pa.array([loss if i == 0 else 0.0 for i in numbers]),
                 pa.array([rows if i == 0 else 0 for i in numbers], pa.int64()),
                 pa.array([total[i * CHUNK:(i + 1) * CHUNK].tobytes() for i in numbers], pa.binary())],
                names=["chunk", "loss", "rows", "sums"])

    def add(batches):
        sums = {}
        for held in batches:
            for chunk, loss, rows, data in zip(*[held.column(c) for c in ("chunk", "loss", "rows", "sums")]):
                into = sums.setdefault(chunk.as_py(), [0.0, 0, 0.0])
                into[0], into[1] = into[0] + loss.as_py(), into[1] + rows.as_py()
                into[2] = into[2] + np.frombuffer(data.as_buffer(), kind).astype(np.float64)
        for chunk, (loss, rows, total) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([loss]), pa.array([rows], pa.int64()),
                 pa.array([total.astype(kind).tobytes()], pa.binary())], names=["chunk", "loss", "rows", "sums"])

    schema = "chunk int, loss double, rows long, sums binary"
    sums = batch.mapInArrow(partial, schema)
    if tasks > 1:
        sums = sums.repartition(min(tasks, -(-size // CHUNK)), "chunk").mapInArrow(add, schema)
    found = sorted(sums.collect(), key=lambda r: r["chunk"])  # one row per chunk
    sent.destroy()
    if not found:
        return 0.0, 0, None
    flat = np.concatenate([np.frombuffer(bytes(r["sums"]), kind) for r in found])
    gradient, at = [], 0
    for shape in shapes:
        n = math.prod(shape)
        gradient.append(flat[at:at + n].reshape(shape))
        at += n
    return sum(r["loss"] for r in found), sum(r["rows"] for r in found), gradient


class Adam:
    def __init__(self, layers: list[np.ndarray], rate: float):
        self.rate, self.step = rate, 0
        self.mean, self.square = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]

    def move(self, layers: list[np.ndarray], gradient: list[np.ndarray]) -> list[np.ndarray]:
        self.step += 1
        found = []
        for i, (x, g) in enumerate(zip(layers, gradient)):
            self.mean[i] = 0.9 * self.mean[i] + 0.1 * g
            self.square[i] = 0.999 * self.square[i] + 0.001 * g * g
            mean, square = self.mean[i] / (1 - 0.9 ** self.step), self.square[i] / (1 - 0.999 ** self.step)
            found.append((x - self.rate * mean / (np.sqrt(square) + 1e-8)).astype(x.dtype))
        return found


def fit_label_network(df: DataFrame, n_labels: int, targets: str = "targets", intensities: str = "intensities",
                      key: str = "spectrum_id", hidden: Sequence[int] = HIDDEN, rounds: int = ROUNDS,
                      batch_rows: int = BATCH_ROWS, rate: float = RATE, dropout: float = DROPOUT,
                      seed: int = 0) -> tuple[PipelineModel, list[tuple[int, int, float]]]:
    """The model, which adds ``probabilities``, and (round, rows, mean loss) of every round."""
    rows = df.where(F.col(intensities).isNotNull() & F.col(targets).isNotNull()).select(
        F.xxhash64(key, F.lit(seed)).alias("h"), F.col(intensities).cast("array<float>").alias("x"),
        F.col(targets).cast("array<float>").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        count, points = rows.agg(F.count("*"), F.max(F.size("x"))).first()
        if not count:
            raise ValueError("no training rows")
        layers = first_layers([points, *hidden, n_labels], seed)
        batches = -(-count // batch_rows)
        tasks = max(1, -(-min(count, batch_rows) // TASK_ROWS))
        adam, log, best, waited = Adam(layers, rate), [], math.inf, 0
        for number in range(rounds):
            epoch, turn = divmod(number, batches)
            batch = rows if batches == 1 else rows.where(F.pmod(F.xxhash64("h", F.lit(epoch)), F.lit(batches)) == turn)
            loss, used, gradient = round_gradient(batch.repartition(tasks, "h").sortWithinPartitions("h"), layers,
                                                  seed, number, dropout, tasks)
            if not used:
                continue
            layers = adam.move(layers, [g / (used * n_labels) for g in gradient])
            log.append((number, used, loss / (used * n_labels)))
            waited = 0 if log[-1][2] < best * (1 - 1e-4) else waited + 1
            best = min(best, log[-1][2])
            if batches == 1 and waited >= PATIENCE:
                break
    finally:
        rows.unpersist()
    network = LabelNetwork({f"layer_{i}": x for i, x in enumerate(layers)}, inputCol=intensities, outputCol="probabilities")
    return PipelineModel([network]), log
