"""Kernel support vector machines on landmarks: one machine per pair of classes, and a vote.

The kernel is ``exp(-gamma |x - y|^2)``. Rows are described by their kernel values to at most ``landmarks`` rows, turned
so that dot products of the descriptions give the kernel between landmarks exactly and between other rows
approximately. With as many landmarks as different rows the description is the kernel itself.

Each pair's machine minimises ``|w|^2 / 2 + C * sum of hinge losses`` of its two classes' rows. The hinge's corner is
rounded, first widely and then narrowly, and these problems are solved by Newton steps. All machines share every scan:
one scan adds up gradients and curvatures per pair, which are solved pair by pair on the executors; a second one
compares a few step lengths. What the driver holds is a row of weights per pair.

Scale. Two scans per step, some dozens of steps whatever the number of rows. A task's sums are pairs x landmarks^2 numbers, so
rows are read in large slices (``SLICE_ROWS`` a task). Of a table of up to ``APART_ROWS`` rows each pair's go to one
task, which takes the same steps. The landmarks are a bounded sample by hash of the row's content.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, functions as F, types as T

from spectraloom.functions.kernels import add_columns, map_matrix, matrices
from spectraloom.models.array_stage import ArrayStage

LANDMARKS = 512
SLICE_ROWS = 50_000
APART_ROWS = 5_000      # up to so many rows in all, each machine is trained by one task
CORNERS = (2.0, 0.5, 0.05)  # half widths of the rounded corner, one after another; the first takes in a margin of 0
STEPS = 25              # Newton steps at most per corner
SETTLED = 1e-6          # relative gain of a step below which a machine is done
LENGTHS = np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001])
SMALLEST = 1e-10        # of the largest eigenvalue: directions below it carry no kernel


def kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    apart = (x ** 2).sum(1)[:, None] + (y ** 2).sum(1) - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(apart, 0))


def basis_of(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """Turns kernel values to the landmarks into descriptions."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks, gamma))
    some = values > SMALLEST * values.max()
    return vectors[:, some] / np.sqrt(values[some])


def choose_landmarks(df: DataFrame, count: int, seed: int, intensities: str = "intensities") -> np.ndarray:
    """Different rows with the smallest hashes of their content."""
    rows = df.select(F.col(intensities).alias("x")).where(F.col("x").isNotNull())
    hashed = rows.select(F.xxhash64("x", F.lit(seed)).alias("h"), "x").groupBy("h").agg(F.first("x").alias("x"))
    return np.array([r["x"] for r in hashed.orderBy("h").limit(count).collect()])


class LandmarkMachines(ArrayStage):
    """Predicts the class with most votes of the pairs' machines, the smaller one on ties."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, held = self.getOrDefault(self.gamma), df.sparkSession.sparkContext.broadcast(self.arrays)

        def predict(spectra: pa.Array) -> list[pa.Array]:
            a, best = held.value, np.zeros(len(spectra))
            classes = a["classes"]
            for rows, x in matrices(spectra):
                described = kernel(x, a["landmarks"], gamma) @ a["basis"]
                score = described @ a["weights"][:, :-1].T + a["weights"][:, -1]
                votes = np.zeros((len(rows), len(classes)), np.int64)
                for j, (one, other) in enumerate(a["pairs"]):
                    votes[:, one] += score[:, j] > 0
                    votes[:, other] += score[:, j] <= 0
                best[rows] = classes[votes.argmax(axis=1)]
            return [pa.array(best, mask=spectra.is_null().to_numpy(zero_copy_only=False))]

        return add_columns(df, self.getInputCol(), {self.getOutputCol(): T.DoubleType()}, predict)


def described(df: DataFrame, landmarks: np.ndarray, basis: np.ndarray, gamma: float) -> DataFrame:
    """(label, z): descriptions with a last one for the offset."""
    held = df.sparkSession.sparkContext.broadcast((landmarks, basis))

    def describe(x: np.ndarray) -> np.ndarray:
        marks, turn = held.value
        return np.hstack([kernel(x, marks, gamma) @ turn, np.ones((len(x), 1))])

    rows = add_columns(df.select("label", "intensities"), "intensities", {"z": T.ArrayType(T.DoubleType())},
                       lambda spectra: [map_matrix(spectra, describe)])
    return rows.select("label", "z").where(F.col("z").isNotNull())


def rounded_hinge(margin: np.ndarray, corner: float):
    """Loss, slope and curvature by margin."""
    short = 1 - margin
    inside = np.abs(short) < corner
    loss = np.where(short >= corner, short, np.where(inside, (short + corner) ** 2 / (4 * corner), 0.0))
    slope = -np.where(short >= corner, 1.0, np.where(inside, (short + corner) / (2 * corner), 0.0))
    return loss, slope, np.where(inside, 1 / (2 * corner), 0.0)


def signs_of(labels: np.ndarray, one: float, other: float):
    """Rows of a pair's two classes and their signs."""
    rows = np.flatnonzero((labels == one) | (labels == other))
    return rows, np.where(labels[rows] == one, 1.0, -1.0)


def batch_rows(batches, width: int):
    for batch in batches:
        if len(batch):
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            yield batch.column("label").to_numpy(zero_copy_only=False), z


def direction_of(weights: np.ndarray, slope: np.ndarray, curve: np.ndarray, c: float) -> np.ndarray:
    """Newton direction from the sums of slopes and curvatures."""
    plain = np.ones(len(weights))
    plain[-1] = 0.0  # the offset is free
    return -np.linalg.solve(c * curve + np.eye(len(weights)), plain * weights + c * slope)  # for the offset a brake only


def better_step(weights: np.ndarray, direction: np.ndarray, loss: float, along: np.ndarray, c: float):
    """Weights after the best step length, and whether the machine still gains."""
    now = c * loss + 0.5 * float(weights[:-1] @ weights[:-1])
    trial = weights + LENGTHS[:, None] * direction
    then = c * along + 0.5 * (trial[:, :-1] ** 2).sum(axis=1)
    best = int(then.argmin())
    return trial[best] if then[best] < now else weights, now - then[best] > SETTLED * abs(now)


def train_machine(z: np.ndarray, sign: np.ndarray, c: float, steps: int) -> np.ndarray:
    """One pair's machine from all rows of its classes."""
    weights = np.zeros(z.shape[1])
    for corner in CORNERS:
        for _ in range(steps):
            loss, slope, curve = rounded_hinge(sign * (z @ weights), corner)
            bent = z[curve > 0] * np.sqrt(curve[curve > 0])[:, None]
            direction = direction_of(weights, z.T @ (sign * slope), bent.T @ bent, c)
            at = (sign * (z @ weights))[:, None] + (sign * (z @ direction))[:, None] * LENGTHS
            weights, gains = better_step(weights, direction, float(loss.sum()), rounded_hinge(at, corner)[0].sum(axis=0), c)
            if not gains:
                break
    return weights


def newton_directions(rows: DataFrame, named: dict, weights: np.ndarray, open_pairs: list[int], c: float,
                      corner: float) -> dict[int, tuple[float, np.ndarray]]:
    """Per open pair: the sum of losses and the direction, from one scan; solved where the sums are."""
    width = weights.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((weights, named))

    def partial(batches):
        held, names = sent.value
        sums = {}
        for labels, z in batch_rows(batches, width):
            for j in open_pairs:
                some, sign = signs_of(labels, *names[j])
                if not len(some):
                    continue
                x = z[some]
                loss, slope, curve = rounded_hinge(sign * (x @ held[j]), corner)
                into = sums.setdefault(j, [0.0, np.zeros(width), np.zeros((width, width))])
                into[0] += float(loss.sum())
                into[1] += x.T @ (sign * slope)
                bent = x[curve > 0] * np.sqrt(curve[curve > 0])[:, None]
                into[2] += bent.T @ bent
        for j, (loss, slope, curve) in sums.items():
            packed = np.concatenate([[loss], slope, curve[np.triu_indices(width)]])
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([packed.tobytes()], pa.binary())],
                                             names=["pair", "sums"])

    def solve(batches):
        held, totals = sent.value[0], {}
        for batch in batches:
            for j, data in zip(batch.column("pair").to_pylist(), batch.column("sums")):
                packed = np.frombuffer(data.as_buffer(), np.float64)
                totals[j] = totals[j] + packed if j in totals else packed
        for j, packed in totals.items():
            upper = np.zeros((width, width))
            upper[np.triu_indices(width)] = packed[1 + width:]
            direction = direction_of(held[j], packed[1:1 + width], upper + upper.T - np.diag(np.diag(upper)), c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([j], pa.int32()), pa.array([float(packed[0])]), pa.array([direction.tobytes()], pa.binary())],
                names=["pair", "loss", "direction"])

    parts = min(len(open_pairs), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = (rows.mapInArrow(partial, "pair int, sums binary").repartition(parts, "pair")
             .mapInArrow(solve, "pair int, loss double, direction binary").collect())  # one row per pair
    return {r["pair"]: (r["loss"], np.frombuffer(bytes(r["direction"]), np.float64)) for r in found}


def losses_along(rows: DataFrame, named: dict, weights: np.ndarray, directions: dict, corner: float) -> dict[int, np.ndarray]:
    """Per pair: sums of losses at all step lengths, from one scan."""
    width = weights.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((weights, named, directions))

    def partial(batches):
        held, names, moves = sent.value
        sums = np.zeros((len(held), len(LENGTHS)))
        for labels, z in batch_rows(batches, width):
            for j, move in moves.items():
                some, sign = signs_of(labels, *names[j])
                x = z[some]
                at = (sign * (x @ held[j]))[:, None] + (sign * (x @ move))[:, None] * LENGTHS
                sums[j] += rounded_hinge(at, corner)[0].sum(axis=0)
        for j in moves:
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([sums[j].tolist()], pa.list_(pa.float64()))],
                                             names=["pair", "losses"])

    rows = rows.mapInArrow(partial, "pair int, losses array<double>")
    added = rows.groupBy("pair").agg(*[F.sum(F.get("losses", F.lit(i))).alias(f"l{i}") for i in range(len(LENGTHS))])
    return {r["pair"]: np.array([r[f"l{i}"] for i in range(len(LENGTHS))]) for r in added.collect()}


def fit_pairs_apart(rows: DataFrame, classes: np.ndarray, width: int, c: float, steps: int = STEPS):
    """The same for few rows: each pair's rows go to one task, which takes all steps of its machine."""
    pairs = list(combinations(range(len(classes)), 2))
    named = F.array(*[F.struct(F.lit(j).alias("pair"), F.lit(float(classes[a])).alias("one"), F.lit(float(classes[b])).alias("other"))
                      for j, (a, b) in enumerate(pairs)])
    mine = F.filter(named, lambda p: (p["one"] == F.col("label")) | (p["other"] == F.col("label")))

    def run(key, table):
        z = table.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        weights = train_machine(z, table.column("sign").to_numpy(), c, steps)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([weights.tolist()], pa.list_(pa.float64()))],
                        names=["pair", "weights"])

    each = rows.select("label", "z", F.explode(mine).alias("p")).select(
        F.col("p.pair").alias("pair"), F.when(F.col("label") == F.col("p.one"), 1.0).otherwise(-1.0).alias("sign"), "z")
    found = each.groupBy("pair").applyInArrow(run, "pair int, weights array<double>").collect()  # one row per pair
    weights = np.zeros((len(pairs), width))
    for r in found:
        weights[r["pair"]] = r["weights"]
    return weights, pairs


def fit_pairs(rows: DataFrame, classes: np.ndarray, width: int, c: float, steps: int = STEPS):
    """(weights, pairs): a row of weights per pair of classes, the offset last."""
    pairs = list(combinations(range(len(classes)), 2))
    named = {j: (float(classes[a]), float(classes[b])) for j, (a, b) in enumerate(pairs)}
    weights = np.zeros((len(pairs), width))
    for corner in CORNERS:
        open_pairs = list(named)
        for _ in range(steps):
            found = newton_directions(rows, named, weights, open_pairs, c, corner)
            moves = {j: d for j, (_, d) in found.items()}
            along = losses_along(rows, named, weights, moves, corner)
            still = []
            for j, (loss, direction) in found.items():
                weights[j], gains = better_step(weights[j], direction, loss, along[j], c)
                if gains:
                    still.append(j)
            open_pairs = still
            if not open_pairs:
                break
    return weights, pairs


def fit_machines(df: DataFrame, gamma: float, c: float, landmarks: int = LANDMARKS, seed: int = 0,
                 steps: int = STEPS) -> LandmarkMachines:
    """``df`` has ``intensities`` and ``label``; the stage adds ``prediction``."""
    df = df.where(F.col("intensities").isNotNull())
    marks = choose_landmarks(df, landmarks, seed)
    basis = basis_of(marks, gamma)
    counted = df.groupBy("label").count().orderBy("label").collect()  # one row per class
    classes = np.array([float(r["label"]) for r in counted])
    total = sum(r["count"] for r in counted)
    slices = max(1, math.ceil(total / SLICE_ROWS))
    rows = described(df, marks, basis, gamma).coalesce(slices).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        width = basis.shape[1] + 1
        fit = fit_pairs_apart if total <= APART_ROWS else fit_pairs
        weights, pairs = fit(rows, classes, width, c, steps) if len(classes) > 1 else (np.zeros((0, width)), [])
    finally:
        rows.unpersist()
    return LandmarkMachines({"landmarks": marks, "basis": basis, "weights": weights, "classes": classes,
                             "pairs": np.array(pairs, np.int64).reshape(-1, 2)}, outputCol="prediction", gamma=gamma)
