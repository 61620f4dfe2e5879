"""Random forests without a depth limit.

A table of up to ``GROUP_ROWS`` rows grows each tree in one group. In a larger one, nodes with more rows are split by
exact cuts over all their rows (``parting``), however many levels that takes; what falls into one smaller node is then
finished in one group, until the leaves are pure. Only a node of one class or of equal rows stays larger than a group.

Each tree sees each row as often as a hash of the row's content and the tree says (Poisson with mean 1), looks at the
root of the number of features per node (more, until one of them can part the rows) and splits by Gini impurity. The
forest's class is the one with the largest mean share, the smaller one on ties.

Scale. Rows travel once per tree. Subtrees are a table in the shared folder, as an unlimited forest grows with the data.
Up to ``SLICE_BYTES`` of them are sent to all tasks, which add up shares row by row in place; of a larger forest each
subtree meets the rows of its leaf in one group, so a task's memory does not grow with the forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F, types as T

from spectraloom.functions.kernels import add_columns, matrices
from spectraloom.models.parting import best_cut, part, reach
from spectraloom.sinks.shared import SharedTables

GROUP_ROWS = 50_000
SLICE_BYTES = 64 << 20   # of subtrees that are sent to all tasks; of more, each goes to the rows of its leaf
SUBTREES = ("tree int, leaf int, feature array<int>, threshold array<double>, below array<int>, above array<int>, "
            "shares array<double>")
TOP = "tree int, feature array<int>, threshold array<double>, below array<int>, above array<int>, level array<int>"


def best_split(x: np.ndarray, counts: np.ndarray):
    """(impurity, threshold) of the best cut of one feature; counts: weighted classes of the rows. None if all are equal."""
    found = best_cut(x, counts)
    return found and found[:2]


def grow(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, classes: int, rng: np.random.Generator,
         depth: int | None = None):
    """Arrays (feature or -1, threshold, child below or equal, child above, shares) of a tree with pure leaves."""
    counts = np.zeros((len(x), classes))
    counts[np.arange(len(x)), labels] = weights
    feature, threshold, below, above, shares = [], [], [], [], []
    some = max(1, math.isqrt(x.shape[1]))
    work = [(np.arange(len(x)), -1, False, 0)]
    while work:
        rows, parent, upper, level = work.pop()
        number = len(feature)
        if parent >= 0:
            (above if upper else below)[parent] = number
        held = counts[rows].sum(axis=0)
        feature.append(-1)
        threshold.append(0.0)
        below.append(-1)
        above.append(-1)
        shares.append(held / held.sum())
        if (held > 0).sum() < 2 or (depth is not None and level >= depth):
            continue
        best = None
        for tried, column in enumerate(rng.permutation(x.shape[1])):
            if tried >= some and best is not None:
                break
            found = best_split(x[rows, column], counts[rows])
            if found is not None and (best is None or found[0] < best[0]):
                best = (*found, int(column))
        if best is None:  # equal rows of several classes
            continue
        feature[number], threshold[number] = best[2], best[1]
        low = x[rows, best[2]] <= best[1]
        work += [(rows[~low], number, True, level + 1), (rows[low], number, False, level + 1)]
    return (np.array(feature, np.int32), np.array(threshold), np.array(below, np.int32), np.array(above, np.int32),
            np.array(shares))


def leaf_shares(tree, x: np.ndarray) -> np.ndarray:
    return tree[4][reach(tree, x)]


def times_drawn(row: F.Column, tree: F.Column, seed: int):
    """How often a tree sees a row: Poisson with mean 1, by hash."""
    chance = F.pmod(F.xxhash64(row, tree, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    found, upto, term = F.lit(0), 0.0, math.exp(-1)
    for n in range(1, 12):  # more are rarer than a step of the hash
        upto += term
        found = found + F.when(chance >= upto, 1).otherwise(0)
        term /= n
    return found


def finish_subtrees(width: int, classes: int, seed: int, depth: int | None, top: list | None = None):
    def run(key, table):
        tree, leaf = (k.as_py() for k in key)
        table = table.sort_by([("h", "ascending")])
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        labels = table.column("label").to_numpy().astype(np.int64)
        weights = table.column("weight").to_numpy().astype(np.float64)
        left = depth if depth is None or top is None else depth - int(top[tree][4][leaf])
        arrays = grow(x, labels, weights, classes, np.random.default_rng([seed, tree, leaf]), left)
        return pa.table([pa.array([tree], pa.int32()), pa.array([leaf], pa.int32()),
                         *[pa.array([a.ravel().tolist()], pa.list_(kind)) for a, kind in zip(
                             arrays, (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()))]],
                        names=["tree", "leaf", "feature", "threshold", "below", "above", "shares"])
    return run


class ForestWriter(MLWriter):
    def __init__(self, stage: "DeepForest"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.subtrees.write.parquet(f"{path}/subtrees")
        if self.stage.top is not None:
            rows = [(tree, *(a.tolist() for a in arrays)) for tree, arrays in enumerate(self.stage.top)]
            self.sparkSession.createDataFrame(rows, TOP).write.parquet(f"{path}/top")


class ForestReader(MLReader):
    def load(self, path: str) -> "DeepForest":
        held = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = DeepForest()
        stage._resetUid(held["uid"])
        DefaultParamsReader.getAndSetParams(stage, held)
        stage.subtrees = self.sparkSession.read.schema(SUBTREES).parquet(f"{path}/subtrees")
        if stage.getOrDefault(stage.hasTop):
            rows = self.sparkSession.read.schema(TOP).parquet(f"{path}/top").orderBy("tree").collect()
            stage.top = [tuple(np.array(a) for a in r[1:]) for r in rows]
        return stage


class DeepForest(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Adds the class with the largest mean share over the trees."""

    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)
    hasTop = Param(Params._dummy(), "hasTop", "whether the rows are parted first", TypeConverters.toBoolean)

    def __init__(self, subtrees: DataFrame | None = None, top: list | None = None, **params):
        super().__init__()
        self.subtrees, self.top = subtrees, top
        self._setDefault(inputCol="intensities", outputCol="prediction", hasTop=top is not None)
        self._set(hasTop=top is not None, **params)

    def write(self) -> ForestWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> ForestReader:
        return ForestReader()

    def slices(self):
        """(first, last) trees whose subtrees are sent together."""
        size = sum((F.size(c) * n for c, n in (("feature", 16), ("shares", 8))), F.lit(200))
        sizes = self.subtrees.groupBy("tree").agg(F.sum(size).alias("bytes")).orderBy("tree").collect()  # a row per tree
        start, held = None, 0
        for r in sizes:
            if start is not None and held + r["bytes"] > SLICE_BYTES:
                yield start, last
                start, held = None, 0
            start, last, held = (r["tree"] if start is None else start), r["tree"], held + r["bytes"]
        if start is not None:
            yield start, last

    def _transform(self, df: DataFrame) -> DataFrame:
        classes, points = self.getOrDefault(self.numClasses), self.getInputCol()
        rows, slices = with_leaves(df, self.top, points), list(self.slices())
        if len(slices) > 1:
            rows = meet_subtrees(rows, self.subtrees, points, slices[-1][1] + 1, classes)
        else:
            rows = rows.withColumn("_shares", F.array_repeat(F.lit(0.0), classes))
            held = {}
            for r in self.subtrees.collect():  # of one slice at most
                held.setdefault(r["tree"], {})[r["leaf"]] = subtree_of(r, classes)
            rows = add_shares(rows, points, df.sparkSession.sparkContext.broadcast(held), classes)
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return rows.withColumn(self.getOutputCol(), F.when(F.col(points).isNotNull(), best)).drop("_shares", "_leaves")


def subtree_of(row, classes: int):
    return (np.array(row["feature"]), np.array(row["threshold"]), np.array(row["below"]), np.array(row["above"]),
            np.array(row["shares"]).reshape(-1, classes))


def meet_subtrees(rows: DataFrame, subtrees: DataFrame, points: str, trees: int, classes: int) -> DataFrame:
    """Adds ``_shares`` by sending each row once per tree to the subtree of its leaf.

    No task holds more than one subtree and ``GROUP_ROWS`` rows: those of a leaf with more rows are dealt to several
    copies of it. A row's shares are added up in the order of the trees.
    """
    tables = SharedTables(rows.sparkSession, "forest-scores")
    rows = tables.keep(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")  # written: the numbers hold
    parted = F.when(F.size("_leaves") > 0, F.get("_leaves", F.col("tree")).cast("int")).otherwise(F.lit(0))
    each = rows.where(F.col(points).isNotNull()).select(
        "_row", F.col(points).alias("x"), "_leaves", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    each = each.select("_row", "x", "tree", parted.alias("leaf"))
    copies = tables.keep(each.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select(
        "tree", "leaf", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("copies")), "copies")
    each = each.join(copies, ["tree", "leaf"], "left").select(
        "_row", "x", "tree", "leaf", F.coalesce(F.pmod(F.xxhash64("_row"), "copies"), F.lit(0)).cast("int").alias("copy"))
    model = subtrees.where(F.col("tree") < trees).join(copies, ["tree", "leaf"], "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")

    def score(key, table: pa.Table, model: pa.Table) -> pa.Table:
        shares = np.zeros((table.num_rows, classes))
        if table.num_rows and model.num_rows:  # a leaf that the tree has seen no rows of gives nothing
            subtree = subtree_of(model.to_pylist()[0], classes)
            for some, x in matrices(table.column("x").combine_chunks()):
                shares[some] = leaf_shares(subtree, x)
        offsets = np.arange(table.num_rows + 1, dtype=np.int32) * classes
        return pa.table([table.column("_row"), table.column("tree"),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(shares.ravel()))],
                        names=["_row", "tree", "part"])

    def added(batches):
        ids, parts = np.zeros(0, np.int64), np.zeros((0, classes))
        for batch in batches:
            new = batch.column("part").flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
            ids, parts = np.concatenate([ids, batch.column("_row").to_numpy()]), np.concatenate([parts, new])
            whole = len(ids) // trees  # every row has one part per tree
            of_trees, sums = parts[:whole * trees].reshape(whole, trees, classes), np.zeros((whole, classes))
            for t in range(trees):
                sums += of_trees[:, t]
            offsets = np.arange(whole + 1, dtype=np.int32) * classes
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[:whole * trees:trees]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))],
                names=["_row", "_shares"])
            ids, parts = ids[whole * trees:], parts[whole * trees:]

    keys = ["tree", "leaf", "copy"]
    scored = each.groupBy(*keys).cogroup(model.groupBy(*keys)).applyInArrow(
        score, "_row long, tree int, part array<double>")
    sums = (scored.repartition("_row").sortWithinPartitions("_row", "tree").select("_row", "part")
            .mapInArrow(added, "_row long, _shares array<double>"))
    return rows.join(sums, "_row", "left").drop("_row")


def with_leaves(df: DataFrame, top: list | None, points: str) -> DataFrame:
    """Adds ``_leaves``: for every tree the leaf of the parting trees, or an empty array without them."""
    if top is None:
        return df.withColumn("_leaves", F.array().cast("array<int>"))

    def leaves(spectra: pa.Array) -> list[pa.Array]:
        found = np.zeros((len(spectra), len(top)), np.int32)
        for some, x in matrices(spectra):
            for tree, arrays in enumerate(top):
                found[some, tree] = reach(arrays, x)
        offsets = np.arange(len(spectra) + 1, dtype=np.int32) * len(top)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))]

    return add_columns(df, points, {"_leaves": T.ArrayType(T.IntegerType())}, leaves)


def add_shares(rows: DataFrame, points: str, held, classes: int) -> DataFrame:
    fields = rows.schema.names

    def run(batches):
        for batch in batches:
            at = {name: i for i, name in enumerate(fields)}
            spectra = batch.column(at[points])
            shares = batch.column(at["_shares"]).flatten().to_numpy(zero_copy_only=False).reshape(-1, classes).copy()
            leaves = batch.column(at["_leaves"])
            parted = len(leaves.flatten()) > 0
            numbers = leaves.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(int) if parted else None
            for some, x in matrices(spectra):
                for tree, subtrees in held.value.items():
                    mine = numbers[some, tree] if parted else np.zeros(len(some), int)
                    for leaf in np.unique(mine):
                        if leaf in subtrees:
                            here = mine == leaf
                            shares[some[here]] += leaf_shares(subtrees[leaf], x[here])
            columns = list(batch.columns)
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * classes
            columns[at["_shares"]] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return rows.mapInArrow(run, rows.schema)


def fit_forest(df: DataFrame, trees: int = 100, depth: int | None = None, seed: int = 0) -> DeepForest:
    """``df`` has ``intensities`` and ``label``; labels are 0, 1, ..."""
    df = df.where(F.col("intensities").isNotNull()).select("intensities", "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        count, highest, width = df.agg(F.count("*"), F.max("label"), F.max(F.size("intensities"))).first()
        if not count:
            raise ValueError("no training rows")
        classes, top, whole = int(highest) + 1, None, {}
        tables = SharedTables(df.sparkSession, "forest")
        hashed = df.select(F.xxhash64("intensities", "label").alias("h"), F.col("intensities").alias("x"),
                           F.col("label").cast("int").alias("label"))
        numbers = F.sequence(F.lit(0), F.lit(trees - 1))
        if count > GROUP_ROWS:
            drawn = F.transform(numbers, lambda tree: times_drawn(F.col("h"), tree, seed).cast("byte"))
            rows = tables.keep(hashed.withColumn("drawn", drawn), "rows")
            top, whole = part(rows, count, trees, width, classes, seed, depth, GROUP_ROWS)
        parted = with_leaves(hashed, top, "x")
        leaf = F.get("_leaves", F.col("tree")) if top is not None else F.lit(0)
        each = parted.select("h", "x", "label", "_leaves", F.explode(numbers).alias("tree"))
        each = each.select("tree", leaf.alias("leaf"), "h", "x", "label",
                           times_drawn(F.col("h"), F.col("tree"), seed).alias("weight")).where("weight > 0")
        if whole:
            large = df.sparkSession.createDataFrame(
                [(tree, leaf, [-1], [0.0], [-1], [-1], (held[:-1] / held[:-1].sum()).tolist())
                 for (tree, leaf), held in whole.items()], SUBTREES)
            each = each.join(large.select("tree", "leaf"), ["tree", "leaf"], "left_anti")
        subtrees = each.groupBy("tree", "leaf").applyInArrow(
            finish_subtrees(width, classes, seed, depth, top), SUBTREES)
        subtrees = tables.keep(subtrees.unionByName(large) if whole else subtrees, "subtrees")
    finally:
        df.unpersist()
    return DeepForest(subtrees, top, numClasses=classes)
