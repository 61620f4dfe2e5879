"""An approximate graph of nearest neighbours, by partitioned blocks and descent.

Start: several times over, the points are sorted by the cell that random hyperplanes put them in and cut into blocks of
bounded size; inside a block all distances are computed. Descent: neighbours of a point are likely neighbours of each
other, so in each round every point compares a sample of those it lists and of those that list it with each other, and
pairs that are closer than what a point has are taken over. Both end in the ``k`` nearest found per point.

Scale. A block is cut from a sort, so it is bounded whatever the data; equal points are dealt over blocks by a hash of
their number. A point that is listed by very many (a hub) takes part with a sample of them, of an expected size that is
the same for all, so a round sends each point's coordinates to a bounded number of places. Groups per point hold at most
a few dozen rows. Each round is written to the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spectraloom.functions.kernels import add_columns, matrices
from spectraloom.sinks.shared import SharedTables

BLOCK = 256           # points compared with each other at the start
TREES = 6             # how often the points are dealt into blocks
ROUNDS = 6            # of descent, at most
SAMPLE = 10           # of the neighbours of a point, and of those that list it, per round
PLANE_SAMPLE = 4096   # points from which the hyperplanes' positions are read
SETTLED = 0.002       # of all listed neighbours: fewer changes than that end the descent


def number_points(df: DataFrame, key: str, points: str, tables: SharedTables) -> DataFrame:
    """(node, key, x): a number for each row that has points; written, so that the numbers hold."""
    rows = df.where(F.col(points).isNotNull()).select(
        F.col(key).alias("key"), F.col(points).cast("array<float>").alias("x"))
    return tables.keep(rows.withColumn("node", F.monotonically_increasing_id()), "points")


def nearest_in_block(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest other rows of each row."""
    square = (x ** 2).sum(1)
    apart = np.maximum(square[:, None] + square - 2 * (x @ x.T), 0)
    np.fill_diagonal(apart, np.inf)
    k = min(k, len(x) - 1)
    near = np.argpartition(apart, k - 1, axis=1)[:, :k]
    return near, np.sqrt(np.take_along_axis(apart, near, 1))


def block_pairs(points: DataFrame, k: int, width: int, count: int, seed: int, block: int) -> DataFrame:
    """(node, neighbour, distance) inside the blocks of one dealing."""
    rng = np.random.default_rng(seed)
    depth = min(max(0, math.ceil(math.log2(max(count, 1) / block))), 40)
    planes = rng.normal(size=(width, depth + 1))
    some = points.orderBy(F.xxhash64("node", F.lit(seed))).limit(PLANE_SAMPLE).select("x").collect()
    middle = np.median(np.array([r["x"] for r in some]) @ planes, axis=0)

    def place(spectra: pa.Array) -> list[pa.Array]:
        cell, along = np.zeros(len(spectra), np.int64), np.zeros(len(spectra))
        for rows, x in matrices(spectra):
            side = x @ planes - middle
            cell[rows] = (side[:, :depth] > 0) @ (1 << np.arange(depth, dtype=np.int64))[::-1]
            along[rows] = side[:, depth]
        return [pa.array(cell), pa.array(along)]

    placed = add_columns(points.select("node", "x"), "x", {"cell": T.LongType(), "along": T.DoubleType()}, place)
    order = ["cell", "along", "mixed"]
    dealt = (placed.withColumn("mixed", F.xxhash64("node", F.lit(seed)))
             .repartitionByRange(max(1, count // (block * 64)), *order).sortWithinPartitions(*order).select("node", "x"))

    def compare(batches):
        rest: list = []

        def found(node, x):
            if len(node) < 2:
                return
            near, apart = nearest_in_block(x, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(node, near.shape[1])), pa.array(node[near].ravel()),
                 pa.array(apart.ravel().astype(np.float32))], names=["node", "neighbour", "distance"])

        node, x = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            node = np.concatenate([node, batch.column("node").to_numpy()])
            x = np.concatenate([x, values.astype(np.float64)])
            while len(node) >= 2 * block:  # what is left at the end has up to twice a block
                yield from found(node[:block], x[:block])
                node, x = node[block:], x[block:]
        yield from found(node, x)

    return dealt.mapInArrow(compare, "node long, neighbour long, distance float")


def nearest_of(pairs: DataFrame, k: int) -> DataFrame:
    """(node, near): the k nearest of the pairs of each node, as structs of distance and neighbour."""
    found = F.array_sort(F.collect_set(F.struct("distance", "neighbour")))
    return pairs.groupBy("node").agg(F.slice(found, 1, k).alias("near"))


def listed(graph: DataFrame) -> DataFrame:
    """(node, neighbour, distance) of a graph with one row per node."""
    return graph.select("node", F.explode("near").alias("n")).select("node", "n.neighbour", "n.distance")


def thinned(pairs: DataFrame, of: str, expected: int, salt: int) -> DataFrame:
    """A sample of the pairs: about ``expected`` of each value of a column that has more, all of the others."""
    counts = pairs.groupBy(F.col(of).alias("_of")).agg(F.count("*").alias("_n")).where(F.col("_n") > expected)
    drawn = F.pmod(F.xxhash64("node", "neighbour", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    return (pairs.join(counts, pairs[of] == F.col("_of"), "left")
            .where(F.col("_n").isNull() | (drawn < F.lit(expected) / F.col("_n"))).drop("_of", "_n"))


def group_bounds(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])


def compare_groups(width: int):
    """From rows (middle, member, bound, x) sorted by middle: pairs of members closer than a member's bound."""
    def pairs(middle, member, bound, x):
        edges = group_bounds(middle)
        sizes = np.diff(edges)
        for size in np.unique(sizes[sizes > 1]):
            at = edges[:-1][sizes == size][:, None] + np.arange(size)
            for a in range(0, len(at), 4096):
                rows = at[a:a + 4096]
                some, ids = x[rows], member[rows]
                square = (some ** 2).sum(2)
                apart = np.sqrt(np.maximum(square[:, :, None] + square[:, None] - 2 * some @ some.transpose(0, 2, 1), 0))
                closer = (apart < bound[rows][:, :, None]) & (ids[:, :, None] != ids[:, None])
                group, one, other = np.nonzero(closer)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[group, one]), pa.array(ids[group, other]),
                     pa.array(apart[group, one, other].astype(np.float32))], names=["node", "neighbour", "distance"])

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, width))]
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            new = [batch.column("middle").to_numpy(), batch.column("member").to_numpy(),
                   batch.column("bound").to_numpy().astype(np.float64), values.astype(np.float64)]
            held = [np.concatenate(x) for x in zip(held, new)]
            last = group_bounds(held[0])[-2] if len(held[0]) else 0  # the last group may go on in the next batch
            yield from pairs(*[x[:last] for x in held])
            held = [x[last:] for x in held]
        if len(held[0]):
            yield from pairs(*held)

    return run


def descend(graph: DataFrame, points: DataFrame, k: int, width: int, salt: int, sample: int,
            tables: SharedTables) -> DataFrame:
    """One round: neighbours of a point are compared with each other."""
    pairs = listed(graph).select("node", "neighbour")
    mixed = F.xxhash64("node", "neighbour", F.lit(salt))
    forward = graph.select("node", F.explode(F.slice(F.array_sort(F.transform(
        "near", lambda n: F.struct(F.xxhash64("node", n["neighbour"], F.lit(salt)).alias("h"),
                                   n["neighbour"].alias("neighbour")))), 1, sample)).alias("n"))
    ahead = forward.select(F.col("node").alias("middle"), F.col("n.neighbour").alias("member"))
    back = thinned(pairs, "neighbour", sample, salt).select(F.col("neighbour").alias("middle"), F.col("node").alias("member"))
    own = graph.select(F.col("node").alias("middle"), F.col("node").alias("member"))
    members = ahead.union(back).union(own).distinct()
    known = points.join(graph.select("node", F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).otherwise(
        F.lit(float("inf"))).cast("float").alias("bound")), "node")
    sent = members.join(known.withColumnRenamed("node", "member"), "member")
    sent = sent.repartition("middle").sortWithinPartitions("middle", "member").select("middle", "member", "bound", "x")
    closer = sent.mapInArrow(compare_groups(width), "node long, neighbour long, distance float")
    closer = nearest_of(closer, k).select("node", F.explode("near").alias("n")).select("node", "n.neighbour", "n.distance")
    every = listed(graph).union(closer).groupBy("node", "neighbour").agg(F.min("distance").alias("distance"))
    return tables.keep(nearest_of(every, k), "graph")


def nearest_graph(points: DataFrame, k: int, tables: SharedTables, trees: int = TREES, rounds: int = ROUNDS,
                  sample: int = SAMPLE, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(node, near): for each of the points (node, x) about its k nearest others, nearest first."""
    count, least, most = points.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if count and least != most:
        raise ValueError(f"points of {least} to {most} coordinates; neighbours need one length")
    width = most or 0
    points = points.select("node", "x")
    block = max(block, 2 * k + 2)
    starts = [block_pairs(points, k, width, count, seed * 1000 + t, block)
              for t in range(1 if count < 2 * block else trees)] if count else []
    if not starts:
        return points.select("node", F.array().cast("array<struct<distance:float,neighbour:bigint>>").alias("near"))
    pairs = starts[0]
    for other in starts[1:]:
        pairs = pairs.union(other)
    graph = tables.keep(nearest_of(pairs.groupBy("node", "neighbour").agg(F.min("distance").alias("distance")), k), "graph")
    for r in range(rounds if count >= 2 * block else 0):  # fewer points were all in one block
        before = graph
        graph = descend(graph, points, k, width, seed * 1000 + 500 + r, sample, tables)
        changed = listed(graph).join(listed(before).select("node", "neighbour"), ["node", "neighbour"], "left_anti").count()
        if changed <= SETTLED * count * k:
            break
    return graph


def neighbours_kept(df: DataFrame, projected: DataFrame, k: int = 15, key: str = "spectrum_id",
                    points: str = "intensities", seed: int = 0) -> DataFrame:
    """One row (kept, n): the share of a point's k nearest that are among its k nearest in the projection too."""
    tables = SharedTables(df.sparkSession, "kept")
    flat = projected.select(key, F.array("x", "y").alias("flat"))
    numbered = tables.keep(df.select(key, points).join(flat, key).select(
        F.monotonically_increasing_id().alias("node"), F.col(points).cast("array<float>").alias("x"),
        F.col("flat").cast("array<float>").alias("flat")), "both")
    graph = nearest_graph(numbered.select("node", "x"), k, tables, seed=seed)
    return share_kept(graph, numbered.select("node", F.col("flat").alias("x")), k, tables, seed)


def share_kept(graph: DataFrame, flat: DataFrame, k: int, tables: SharedTables, seed: int = 0) -> DataFrame:
    """``neighbours_kept`` for a graph of the points and their places (node, x)."""
    two = listed(nearest_graph(flat, k, tables, seed=seed))
    both = listed(graph).join(two.select("node", "neighbour", F.lit(1).alias("hit")), ["node", "neighbour"], "left")
    return both.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("kept"), F.countDistinct("node").alias("n"))
