"""A plane in which near spectra stay near: neighbour embedding by sampled edges with negative samples.

The graph of nearest neighbours (``models.neighbours``) gets weights: per point, strengths fall with the distance
beyond its nearest neighbour so that they add up to the logarithm of the number of neighbours; the two directions of an
edge are combined to a + b - ab. Coordinates start at the principal plane. In each round an edge, drawn with its
weight as chance, pulls its ends together, and random other points push the ends apart; steps shrink to zero.

Scale. Coordinates are a table, written per round. A round joins the edges with the coordinates of both ends, ranges
them by one axis (the two in turn), so that a task holds points that lie together, and lets every task take several
passes over its own points; ends outside the task stand still meanwhile. A task holds about ``POINTS`` points with their
edges. Points that others push away from are a task's own and a bounded sample of all, sent to every task. A point with
very many edges takes part with an expected number of them; the other ends keep theirs.

The result is not that of an exact single-machine embedding, which compares all pairs; ``neighbours_kept`` measures what
both keep. The same rows, seed and number of shuffle partitions give the same plane.

Rows without points or key have no place and are left out. One row, or none, has the place (0, 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from spectraloom.models.neighbours import nearest_graph, neighbours_kept, number_points, share_kept, thinned
from spectraloom.sinks.shared import SharedTables

NEIGHBOURS = 15
ROUNDS, PASSES = 8, 25      # rounds of the job, and passes over the edges within a round
NEGATIVES = 15              # points pushed away per drawn edge
FIRST_STEP = 0.3            # steps fall from this to zero
POINTS = 20_000             # whose edges one task holds
OTHERS = 20_000             # sampled points sent to all tasks
EDGES = 4                   # times the number of neighbours: edges of a point that take part, expected
SPREAD = 10.0               # of the first coordinates
BROADCAST_POINTS = 300_000  # coordinates are broadcast up to so many points, 20 bytes each, else joined


def strengths(distances: np.ndarray) -> np.ndarray:
    """Weights of each row's sorted distances; they add up to log2 of their number (at least 1)."""
    beyond = np.maximum(distances - distances[:, :1], 0)
    target = max(np.log2(distances.shape[1]), 1.0)
    low, high = np.zeros(len(beyond)), np.full(len(beyond), np.inf)
    width = np.maximum(beyond.mean(axis=1), 1e-12)
    for _ in range(50):
        total = np.exp(-beyond / width[:, None]).sum(1)
        wide = total > target
        high[wide], low[~wide] = width[wide], width[~wide]
        width = np.where(np.isinf(high), 2 * width, (low + high) / 2)
        width = np.maximum(width, 1e-3 * max(beyond.mean(), 1e-12))
    return np.exp(-beyond / width[:, None])


def weighted_edges(graph: DataFrame, k: int, tables: SharedTables) -> DataFrame:
    """(node, neighbour, weight) in both directions."""
    def run(batches):
        for batch in batches:
            near = batch.column("near")
            lengths = near.value_lengths().to_numpy()
            flat = near.flatten()
            distance = flat.field("distance").to_numpy(zero_copy_only=False).astype(np.float64)
            other = flat.field("neighbour").to_numpy(zero_copy_only=False)
            node = batch.column("node").to_numpy()
            starts = np.cumsum(lengths) - lengths
            for n in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == n)
                at = starts[rows][:, None] + np.arange(n)
                weight = strengths(distance[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node[rows], n)), pa.array(other[at].ravel()), pa.array(weight.ravel())],
                    names=["node", "neighbour", "weight"])

    directed = graph.mapInArrow(run, "node long, neighbour long, weight double")
    turned = directed.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "weight")
    both = directed.union(turned).groupBy("node", "neighbour").agg(
        (1 - F.min(1 - F.col("weight")) * F.when(F.count("*") > 1, F.max(1 - F.col("weight"))).otherwise(1.0)).alias("weight"))
    return tables.keep(thinned(tables.keep(both, "both"), "node", EDGES * k, 1), "edges")


def principal_plane(points: DataFrame, width: int) -> DataFrame:
    """(node, px, py): the first two principal components, each turned so that its largest loading is positive."""
    rows = points.select("node", array_to_vector("x").alias("features"))
    if width < 2:
        return rows.select("node", vector_to_array("features")[0].alias("px"), F.lit(0.0).alias("py"))
    model = PCA(k=2, inputCol="features", outputCol="projected").fit(rows)
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in model.pc.toArray().T]
    projected = vector_to_array("projected")
    return model.transform(rows).select("node", *[(projected[i] * signs[i]).alias(n) for i, n in enumerate(("px", "py"))])


def first_places(points: DataFrame, width: int, seed: int) -> DataFrame:
    """The principal plane with a spread of SPREAD along its first axis, equal points set apart a little."""
    plane = principal_plane(points, width)
    mean_x, mean_y, wide, high = plane.agg(F.avg("px"), F.avg("py"), F.stddev_pop("px"), F.stddev_pop("py")).first()
    scale = SPREAD / max(wide or 0.0, high or 0.0) if max(wide or 0.0, high or 0.0) > 0 else 0.0
    noise = lambda salt: (F.pmod(F.xxhash64("node", F.lit(seed), F.lit(salt)), F.lit(10_000)) / 10_000.0 - 0.5) * 0.01
    return plane.select("node", ((F.col("px") - mean_x) * scale + noise(1)).alias("px"),
                        ((F.col("py") - mean_y) * scale + noise(2)).alias("py"))


def move(place: np.ndarray, own: int, one: np.ndarray, other: np.ndarray, weight: np.ndarray, others: np.ndarray,
         rates: np.ndarray, rng: np.random.Generator) -> None:
    """Passes over the edges (rows of ``place``); only the first ``own`` rows move.

    Pull: gradient of log(1 + d^2). Push: gradient of -log of d^2 / (1 + d^2), kept finite near zero.
    """
    for rate in rates:
        drawn = np.flatnonzero(rng.random(len(weight)) < weight)
        rng.shuffle(drawn)
        for some in np.array_split(drawn, max(1, len(drawn) // max(own // 2, 64))):
            a = one[some]
            apart = place[a] - place[other[some]]
            square = (apart ** 2).sum(1, keepdims=True)
            step = np.clip(-2 * apart / (1 + square), -4, 4)
            pool = place[:own] if others is None else others
            for _ in range(NEGATIVES):
                away = place[a] - pool[rng.integers(0, len(pool), len(a))]
                far = (away ** 2).sum(1, keepdims=True)
                push = np.where(far > 0, 2 * away / ((0.001 + far) * (1 + far)), 0)
                step += np.clip(push, -4, 4)
            np.add.at(place, a, rate * step)


def move_round(edges: DataFrame, places: DataFrame, count: int, r: int, seed: int) -> DataFrame:
    """(node, px, py) after one round."""
    side = F.broadcast(places) if count <= BROADCAST_POINTS else places
    ends = edges.join(side, "node").join(side.select(
        F.col("node").alias("neighbour"), F.col("px").alias("qx"), F.col("py").alias("qy")), "neighbour")
    parts = -(-count // POINTS)
    axis = "px" if r % 2 == 0 else "py"
    dealt = ends.repartitionByRange(parts, axis, "node") if parts > 1 else ends.repartition(1)
    columns = ["node", "neighbour", "weight", "px", "py", "qx", "qy"]
    dealt = dealt.select(*columns).sortWithinPartitions("node", "neighbour")
    others = None
    if parts > 1:
        drawn = places.orderBy(F.xxhash64("node", F.lit(seed), F.lit(r))).limit(OTHERS).select("px", "py").collect()
        others = places.sparkSession.sparkContext.broadcast(np.array([tuple(x) for x in drawn]))
    total = ROUNDS * PASSES
    rates = FIRST_STEP * (1.0 - np.arange(r * PASSES, (r + 1) * PASSES) / total)

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        node, neighbour, weight, *xy = [
            np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in columns]
        own, first, one = np.unique(node, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(own, neighbour), len(own) - 1)
        outside = own[at] != neighbour
        away, first_away, to = np.unique(neighbour[outside], return_index=True, return_inverse=True)
        other = at.copy()
        other[outside] = len(own) + to
        place = np.concatenate([np.stack([xy[0][first], xy[1][first]], 1),
                                np.stack([xy[2][outside][first_away], xy[3][outside][first_away]], 1)])
        rng = np.random.default_rng([seed, r, int(own[0])])
        move(place, len(own), one, other, weight, others.value if others else None, rates, rng)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(place[:len(own), 0].copy()),
                                          pa.array(place[:len(own), 1].copy())], names=["node", "px", "py"])

    return dealt.mapInArrow(run, "node long, px double, py double")


def embed_2d(df: DataFrame, key: str = "spectrum_id", intensities: str = "intensities", neighbours: int = NEIGHBOURS,
             seed: int = 0) -> DataFrame:
    """``key, x, y``: a place in the plane for every row with points."""
    tables = SharedTables(df.sparkSession, "plane")
    points = number_points(df.where(F.col(key).isNotNull()), key, intensities, tables)
    count, width = points.agg(F.count("*"), F.max(F.size("x"))).first()
    if count < 2 or not width:
        return points.select(F.col("key").alias(key), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    k = min(neighbours, count - 1)
    places = place_graph(points, nearest_graph(points, k, tables, seed=seed), k, tables, count, width, seed)
    return points.select("node", F.col("key").alias(key)).join(places, "node").select(
        key, F.col("px").alias("x"), F.col("py").alias("y"))


def place_graph(points: DataFrame, graph: DataFrame, k: int, tables: SharedTables, count: int, width: int,
                seed: int = 0) -> DataFrame:
    """(node, px, py) for the numbered points and the graph of their ``k`` nearest."""
    edges = weighted_edges(graph, k, tables)
    places = tables.keep(first_places(points, width, seed), "places")
    for r in range(ROUNDS):
        places = tables.keep(move_round(edges, places, count, r, seed), "places")
    return places


def planes_kept(df: DataFrame, project, key: str = "spectrum_id", intensities: str = "intensities",
                neighbours: int = NEIGHBOURS, seed: int = 0) -> DataFrame:
    """(projection, kept, n): the share of the nearest that the principal plane (``project`` of the rows) and the
    neighbour embedding keep; all comparisons use one graph. Keys that repeat are compared row by row, as by
    ``neighbours_kept``, which needs a graph for each plane."""
    tables = SharedTables(df.sparkSession, "planes")
    df = tables.keep(df.select(key, intensities), "rows")
    principal = project(df)
    rows = df.where(F.col(key).isNotNull())
    points = number_points(rows, key, intensities, tables)
    count, width, keys = points.agg(F.count("*"), F.max(F.size("x")), F.countDistinct("key")).first()
    if keys < count or rows.count() > count or count < 2 or not width:
        planes = {"principal": principal, "neighbours": embed_2d(df, key, intensities, neighbours, seed)}
        kept = [neighbours_kept(df, plane, neighbours, key, intensities, seed) for plane in planes.values()]
    else:
        k = min(neighbours, count - 1)
        graph = nearest_graph(points, k, tables, seed=seed)
        flat = principal.select(F.col(key).alias("key"), F.array("x", "y").cast("array<float>").alias("x"))
        planes = {"principal": points.select("node", "key").join(flat, "key").select("node", "x"),
                  "neighbours": place_graph(points, graph, k, tables, count, width, seed).select(
                      "node", F.array("px", "py").cast("array<float>").alias("x"))}
        kept = [share_kept(graph, tables.keep(plane, "flat"), neighbours, tables, seed) for plane in planes.values()]
    parts = [one.select(F.lit(name).alias("projection"), "kept", "n") for name, one in zip(planes, kept)]
    return parts[0].unionByName(parts[1])


def embed_train_test(train: DataFrame, test: DataFrame, key: str = "spectrum_id", intensities: str = "intensities",
                     neighbours: int = NEIGHBOURS, seed: int = 0) -> DataFrame:
    """``key, role, x, y``: both tables in one plane; a key may occur in both."""
    name = F.struct(F.lit("train").alias("role"), F.col(key).alias("key"))
    other = F.struct(F.lit("test").alias("role"), F.col(key).alias("key"))
    stacked = train.select(name.alias("name"), intensities).union(test.select(other.alias("name"), intensities))
    placed = embed_2d(stacked, "name", intensities, neighbours, seed)
    return placed.select(F.col("name.key").alias(key), "name.role", "x", "y")
