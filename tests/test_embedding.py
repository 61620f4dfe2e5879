"""The neighbour graph and the plane against exact computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.models import embedding, evaluate, neighbours
from spectraloom.operators import stats
from spectraloom.sinks.shared import SharedTables
from tests import exact


def frame(spark, x, **more):
    rows = [(f"s{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "spectrum_id string, intensities array<double>").repartition(3)


def clusters(n, width, count, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(count, width))[rng.integers(0, count, n)] + spread * rng.normal(size=(n, width))


def places(df, key="spectrum_id"):
    return np.array([(r["x"], r["y"]) for r in df.orderBy(key).collect()])


def graph_of(spark, x, k, **more):
    tables = SharedTables(spark, "test")
    points = neighbours.number_points(frame(spark, x), "spectrum_id", "intensities", tables)
    names = {r["node"]: int(r["key"][1:]) for r in points.select("node", "key").collect()}
    graph = neighbours.nearest_graph(points, k, tables, **more).collect()
    return {names[r["node"]]: [(n["distance"], names[n["neighbour"]]) for n in r["near"]] for r in graph}


def recall(graph, x, k):
    return np.mean([len({j for _, j in graph[i]} & set(near)) for i, near in enumerate(exact.nearest(x, k))]) / k


def test_graph_finds_the_neighbours(spark):
    x = clusters(3000, 16, 30, 1)
    found = graph_of(spark, x, 10, block=64)
    assert len(found) == 3000 and recall(found, x, 10) > 0.99
    start = recall(graph_of(spark, x, 10, block=64, trees=2, rounds=0), x, 10)
    assert start + 0.2 < recall(graph_of(spark, x, 10, block=64, trees=2), x, 10)
    for i in (0, 17, 2999):
        distances = [d for d, _ in found[i]]
        assert distances == sorted(distances) and len({j for _, j in found[i]} - {i}) == 10
        np.testing.assert_allclose(distances, [np.linalg.norm(x[i] - x[j]) for _, j in found[i]], rtol=1e-4)


def test_small_graphs_are_exact(spark):
    x = clusters(120, 8, 5, 2)
    assert recall(graph_of(spark, x, 15), x, 15) > 0.999
    assert {len(v) for v in graph_of(spark, x[:4], 15).values()} == {3}


def test_a_third_of_all_points_equal(spark):
    x = np.concatenate([clusters(1000, 8, 10, 3), np.ones((500, 8))])
    found = graph_of(spark, x, 8, block=64)
    assert all(len(near) == 8 for near in found.values())
    assert all(near[-1][0] < 1e-3 for i, near in found.items() if i >= 1000)


def test_hubs_are_thinned(spark):
    star = spark.range(1, 5001).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("neighbour"))
    rest = spark.range(1, 101).select(F.col("id").alias("node"), (F.col("id") + 1).alias("neighbour"))
    left = neighbours.thinned(star.union(rest), "neighbour", 20, 3)
    assert left.where("neighbour > 0").count() == 100
    assert 5 <= left.where("neighbour = 0").count() <= 45


def test_strengths_add_up():
    rng = np.random.default_rng(0)
    w = embedding.strengths(np.sort(rng.random((50, 15)) + 0.5, axis=1))
    np.testing.assert_allclose(w.sum(1), np.log2(15), rtol=1e-3)
    assert (w[:, 0] == 1).all() and (np.diff(w, axis=1) <= 0).all()
    assert np.isfinite(embedding.strengths(np.zeros((3, 15)))).all()


def test_plane_keeps_neighbours(spark):
    """Share of 15 neighbours kept: at least 0.8 of an exact embedding's, and 0.15 above the principal plane's."""
    x = clusters(600, 24, 12, 4)
    df = frame(spark, x)
    mine, plane = exact.kept(x, places(embedding.embed_2d(df))), exact.kept(x, places(evaluate.project_2d(df)))
    best = exact.kept(x, exact.neighbour_plane(x))
    print(f"kept: exact {best:.3f}, this {mine:.3f}, principal {plane:.3f}")
    assert mine > 0.8 * best and mine > plane + 0.15


def test_points_of_other_tasks_pull_too(spark, monkeypatch):
    monkeypatch.setattr(embedding, "POINTS", 150)
    monkeypatch.setattr(embedding, "BROADCAST_POINTS", 10)
    x = clusters(600, 24, 12, 4)
    df = frame(spark, x)
    got = places(embedding.embed_2d(df))
    assert got.shape == (600, 2) and np.isfinite(got).all()
    assert exact.kept(x, got) > exact.kept(x, places(evaluate.project_2d(df))) + 0.1


def test_the_same_again(spark):
    df = frame(spark, clusters(200, 8, 4, 5))
    np.testing.assert_array_equal(places(embedding.embed_2d(df)), places(embedding.embed_2d(df)))


def test_train_and_test_share_a_plane(spark):
    x = clusters(300, 12, 3, 6, spread=0.1)
    df = frame(spark, x)
    test = df.where("spectrum_id >= 's00200'")
    got = embedding.embed_train_test(df.where("spectrum_id < 's00250'"), test)
    assert got.groupBy("role").count().orderBy("role").collect() == [("test", 100), ("train", 250)]
    rows = {(r["role"], r["spectrum_id"]): (r["x"], r["y"]) for r in got.collect()}
    both = [np.linalg.norm(np.subtract(rows["train", i], rows["test", i])) for i in (f"s{n:05d}" for n in range(200, 250))]
    assert np.median(both) < 0.2 * np.ptp(np.array(list(rows.values())), axis=0).max()


def test_culture_means_and_odd_tables(spark):
    x = clusters(80, 8, 4, 7)
    df = frame(spark, x).withColumn("culture", F.concat(F.lit("c"), F.hash("spectrum_id") % 9))
    means = stats.culture_means(df)
    got = embedding.embed_2d(means, "culture")
    assert got.columns == ["culture", "x", "y"] and got.count() == means.count()
    one = df.limit(1)
    assert [tuple(r)[1:] for r in embedding.embed_2d(one).collect()] == [(0.0, 0.0)]
    assert embedding.embed_2d(df.where("false")).collect() == []
    odd = df.select("spectrum_id", F.when(F.col("spectrum_id") > "s00004", F.col("intensities")).alias("intensities"))
    assert embedding.embed_2d(odd).count() == 75
    same = df.select("spectrum_id", F.array(F.lit(1.0), F.lit(2.0)).alias("intensities"))
    assert np.isfinite(places(embedding.embed_2d(same))).all()
    flat = df.select("spectrum_id", F.slice("intensities", 1, 1).alias("intensities"))
    assert np.isfinite(places(embedding.embed_2d(flat))).all()
    with pytest.raises(ValueError):
        embedding.embed_2d(df.union(flat.withColumn("culture", F.lit("c"))))


def test_share_kept_is_measured(spark):
    x = clusters(300, 12, 6, 8)
    df = frame(spark, x)
    plane = evaluate.project_2d(df)
    got = neighbours.neighbours_kept(df, plane).first()
    assert got["n"] == 300 and abs(got["kept"] - exact.kept(x, places(plane))) < 0.02


def test_planes_are_compared_with_one_graph(spark, monkeypatch):
    """The graph of the spectra is built once for both planes; repeated keys are compared as before."""
    x = clusters(300, 12, 6, 8)
    df = frame(spark, x)
    single = {"principal": evaluate.project_2d(df), "neighbours": embedding.embed_2d(df)}
    widths, compare = [], neighbours.block_pairs
    monkeypatch.setattr(neighbours, "block_pairs", lambda *a: widths.append(a[2]) or compare(*a))
    got = {r["projection"]: r for r in embedding.planes_kept(df, evaluate.project_2d).collect()}
    assert sorted(widths) == [2, 2, 12]
    for name, plane in single.items():
        assert got[name]["n"] == 300 and abs(got[name]["kept"] - exact.kept(x, places(plane))) < 0.03
    twice = df.union(df.limit(40))
    got = {r["projection"]: r for r in embedding.planes_kept(twice, evaluate.project_2d).collect()}
    assert {r["n"] for r in got.values()} == {420}
