"""Forests without a depth limit: pure leaves, shares, parted tables, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom import schema
from spectraloom.models import evaluate, forest, parting
from spectraloom.models.classifiers import get_model, predict
from spectraloom.operators import metrics


def depth_of(tree):
    feature, _, below, above, _ = tree
    deepest, work = 0, [(0, 0)]
    while work:
        node, level = work.pop()
        deepest = max(deepest, level)
        if feature[node] >= 0:
            work += [(below[node], level + 1), (above[node], level + 1)]
    return deepest


def test_leaves_are_pure_however_deep():
    """Classes that take turns along one axis: 30 levels are not enough."""
    x = np.arange(600.0)[:, None]
    y = np.arange(600) % 2
    tree = forest.grow(x, y, np.ones(600), 2, np.random.default_rng(0))
    assert depth_of(tree) > 30
    shares = forest.leaf_shares(tree, x)
    assert (shares.max(1) == 1).all() and (shares.argmax(1) == y).all()
    assert (tree[4][tree[0] < 0].max(1) == 1).all()
    short = forest.grow(x, y, np.ones(600), 2, np.random.default_rng(0), depth=3)
    assert depth_of(short) == 3


def test_best_split_by_trying_all():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x, y = rng.integers(0, 8, 25).astype(float), rng.integers(0, 3, 25)
        w = rng.integers(1, 4, 25).astype(float)
        counts = np.zeros((25, 3))
        counts[np.arange(25), y] = w
        gini = lambda m: m.sum() - (m ** 2).sum() / m.sum()
        every = [gini(counts[x <= c].sum(0)) + gini(counts[x > c].sum(0)) for c in np.unique(x)[:-1]]
        found = forest.best_split(x, counts)
        assert abs(found[0] - min(every)) < 1e-9
        assert abs(gini(counts[x <= found[1]].sum(0)) + gini(counts[x > found[1]].sum(0)) - found[0]) < 1e-9
    assert forest.best_split(np.ones(5), np.ones((5, 2))) is None


@pytest.fixture(scope="module")
def spiral(spark):
    rng = np.random.default_rng(7)
    angle, y = rng.random(900) * 12, rng.integers(0, 3, 900)
    x = np.stack([angle * np.cos(angle + 2.1 * y), angle * np.sin(angle + 2.1 * y), *rng.normal(size=(2, 900))], 1)
    rows = [(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "spectrum_id int, y int, intensities array<double>").repartition(3).cache()


@pytest.mark.parametrize("group", [50_000, 120])
def test_forest_learns_and_survives_saving(spark, spiral, group, monkeypatch, tmp_path):
    monkeypatch.setattr(forest, "GROUP_ROWS", group)
    train, test = spiral.where("spectrum_id % 4 > 0"), spiral.where("spectrum_id % 4 = 0")
    model = get_model(schema.METHOD_RANDOM_FOREST, {"num_trees": 15}).fit(train)
    assert (model.stages[0].top is not None) == (group < 900)
    scored = predict(model, test)
    assert scored.columns == [*test.columns, "y_pred"]
    assert metrics.accuracy(scored).first()[0] > 0.8 and metrics.accuracy(predict(model, train)).first()[0] > 0.97
    evaluate.save_model(model, str(tmp_path), spark, {"seed": 0})
    loaded, _ = evaluate.load_model(str(tmp_path), spark)
    key = lambda m: sorted(map(tuple, predict(m, test).select("spectrum_id", "y_pred").collect()))
    assert key(loaded) == key(model)
    monkeypatch.setattr(forest, "SLICE_BYTES", 4000)
    assert len(list(model.stages[0].slices())) > 3 and key(model) == key(loaded)


@pytest.mark.parametrize("group", [50_000, 120])
def test_large_forests_are_not_sent_to_tasks(spark, spiral, group, monkeypatch):
    """The same classes when each subtree goes to its rows; nothing is broadcast then, and no slices follow each other."""
    monkeypatch.setattr(forest, "GROUP_ROWS", group)
    model = get_model(schema.METHOD_RANDOM_FOREST, {"num_trees": 9, "max_depth": 6}).fit(spiral)
    rows = spiral.withColumn("intensities", F.when(F.col("spectrum_id") > 5, F.col("intensities")))
    key = lambda: {r["spectrum_id"]: r["y_pred"] for r in predict(model, rows.union(rows)).collect()}
    whole = key()
    monkeypatch.setattr(forest, "SLICE_BYTES", 4000)
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value))
    large = predict(model, rows.union(rows))
    assert not sent and large.count() == 1800 and large.columns == [*rows.columns, "y_pred"]
    monkeypatch.undo()
    monkeypatch.setattr(forest, "SLICE_BYTES", 4000)
    monkeypatch.setattr(forest, "GROUP_ROWS", group)
    assert key() == whole and all(whole[i] is None for i in range(6))


def test_bootstrap_and_odd_rows(spark, spiral):
    drawn = spark.range(20_000).select(forest.times_drawn(F.col("id"), F.lit(3), 0).alias("n")).groupBy("n").count().collect()
    share = {r["n"]: r["count"] / 20_000 for r in drawn}
    assert abs(share[0] - 0.368) < 0.02 and abs(share[1] - 0.368) < 0.02 and abs(share[2] - 0.184) < 0.02
    odd = spiral.withColumn("intensities", F.when(F.col("spectrum_id") > 5, F.col("intensities")))
    model = get_model(schema.METHOD_RANDOM_FOREST, {"num_trees": 3}).fit(odd)
    found = {r["spectrum_id"]: r["y_pred"] for r in predict(model, odd).collect()}
    assert len(found) == 900 and all((found[i] is None) == (i <= 5) for i in found)
    with pytest.raises(ValueError):
        get_model(schema.METHOD_RANDOM_FOREST, {}).fit(spiral.where("false"))


def parted_here(x, labels, drawn, group, seed, tree, depth=None):
    """(feature, threshold) by path of a tree parted by trying every cut of a node's rows, and the rows of its leaves."""
    cuts, leaves, numbers, nodes = {}, {}, 1, [(0, "", np.flatnonzero(drawn))]
    while nodes:  # level by level, as nodes are numbered
        below = []
        for number, path, rows in nodes:
            counts = np.zeros((len(rows), labels.max() + 1))
            counts[np.arange(len(rows)), labels[rows]] = drawn[rows]
            best, some = None, int(x.shape[1] ** 0.5)
            open_node = len(rows) > group and (counts.sum(0) > 0).sum() > 1 and (depth is None or len(path) < depth)
            for tried, f in enumerate(parting.features_of(seed, tree, number, x.shape[1]) if open_node else []):
                if tried >= some and best:
                    break
                found = forest.best_split(x[rows, f], counts)
                if found is not None and (best is None or found[0] < best[0]):
                    best = (*found, f)
            if best is None:
                leaves[path] = set(rows)
                continue
            cuts[path] = best[2], best[1]
            low = x[rows, best[2]] <= best[1]
            below += [(numbers, path + "b", rows[low]), (numbers + 1, path + "a", rows[~low])]
            numbers += 2
        nodes = below
    return cuts, leaves


def paths_of(tree):
    feature, threshold, below, above = tree[:4]
    cuts, leaves, work = {}, {}, [(0, "")]
    while work:
        node, path = work.pop()
        if feature[node] < 0:
            leaves[path] = node
            continue
        cuts[path] = feature[node], threshold[node]
        work += [(below[node], path + "b"), (above[node], path + "a")]
    return cuts, leaves


@pytest.mark.parametrize("sums, spans, depth", [(64 << 20, 20_000, None), (1, 30, 3)])
def test_large_nodes_have_the_best_of_all_cuts(spark, sums, spans, depth, monkeypatch):
    """Continuous, coarse, constant, missing and infinite values; heavy values beyond a group; uneven labels."""
    monkeypatch.setattr(parting, "SUMS_BYTES", sums)
    monkeypatch.setattr(parting, "ROUND_SPANS", spans)
    monkeypatch.setattr(parting, "CHUNK_BYTES", 4000)
    rng, n, trees, group = np.random.default_rng(5), 500, 3, 90
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n), np.ones(n), np.exp(rng.normal(size=n) * 6),
                  np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)), rng.normal(size=n).round(1)], 1)
    x[::17, 0], x[5::40, 3], x[6::40, 3] = np.nan, np.inf, -np.inf
    labels = (rng.random(n) * 3 * (np.nan_to_num(x[:, 0]) > 0)).astype(int) + (x[:, 1] == 2)
    drawn = rng.poisson(1, (n, trees))
    rows = spark.createDataFrame([(a, int(b), c) for a, b, c in zip(x.tolist(), labels, drawn.tolist())],
                                 "x array<double>, label int, drawn array<tinyint>").repartition(3).cache()
    found, whole = parting.part(rows, n, trees, 6, labels.max() + 1, 4, depth, group)
    for tree in range(trees):
        cuts, leaves = parted_here(x, labels, drawn[:, tree], group, 4, tree, depth)
        mine, ends = paths_of(found[tree])
        assert len(cuts) >= 3 and mine == cuts
        at = parting.reach(found[tree], x)
        for path, held in leaves.items():
            assert held == set(np.flatnonzero((at == ends[path]) & (drawn[:, tree] > 0)))
            assert ((tree, ends[path]) in whole) == (len(held) > group)
            assert found[tree][4][ends[path]] == len(path)
    assert (depth is None) or whole


def test_few_wide_bins_and_no_spans(spark):
    """Cuts between bins only, and nodes that no tried feature parts at first."""
    n = 240
    x = np.zeros((n, 9))
    x[:, 7] = np.arange(n) % 2
    labels = (x[:, 7] + (np.arange(n) % 5 == 0)).astype(int)
    rows = spark.createDataFrame([(a, int(b), [1]) for a, b in zip(x.tolist(), labels)],
                                 "x array<double>, label int, drawn array<tinyint>")
    (tree,), whole = parting.part(rows, n, 1, 9, 3, 0, None, 50)
    assert tree[0].tolist() == [7, -1, -1] and tree[1][0] == 0.5
    assert {k: v.tolist() for k, v in whole.items()} == {(0, 1): [96, 24, 0, 120], (0, 2): [0, 96, 24, 120]}


def test_no_large_leaf_stays_unfinished(spark, monkeypatch):
    """Classes that take turns where nearly all rows lie close together: bounded trees of few bins leave large mixed leaves."""
    monkeypatch.setattr(forest, "GROUP_ROWS", 70)
    n = 180
    x = np.where(np.arange(n) < 20, np.arange(n) * 1e6, 1e9 + np.arange(n) * 1e-3)
    rows = [(i, int(i // 4 % 2 if i >= 20 else i % 2), [float(v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "spectrum_id int, y int, intensities array<double>")
    model = get_model(schema.METHOD_RANDOM_FOREST, {"num_trees": 2}).fit(df).stages[0]
    held = model.subtrees.collect()
    assert model.top is not None and len(held) > 2
    for r in held:
        feature, shares = np.array(r["feature"]), np.array(r["shares"]).reshape(-1, 2)
        assert (shares[feature < 0].max(1) == 1).all()


def test_equal_rows_beyond_a_group_and_depth(spark, monkeypatch):
    monkeypatch.setattr(forest, "GROUP_ROWS", 50)
    equal = [(i, int(i % 3 == 0), [1.0, 2.0]) for i in range(200)]
    other = [(200 + i, int(i % 2), [float(i + 5), 2.0]) for i in range(120)]
    df = spark.createDataFrame(equal + other, "spectrum_id int, y int, intensities array<double>")
    odd = df.select("spectrum_id", F.when(F.col("spectrum_id") != 3, F.col("intensities")).alias("intensities"), "y")
    for depth in (None, 4):
        model = get_model(schema.METHOD_RANDOM_FOREST, {"num_trees": 3, "max_depth": depth}).fit(odd)
        found = {r["spectrum_id"]: r["y_pred"] for r in predict(model, odd).collect()}
        assert len(found) == 320 and found[3] is None and all(v is not None for k, v in found.items() if k != 3)
        assert len({v for k, v in found.items() if k < 200 and k != 3}) == 1
        top = model.stages[0].top
        deepest = max(top[r["tree"]][4][r["leaf"]] + depth_of([np.array(r[c]) for c in SUBTREE_ARRAYS])
                      for r in model.stages[0].subtrees.collect())
        assert deepest == 4 if depth else deepest > 4


SUBTREE_ARRAYS = ("feature", "threshold", "below", "above", "shares")
