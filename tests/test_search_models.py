"""Search from fold sums against refits, adaptive proposals on known surfaces, the perceptron's steps."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from spectraloom import schema
from spectraloom.models import classifiers, fold_sums, proposals, search
from spectraloom.models.classifiers import get_model, predict
from spectraloom.operators import metrics


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 30] + [0, 3, 1, -8]
    y = x @ [1.5, -0.3, 4, 0.02] + 2 + rng.normal(size=300)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    return search.with_fold(df, "id", 3).repartition(3).cache()


@pytest.mark.parametrize("standardize", [True, False])
def test_subtraction_equals_refitting(regression, standardize):
    products = fold_sums.fold_products(regression, 3, "y")
    assert [p[-2, -2] for p in products] == [regression.where(F.col("fold") == k).count() for k in range(3)]
    penalties = [0.0, 0.5, 20.0]
    scores, best = fold_sums.search_penalties(products, penalties, standardize)
    evaluator = RegressionEvaluator(labelCol="y", metricName="r2")
    for penalty, score in zip(penalties, scores):
        refits = []
        for k in range(3):
            estimator = LinearRegression(labelCol="y", regParam=penalty, standardization=standardize, solver="normal")
            model = estimator.fit(regression.where(F.col("fold") != k))
            mine = fold_sums.solve(products.sum(axis=0) - products[k], penalty, standardize)
            np.testing.assert_allclose(mine.coefficients, model.coefficients.toArray(), atol=1e-8)
            assert abs(mine.intercept - model.intercept) < 1e-8
            refits.append(evaluator.evaluate(model.transform(regression.where(F.col("fold") == k))))
        assert abs(score - np.mean(refits)) < 1e-8
    assert best == max(range(3), key=lambda i: scores[i])


def test_odd_folds(spark, regression):
    few = regression.where("fold <> 1")
    scores, _ = fold_sums.search_penalties(fold_sums.fold_products(few, 3, "y"), [0.1])
    assert math.isfinite(scores[0])
    constant = regression.withColumn("features", F.array(F.lit(1.0), F.col("a")))
    fit = fold_sums.solve(fold_sums.fold_products(constant, 3, "y").sum(axis=0), 0.0)
    assert np.isfinite(fit.coefficients).all()
    with pytest.raises(ValueError):
        fold_sums.fold_products(regression.where("false"), 3, "y")


def test_report_from_sums_equals_the_searched_one(regression):
    train, test = regression.where("id < 240").drop("fold"), regression.where("id >= 240").drop("fold")
    grids = {"linear": {"regParam": [0.0, 0.5, 20.0]}}
    mine = search.grid_search_report(train, test, {"linear": LinearRegression(labelCol="y")}, grids, "y", "id").first()
    other = LinearRegression(labelCol="y", solver="normal", loss="squaredError", elasticNetParam=0.0)
    assert search.from_sums(other, grids["linear"]) and not search.from_sums(other, {"regParam": [0.0], "maxIter": [3]})
    slow = search.grid_search_report(train, test, {"linear": other}, {"linear": grids["linear"] | {"maxIter": [50]}},
                                     "y", "id").first()
    assert mine["best_params"] in slow["best_params"]
    assert abs(mine["train_r2"] - slow["train_r2"]) < 1e-8 and abs(mine["test_r2"] - slow["test_r2"]) < 1e-8


def test_folds_score_like_the_cross_validator_without_python(regression, monkeypatch):
    """The same means as ``CrossValidator``, but no row is sent to Python."""
    estimator, evaluator = LinearRegression(labelCol="y"), RegressionEvaluator(labelCol="y", metricName="r2")
    maps = [{estimator.regParam: value} for value in (0.0, 5.0, 90.0)]
    plans, fit = [], LinearRegression.fit
    monkeypatch.setattr(LinearRegression, "fit", lambda self, rows, *a: (
        plans.append(rows._jdf.queryExecution().executedPlan().toString()), fit(self, rows, *a))[1])
    scores = search._cross_validate(estimator, maps, evaluator, regression, 3, 2)
    assert len(plans) == 9 and not any("EvalPython" in plan for plan in plans)
    monkeypatch.undo()
    whole = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=3, foldCol="fold")
    assert np.allclose(scores, whole.fit(regression).avgMetrics, rtol=1e-9)
    with pytest.raises(ValueError):
        search._cross_validate(estimator, maps, evaluator, regression.where("fold < 2"), 3, 2)


SPACE = {"rate": ("interval", 0.0, 1.0), "width": ("interval", -5.0, 5.0), "size": ("choice", [32, 64, 128, 256])}


def surface(s):
    return -((s["rate"] - 0.2) ** 2) * 4 - ((s["width"] - 1.5) / 5) ** 2 - 0.3 * (s["size"] != 128)


def search_by(step, seed, trials=20):
    rng, done = random.Random(seed), []
    while len(done) < trials:
        for setting in step(done, rng):
            done.append((setting, surface(setting)))
    return max(score for _, score in done[:trials])


def test_proposals_beat_random_draws():
    adaptive = lambda done, rng: proposals.settings_of_round(SPACE, done, 10 if not done else 2, 10, rng)
    plain = lambda done, rng: [proposals.draw(SPACE, rng)]
    mine, other = (np.array([search_by(step, seed) for seed in range(60)]) for step in (adaptive, plain))
    print(mine.mean(), other.mean())
    assert mine.mean() > other.mean() + 0.03 and (mine > other).mean() > 0.6


def test_proposals_stay_in_their_space():
    rng, done = random.Random(1), []
    for _ in range(40):
        for s in proposals.settings_of_round(SPACE, done, 3, 10, rng):
            assert 0 <= s["rate"] <= 1 and -5 <= s["width"] <= 5 and s["size"] in SPACE["size"][1]
            done.append((s, float("nan") if len(done) % 9 == 4 else surface(s)))
    bells = proposals.Bells([0.1, 0.12, 0.9], 0.0, 1.0)
    at = np.linspace(0, 1, 2001)
    assert abs(np.trapezoid([math.exp(bells.log_density(v)) for v in at], at) - 1) < 1e-3
    with pytest.raises(ValueError):
        proposals.draw({"a": ("gauss", 1, 2)}, rng)


def test_adaptive_search_ranks_all_trials(regression):
    evaluator = RegressionEvaluator(labelCol="y", metricName="rmse")
    space = {"regParam": ("interval", 0.0, 50.0), "maxIter": ("choice", [5, 10])}
    run = lambda: search.adaptive_search_trials(regression.drop("fold"), LinearRegression(labelCol="y"), space, evaluator,
                                                "id", n_trials=8, startup=4).collect()
    rows = run()
    assert [r["trial"] for r in rows] == list(range(8)) and sorted(r["rank"] for r in rows) == list(range(1, 9))
    assert min(rows, key=lambda r: r["metric"])["rank"] == 1
    assert [r["params"] for r in run()] == [r["params"] for r in rows]


def clusters(spark, n, classes, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(classes, 8))[y] * 3 + rng.normal(size=(n, 8)) * spread
    rows = [(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "spectrum_id int, y int, intensities array<double>")


def test_perceptron_does_not_depend_on_partitions(spark, monkeypatch):
    _, _, df = clusters(spark, 400, 3, 1)
    for rows in (1000, 100):
        monkeypatch.setattr(classifiers, "PERCEPTRON_ROWS", rows)
        one, other = (np.array(get_model(schema.METHOD_PERCEPTRON, {"max_iter": 40}).fit(d).stages[0].getOrDefault("weights"))
                      for d in (df.coalesce(1), df.repartition(7)))
        np.testing.assert_allclose(one, other, atol=1e-9)


def test_perceptron_against_one_machine(spark, monkeypatch):
    x, y, df = clusters(spark, 600, 4, 2)
    monkeypatch.setattr(classifiers, "PERCEPTRON_ROWS", 100)
    blocks = metrics.accuracy(predict(get_model(schema.METHOD_PERCEPTRON, {}).fit(df), df)).first()[0]
    weights, step, best, waited = np.zeros((4, 9)), 0.001, math.inf, 0
    rng, signs = np.random.default_rng(0), np.where(y[:, None] == np.arange(4), 1.0, -1.0)
    for _ in range(500):
        order, loss = rng.permutation(len(x)), 0.0
        for i in order:
            row = np.append(x[i], 1.0)
            margin = signs[i] * (weights @ row)
            weights *= 1 - step * 0.1
            wrong = margin <= 0
            loss -= margin[wrong].sum() / len(x)
            weights[wrong] += step * signs[i, wrong, None] * row
        waited = waited + 1 if loss > best - 1e-3 else 0
        best = min(best, loss)
        if waited >= 5:
            step, waited = step / 5, 0
            if step < 1e-6:
                break
    alone = (np.argmax(np.hstack([x, np.ones((600, 1))]) @ weights.T, axis=1) == y).mean()
    print(blocks, alone)
    assert blocks >= alone - 0.02
