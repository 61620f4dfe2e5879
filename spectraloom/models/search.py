"""Grid, random and adaptive search over parameters with cross-validation."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from spectraloom.models import fold_sums
from spectraloom.models.proposals import draw, settings_of_round
from spectraloom.operators.splits import order_hash

# Hex digits of a hash read as a number for fold assignment.
HASH_DIGITS = 8


def with_fold(df: DataFrame, key: str, k: int, seed: int = 0, output: str = "fold") -> DataFrame:
    """Fold by key hash: the same rows share a fold in every run and partitioning."""
    digits = F.conv(F.substring(order_hash(F.col(key), seed), 1, HASH_DIGITS), 16, 10).cast("long")
    return df.withColumn(output, (digits % k).cast("int"))


def _cross_validate(estimator: Estimator, maps: Sequence[dict], evaluator: Evaluator, folded: DataFrame,
                    k: int, parallelism: int) -> list[float]:
    """Mean metric over the folds for each setting; ``folded`` is persisted and is all that is.

    ``CrossValidator`` with a fold column sends every row to Python twice a fold, and keeps copies of each fold's rows.
    """
    scores = []
    with ThreadPool(min(parallelism, len(maps))) as pool:
        for fold in range(k):
            train, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
            for name, rows in (("training", train), ("validation", held)):
                if not rows.take(1):
                    raise ValueError(f"The {name} data at fold {fold} is empty.")
            score = inheritable_thread_target(folded.sparkSession)(
                lambda setting: float(evaluator.evaluate(estimator.fit(train, setting).transform(held, setting))))
            scores.append(pool.map(score, maps))
    return [sum(of_setting) / k for of_setting in zip(*scores)]


def _describe(params: Mapping) -> str:
    return ", ".join(sorted(f"{p.name}={v}" for p, v in params.items()))


def from_sums(estimator: Estimator, grid: Mapping[str, Sequence]) -> bool:
    """Whether sums of products tell all that the search needs."""
    return (isinstance(estimator, LinearRegression) and set(grid) == {"regParam"} and estimator.getElasticNetParam() == 0
            and estimator.getFitIntercept() and estimator.getLoss() == "squaredError" and not estimator.isDefined("weightCol"))


def grid_search_report(train: DataFrame, test: DataFrame, models: Mapping[str, Estimator],
                       grids: Mapping[str, Mapping[str, Sequence]], label: str, key: str, k: int = 3,
                       parallelism: int = 2, seed: int = 0) -> DataFrame:
    """Best parameters per regressor by k-fold search, and R-squared of the refit on train and test rows.

    A linear regression whose grid holds penalties only is searched from fold sums, in one scan.
    """
    evaluator = RegressionEvaluator(labelCol=label, metricName="r2")
    folded = with_fold(train, key, k, seed).persist()
    rows = []
    try:
        for name, estimator in models.items():
            if from_sums(estimator, grids[name]):
                products = fold_sums.fold_products(folded, k, label, estimator.getFeaturesCol())
                of_test = fold_sums.fold_products(test.withColumn("fold", F.lit(0)), 1, label, estimator.getFeaturesCol())[0]
                penalties = list(grids[name]["regParam"])
                _, best = fold_sums.search_penalties(products, penalties, estimator.getStandardization())
                whole = products.sum(axis=0)
                fit = fold_sums.solve(whole, penalties[best], estimator.getStandardization())
                rows.append((name, f"regParam={penalties[best]}", fold_sums.r_squared(whole, fit),
                             fold_sums.r_squared(of_test, fit)))
                continue
            builder = ParamGridBuilder()
            for param, values in grids[name].items():
                builder = builder.addGrid(estimator.getParam(param), list(values))
            maps = builder.build()
            scores = _cross_validate(estimator, maps, evaluator, folded, k, parallelism)
            best = maps[max(range(len(maps)), key=scores.__getitem__)]
            model = estimator.fit(folded, best)
            rows.append((name, _describe(best), float(evaluator.evaluate(model.transform(folded))),
                         float(evaluator.evaluate(model.transform(test)))))
    finally:
        folded.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, best_params string, train_r2 double, test_r2 double")


def random_search_trials(df: DataFrame, estimator: Estimator, space: Mapping[str, tuple], evaluator: Evaluator,
                         key: str, n_trials: int = 20, k: int = 3, seed: int = 1234,
                         parallelism: int = 2) -> DataFrame:
    """``trial, params, metric, rank`` for seeded random settings; rank 1 is best."""
    rng = random.Random(seed)
    settings = [draw(space, rng) for _ in range(n_trials)]
    maps = [{estimator.getParam(name): value for name, value in setting.items()} for setting in settings]
    folded = with_fold(df, key, k).persist()
    try:
        scores = _cross_validate(estimator, maps, evaluator, folded, k, parallelism)
    finally:
        folded.unpersist()
    return trials_table(df, list(zip(settings, scores)), evaluator.isLargerBetter())


def trials_table(df: DataFrame, trials: Sequence[tuple[dict, float]], larger_is_better: bool) -> DataFrame:
    order = sorted(range(len(trials)), key=lambda i: trials[i][1], reverse=larger_is_better)
    rank = {trial: position + 1 for position, trial in enumerate(order)}
    rows = [(i, ", ".join(sorted(f"{k}={v}" for k, v in setting.items())), float(score), rank[i])
            for i, (setting, score) in enumerate(trials)]
    return df.sparkSession.createDataFrame(rows, "trial int, params string, metric double, rank int")


def adaptive_search_trials(df: DataFrame, estimator: Estimator, space: Mapping[str, tuple], evaluator: Evaluator,
                           key: str, n_trials: int = 20, startup: int = 10, per_round: int = 2, k: int = 3,
                           seed: int = 1234, parallelism: int = 2) -> DataFrame:
    """``trial, params, metric, rank``: random trials first, then rounds of proposals, each round side by side."""
    rng, trials = random.Random(seed), []
    sign = 1.0 if evaluator.isLargerBetter() else -1.0
    folded = with_fold(df, key, k).persist()
    try:
        while len(trials) < n_trials:
            count = min(startup, n_trials) if not trials else min(per_round, n_trials - len(trials))
            settings = settings_of_round(space, [(s, sign * v) for s, v in trials], count, startup, rng)
            maps = [{estimator.getParam(name): value for name, value in setting.items()} for setting in settings]
            scores = _cross_validate(estimator, maps, evaluator, folded, k, parallelism)
            trials += list(zip(settings, scores))
    finally:
        folded.unpersist()
    return trials_table(df, trials, evaluator.isLargerBetter())
