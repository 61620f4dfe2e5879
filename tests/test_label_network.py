"""The network of all labels: gradients, training, saving; against networks per label."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from spectraloom.models import evaluate, network
from spectraloom.operators import labels, metrics


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12))
    y = np.stack([x[:, 0] * x[:, 1] > 0, x[:, 2] > 0.3, np.abs(x[:, 3]) > 0.7], 1).astype(int)
    rows = [(f"s{i}", x[i].tolist(), y[i].tolist()) for i in range(len(x))]
    df = spark.createDataFrame(rows, "spectrum_id string, intensities array<double>, targets array<int>").repartition(3)
    return df.cache()


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradient_is_the_slope_of_the_loss(dropout):
    rng = np.random.default_rng(1)
    layers = network.first_layers([5, 7, 6, 3], 2, np.float64)
    x, y = rng.normal(size=(9, 5)), rng.integers(0, 2, (9, 3)).astype(float)
    measure = lambda: network.loss_and_gradient(layers, x, y, np.random.default_rng(4), dropout)
    _, gradient = measure()
    for layer, slope in zip(layers, gradient):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in layer.shape)
            old = layer[at]
            layer[at] = old + 1e-6
            up = measure()[0]
            layer[at] = old - 1e-6
            down = measure()[0]
            layer[at] = old
            assert abs((up - down) / 2e-6 - slope[at]) < 1e-5 * max(1, abs(slope[at]))


def test_sums_do_not_depend_on_the_tasks(table, monkeypatch):
    monkeypatch.setattr(network, "CHUNK", 50)
    layers = network.first_layers([12, 8, 3], 1)
    rows = table.select(F.xxhash64("spectrum_id").alias("h"), F.col("intensities").cast("array<float>").alias("x"),
                        F.col("targets").cast("array<float>").alias("y"))
    one = network.round_gradient(rows.coalesce(1), layers, 0, 0, 0.0, 1)
    many = network.round_gradient(rows.repartition(5), layers, 0, 0, 0.0, 5)
    assert one[1] == many[1] == 400 and abs(one[0] - many[0]) < 1e-3
    local = table.toPandas()
    loss, gradient = network.loss_and_gradient(layers, np.array(local.intensities.tolist(), np.float32),
                                               np.array(local.targets.tolist(), np.float32))
    assert abs(loss - one[0]) < 1e-2
    for a, b, c in zip(one[2], many[2], gradient):
        np.testing.assert_allclose(a, b, atol=1e-3)
        np.testing.assert_allclose(a, c, atol=1e-3)


def test_learns_at_least_as_well_as_a_network_per_label(spark, table, tmp_path):
    model, log = network.fit_label_network(table, 3, hidden=(48, 48), rounds=60, rate=0.01, batch_rows=200)
    assert log[-1][2] < 0.5 * log[0][2] and {n for _, n, _ in log} != {400}
    score = lambda scored: metrics.multilabel_metrics(labels.threshold_labels(scored), "targets", "predicted").first()
    mine = score(model.transform(table))
    alone = score(evaluate.label_probabilities(evaluate.fit_multilabel_network(table, 3, hidden=(8,), max_iter=40), table))
    print(mine, alone)
    assert mine["accuracy"] >= alone["accuracy"] and mine["accuracy"] > 0.9
    assert mine["precision"] >= alone["precision"] - 0.02 and mine["recall"] >= alone["recall"] - 0.02
    evaluate.save_model(model, str(tmp_path), spark, {"seed": 0})
    loaded, _ = evaluate.load_model(str(tmp_path), spark)
    key = lambda m: sorted((r["spectrum_id"], r["probabilities"]) for r in m.transform(table).collect())
    assert isinstance(loaded, PipelineModel) and key(loaded) == key(model)


def test_odd_rows(spark, table):
    odd = table.withColumn("intensities", F.when(F.col("spectrum_id") != "s1", F.col("intensities"))).withColumn(
        "targets", F.when(F.col("spectrum_id") != "s2", F.col("targets")))
    model, log = network.fit_label_network(odd, 3, hidden=(4,), rounds=2)
    assert [n for _, n, _ in log] == [398, 398]
    found = {r["spectrum_id"]: r["probabilities"] for r in model.transform(odd).collect()}
    assert found["s1"] is None and len(found["s2"]) == 3
    with pytest.raises(ValueError):
        network.fit_label_network(odd.where("false"), 3)
