"""Kernel machines on landmarks against an exact solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom import schema
from spectraloom.models import kernel_machines
from spectraloom.models.classifiers import get_model, kernel_width, predict
from tests import exact


def overlapping(n, classes, width, seed, spread=1.2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return rng.normal(size=(classes, width))[y] * spread + rng.normal(size=(n, width)), y


def frame(spark, x, y):
    rows = [(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "spectrum_id int, y int, intensities array<double>").repartition(3)


@pytest.mark.parametrize("c", [1000.0, 10.0])
def test_as_an_exact_solver(spark, c):
    """As many landmarks as rows: the same class for at least 0.98 of all rows, held out and not."""
    x, y = overlapping(360, 4, 10, 0)
    df = frame(spark, x, y)
    train = df.where("spectrum_id % 5 <> 0")
    model = get_model(schema.METHOD_SVM, {"C": c}).fit(train)
    got = np.array([r["y_pred"] for r in predict(model, df).orderBy("spectrum_id").collect()])
    rows = np.arange(360) % 5 != 0
    gamma = kernel_width(train)
    assert abs(gamma - 1 / (10 * x[rows].var())) < 1e-12
    expected = exact.kernel_votes(x[rows], y[rows], x, gamma, c)
    print("agreement", (got == expected).mean())
    assert (got == expected).mean() >= 0.98


def test_fewer_landmarks_come_close(spark):
    x, y = overlapping(600, 3, 6, 1)
    df = frame(spark, x, y)
    few = get_model(schema.METHOD_SVM, {"C": 10.0, "landmarks": 150}).fit(df)
    got = np.array([r["y_pred"] for r in predict(few, df).orderBy("spectrum_id").collect()])
    expected = exact.kernel_votes(x, y, x, kernel_width(df), 10.0)
    assert (got == expected).mean() >= 0.95


def test_descriptions_give_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 5))
    z = kernel_machines.kernel(x, x, 0.1) @ kernel_machines.basis_of(x, 0.1)
    np.testing.assert_allclose(z @ z.T, kernel_machines.kernel(x, x, 0.1), atol=1e-6)


def test_rounded_corner():
    margin = np.linspace(-1, 3, 4001)
    loss, slope, curve = kernel_machines.rounded_hinge(margin, 0.5)
    assert (np.abs(loss - np.maximum(1 - margin, 0)) <= 0.125 + 1e-12).all()
    np.testing.assert_allclose(np.gradient(loss, margin)[1:-1], slope[1:-1], atol=2e-3)
    assert set(np.round(curve, 9)) == {0.0, 1.0}


def test_slices_do_not_matter(spark, monkeypatch):
    """Each machine in one task, one slice for all machines, four slices."""
    x, y = overlapping(200, 3, 4, 2)
    df = frame(spark, x, y)
    found = []
    for apart, rows in ((1000, 1000), (0, 1000), (0, 50)):
        monkeypatch.setattr(kernel_machines, "APART_ROWS", apart)
        monkeypatch.setattr(kernel_machines, "SLICE_ROWS", rows)
        found.append(get_model(schema.METHOD_SVM, {"C": 10.0}).fit(df).stages[0].arrays["weights"])
    for other in found[1:]:
        np.testing.assert_allclose(found[0], other, rtol=1e-3, atol=1e-4)


def test_one_class_equal_rows_and_nulls(spark):
    x, y = overlapping(40, 2, 3, 4)
    df = frame(spark, x, y)
    alone = get_model(schema.METHOD_SVM, {}).fit(df.where("y = 1"))
    assert {r["y_pred"] for r in predict(alone, df).collect()} == {1}
    doubled = df.union(df).withColumn("intensities", F.when(F.col("spectrum_id") > 3, F.col("intensities")))
    model = get_model(schema.METHOD_SVM, {"C": 1.0}).fit(doubled)
    assert len(model.stages[0].arrays["landmarks"]) == 36
    found = {r["spectrum_id"]: r["y_pred"] for r in predict(model, doubled).collect()}
    assert all((found[i] is None) == (i <= 3) for i in found)
