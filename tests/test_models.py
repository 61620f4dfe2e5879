"""Classifiers on separable spectra, cross-validation, saving, search, flows and streams."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from spectraloom import schema
from spectraloom.models import evaluate, search
from spectraloom.models.classifiers import get_model, predict
from spectraloom.models.stages import CleaningStep, RandomFourierFeatures
from spectraloom.operators import metrics, splits
from spectraloom.plans import flows
from spectraloom.streaming import spectra as streams

CLASSES = ["casei", "brevis", "grayi"]


@pytest.fixture(scope="module")
def separable(spark):
    """Three classes with a peak at different places; labels ``y``, names and cultures."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        y = i % 3
        x = rng.normal(0, 0.3, 24) + 6 * np.exp(-((np.arange(24) - (4 + 8 * y)) / 2.0) ** 2)
        rows.append((f"s{i:03d}", y, CLASSES[y], f"c{i % 6}", f"f{i}.txt", "m", [float(v) for v in x]))
    df = spark.createDataFrame(rows, "spectrum_id string, y int, species string, culture string, filename string, "
                                     "measurement string, intensities array<double>").repartition(3).cache()
    df.count()
    return df


PARAMS = {
    schema.METHOD_SVM: {"num_features": 128},
    schema.METHOD_RANDOM_FOREST: {"num_trees": 5, "max_depth": None},
    schema.METHOD_LOGISTIC_REGRESSION: {},
    schema.METHOD_PERCEPTRON: {},
    schema.METHOD_BOOSTING: {"rounds": 3, "checkpoint_every": 2},
}


@pytest.mark.parametrize("method", list(PARAMS))
def test_methods_learn_and_survive_saving(spark, separable, method, tmp_path):
    split = splits.split_by_case(separable, "spectrum_id").cache()
    model = get_model(method, PARAMS[method]).fit(split.where("role = 'train'"))
    test = split.where("role = 'test'")
    scored = predict(model, test)
    assert scored.columns == [*test.columns, "y_pred"]
    assert metrics.accuracy(scored).first()[0] > 0.9
    evaluate.save_model(model, str(tmp_path), spark, {"method": method, "seed": 0})
    loaded, meta = evaluate.load_model(str(tmp_path), spark)
    assert meta["method"] == method
    before = sorted(map(tuple, scored.select("spectrum_id", "y_pred").collect()))
    assert sorted(map(tuple, predict(loaded, test).select("spectrum_id", "y_pred").collect())) == before


def test_unknown_method():
    with pytest.raises(ValueError):
        get_model("Oracle")


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, intensities array<double>")
    z = np.array([r["features"].toArray() for r in RandomFourierFeatures(gamma=0.1, numFeatures=20000).transform(df)
                  .orderBy("id").collect()])
    exact = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))
    np.testing.assert_allclose(z @ z.T, exact, atol=0.05)


def test_cross_validation_predicts_every_row_once(separable):
    done = evaluate.cross_validate(separable, get_model(schema.METHOD_LOGISTIC_REGRESSION), k=4)
    assert done.predictions.count() == 150
    assert done.predictions.select("spectrum_id").distinct().count() == 150
    scores = done.scores.collect()
    values = [r["accuracy"] for r in scores]
    assert len(scores) == 4 and min(values) > 0.9
    assert scores[0]["mean_accuracy"] == pytest.approx(np.mean(values))
    assert scores[0]["std_accuracy"] == pytest.approx(np.std(values))
    done.close()


def test_multilabel_models(separable):
    both = F.array((F.col("y") != 1).cast("int"), (F.col("y") == 2).cast("int"))
    df = separable.withColumn("targets", both)
    models = evaluate.fit_multilabel(df, get_model(schema.METHOD_LOGISTIC_REGRESSION), 2)
    scored = evaluate.predict_multilabel(models, df)
    assert metrics.multilabel_metrics(scored, "targets", "predicted").first()["accuracy"] > 0.95
    network = evaluate.fit_multilabel_network(df, 2, hidden=(8,), max_iter=60)
    scored = evaluate.label_probabilities(network, df)
    assert metrics.multilabel_metrics(scored).first()["accuracy"] > 0.9
    assert metrics.bce_loss(scored).first()[0] < 0.4
    assert "features" not in scored.columns


def test_cleaning_steps_as_stages(separable, tmp_path):
    stages = [CleaningStep(step="despike", names=["threshold", "ma"], values=[30.0, 4.0]),
              CleaningStep(step="smooth", names=["window", "polyorder"], values=[7.0, 2.0]),
              CleaningStep(step="normalize")]
    model = Pipeline(stages=stages).fit(separable)
    model.write().save(str(tmp_path / "m"))
    got = PipelineModel.load(str(tmp_path / "m")).transform(separable)
    norms = got.select(F.sqrt(F.aggregate("intensities", F.lit(0.0), lambda a, v: a + v * v)).alias("n"))
    assert [round(v, 6) for v in norms.agg(F.min("n"), F.max("n")).first()] == [100.0, 100.0]


def test_projection_is_the_principal_plane(separable):
    got = {r["spectrum_id"]: (r["x"], r["y"]) for r in evaluate.project_2d(separable).collect()}
    rows = separable.select("spectrum_id", "intensities").orderBy("spectrum_id").collect()
    x = np.array([r["intensities"] for r in rows])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for component in range(2):
        axis = axes[component] * np.sign(axes[component][np.abs(axes[component]).argmax()])
        np.testing.assert_allclose([got[r["spectrum_id"]][component] for r in rows], x @ axis, atol=1e-6)


def test_grid_and_random_search(spark):
    df = spark.range(120).select("id", (F.col("id") % 11).cast("double").alias("a"))
    df = df.withColumn("y", 3 * F.col("a") + 1 + F.rand(1) * 0.01)
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    train, test = df.where("id < 90"), df.where("id >= 90")
    report = search.grid_search_report(train, test, {"linear": LinearRegression(labelCol="y")},
                                       {"linear": {"regParam": [0.0, 100.0]}}, "y", "id").collect()
    assert report[0]["best_params"] == "regParam=0.0" and report[0]["test_r2"] > 0.99
    space = {"regParam": ("interval", 0.0, 50.0), "maxIter": ("choice", [5, 10])}
    evaluator = RegressionEvaluator(labelCol="y", metricName="r2")
    trials = search.random_search_trials(df, LinearRegression(labelCol="y"), space, evaluator, "id", n_trials=4).collect()
    assert sorted(r["rank"] for r in trials) == [1, 2, 3, 4]
    best = max(trials, key=lambda r: r["metric"])
    assert best["rank"] == 1
    again = search.random_search_trials(df, LinearRegression(labelCol="y"), space, evaluator, "id", n_trials=4).collect()
    assert [r["params"] for r in again] == [r["params"] for r in trials]
    with pytest.raises(ValueError):
        search.draw({"a": ("gauss", 1, 2)}, None)


def test_classify_flow_and_describe(separable, tmp_path):
    from spectraloom.sinks.tables import export_results
    done = flows.classify(separable, "species", CLASSES, schema.METHOD_LOGISTIC_REGRESSION,
                          steps=[("smooth", {"window": 5}), ("normalize", {})], k=3)
    tables = done.tables
    assert tables["confmat"].agg(F.sum("n")).first()[0] == 150
    assert {r["class"] for r in tables["per_class"].collect()} == {*CLASSES, "Mean"}
    assert tables["accuracy"].first()[0] > 0.9
    assert tables["predictions"].count() == 150
    export_results(tables, str(tmp_path / "results"))
    done.close()
    with pytest.raises(ValueError):
        flows.classify(separable, "species", ["casei"], schema.METHOD_SVM)
    seen = flows.describe(separable, species=["casei", "grayi"])
    assert seen["total"].first()[0] == 100
    assert seen["species_means"].count() == 2 * 24 and seen["mean"].count() == 24
    assert {r["n"] for r in seen["cultures_per_species"].collect()} == {2}
    assert seen["culture_means"].where("shifted_mean IS NULL").count() == 0


def test_prepare_flow(spark, tmp_path):
    for k in range(5):
        folder = tmp_path / "in" / f"2301_s{k}"
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text('{"source": "lab", "species": "casei", "pcr": null}')
        (folder / f"a{k}_p01_000001.txt").write_text("1 2 3\n4 5 6\n")
    flows.prepare(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["casei"], "f", n_splits=2)
    split = spark.read.parquet(str(tmp_path / "out/splits"))
    assert {(r["role"], r["count"]) for r in split.groupBy("split", "role").count().collect()} == {("train", 4), ("val", 1)}
    assert spark.read.parquet(str(tmp_path / "out/spectra")).count() == 5


def test_stream_gives_the_rows_of_the_batch(spark, separable, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    separable.select("spectrum_id", F.col("intensities").alias("wavenumbers"), "intensities").write.parquet(source)
    steps = [("despike", {"stats": (0.0, 0.5), "threshold": 8}), ("smooth", {"window": 5}), ("baseline", {"lam": 10.0}),
             ("normalize", {})]
    cleaned = streams.clean_stream(streams.read_spectra_stream(spark, source), steps)
    streams.write_spectra_stream(cleaned, out, str(tmp_path / "state")).awaitTermination(120)
    from spectraloom.operators.signal import preprocess
    key = lambda df: sorted((r["spectrum_id"], r["intensities"]) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(preprocess(spark.read.parquet(source), steps))
    with pytest.raises(ValueError):
        streams.clean_stream(cleaned, [("despike", {})])
