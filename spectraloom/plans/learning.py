"""Registered queries that train models. They have no SQL form; tests check their invariants."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spectraloom import schema
from spectraloom.models import embedding, evaluate, network, search
from spectraloom.models.classifiers import get_model, predict
from spectraloom.operators import joins, labels, metrics, signal, splits, stats
from spectraloom.plans import views
from spectraloom.plans.relational import TARGETS, query, rounded
from spectraloom.plans.views import table
from spectraloom.sinks.shared import SharedTables


def _training_table(spark, sf_dir):
    """Normalised spectra with class id, metadata and a grouped train/test role."""
    rows = signal.normalize(views.labelled_spectra(spark, sf_dir)).withColumnRenamed("class_id", "y")
    return splits.split_by_case(rows, "sample")


def _fitted(spark, sf_dir, method, **params):
    """Train on the train role, predict every row."""
    rows = _training_table(spark, sf_dir)
    model = get_model(method, params).fit(rows.where("role = 'train'"))
    return predict(model, rows).select("spectrum_id", "role", "y", "y_pred")


@query()
def clf_svm(spark, sf_dir):
    return _fitted(spark, sf_dir, schema.METHOD_SVM)


@query()
def clf_rf(spark, sf_dir):
    return _fitted(spark, sf_dir, schema.METHOD_RANDOM_FOREST)


@query()
def clf_logreg(spark, sf_dir):
    return _fitted(spark, sf_dir, schema.METHOD_LOGISTIC_REGRESSION)


@query()
def clf_perceptron(spark, sf_dir):
    return _fitted(spark, sf_dir, schema.METHOD_PERCEPTRON)


@query()
def clf_adaboost(spark, sf_dir):
    return _fitted(spark, sf_dir, schema.METHOD_BOOSTING)


@query()
def cv_predict(spark, sf_dir):
    rows = _training_table(spark, sf_dir).drop("role")
    done = evaluate.cross_validate(rows, get_model(schema.METHOD_LOGISTIC_REGRESSION), k=5)
    predictions = SharedTables(spark, "folds").keep(
        done.predictions.select("spectrum_id", "fold", "y", "y_pred"), "predictions")
    done.close()
    return predictions


def _multilabel_table(spark, sf_dir):
    rows = labels.fill_label(signal.normalize(views.labelled_spectra(spark, sf_dir)))
    return labels.has_target(labels.multilabel_targets(rows, TARGETS))


@query()
def clf_multilabel(spark, sf_dir):
    """Binary relevance: macro scores per role."""
    rows = splits.split_by_case(_multilabel_table(spark, sf_dir), "sample")
    trainer = get_model(schema.METHOD_SVM, {"C": 10.0})
    models = evaluate.fit_multilabel(rows.where("role = 'train'"), trainer, len(TARGETS))
    scored = evaluate.predict_multilabel(models, rows.select("role", "targets", "intensities"))
    parts = [metrics.multilabel_metrics(scored.where(F.col("role") == role), "targets", "predicted")
             .withColumn("role", F.lit(role)) for role in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query()
def clf_mlp_multilabel(spark, sf_dir):
    """One network for all labels with the default layers; probabilities and decisions of every row."""
    rows = _multilabel_table(spark, sf_dir)
    model, _ = network.fit_label_network(rows, len(TARGETS))
    scored = labels.threshold_labels(model.transform(rows))
    return scored.select("spectrum_id", "targets", "probabilities", "predicted")


@query()
def train_test_report(spark, sf_dir):
    trainer = get_model(schema.METHOD_LOGISTIC_REGRESSION)
    return evaluate.train_test_report(_training_table(spark, sf_dir), trainer)[1]


@query()
def score_saved_model(spark, sf_dir):
    """Train, save, load, score: the predictions table of the test role. The rows are prepared once."""
    rows = SharedTables(spark, "scoring").keep(_training_table(spark, sf_dir), "rows")
    folder = evaluate.scratch_folder(spark)
    model = get_model(schema.METHOD_LOGISTIC_REGRESSION).fit(rows.where("role = 'train'"))
    evaluate.save_model(model, folder, spark, {"method": schema.METHOD_LOGISTIC_REGRESSION, "seed": 0})
    loaded, _ = evaluate.load_model(folder, spark)
    test = rows.where("role = 'test'")
    named = labels.decode_labels(predict(loaded, test), schema.SPECIES_10, "y_pred", "pred_labelname")
    return joins.predictions_table(evaluate.project_2d(test), named, test, "name")


@query()
def project_2d(spark, sf_dir):
    projected = evaluate.project_2d(signal.normalize(views.spectra(spark, sf_dir)))
    return projected.withColumns(rounded("x", "y"))


@query()
def embed_2d(spark, sf_dir):
    """Neighbour embedding of all spectra."""
    return embedding.embed_2d(signal.normalize(views.spectra(spark, sf_dir))).withColumns(rounded("x", "y"))


@query()
def embed_train_test(spark, sf_dir):
    """Train and test spectra in one plane."""
    rows = _training_table(spark, sf_dir)
    train, test = (rows.where(F.col("role") == role) for role in ("train", "test"))
    return embedding.embed_train_test(train, test).withColumns(rounded("x", "y"))


@query()
def embed_culture_means(spark, sf_dir):
    """The mean spectra of cultures in one plane."""
    means = stats.culture_means(signal.normalize(views.labelled_spectra(spark, sf_dir)))
    return embedding.embed_2d(means, "culture").withColumns(rounded("x", "y"))


@query()
def projection_report(spark, sf_dir):
    """Share of the 15 nearest spectra that each projection keeps."""
    rows = signal.normalize(views.spectra(spark, sf_dir))
    return embedding.planes_kept(rows, evaluate.project_2d)


@query()
def grid_search_report(spark, sf_dir):
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", *columns))
    rows = splits.split_by_case(rows.select("l_orderkey", "l_extendedprice", "features"), "l_orderkey")
    train, test = (rows.where(F.col("role") == role).drop("role") for role in ("train", "test"))
    models = {"linear": LinearRegression(labelCol="l_extendedprice"),
              "tree": DecisionTreeRegressor(labelCol="l_extendedprice", seed=0)}
    grids = {"linear": {"regParam": [0.0, 1.0]}, "tree": {"maxDepth": [2, 4]}}
    return search.grid_search_report(train, test, models, grids, "l_extendedprice", "l_orderkey")


def _search_table(spark, sf_dir):
    return signal.normalize(views.spectra(spark, sf_dir)).select(
        "spectrum_id", F.col("label").cast("double").alias("label"), array_to_vector("intensities").alias("features"))


SEARCH_SPACE = {"regParam": ("interval", 0.0001, 0.1), "maxIter": ("choice", [5, 10, 20, 40])}


@query()
def random_search_trials(spark, sf_dir):
    return search.random_search_trials(_search_table(spark, sf_dir), LogisticRegression(), SEARCH_SPACE,
                                       MulticlassClassificationEvaluator(metricName="accuracy"), "spectrum_id")


@query()
def adaptive_search_trials(spark, sf_dir):
    """Ten random trials, then proposals from what is known."""
    return search.adaptive_search_trials(_search_table(spark, sf_dir), LogisticRegression(), SEARCH_SPACE,
                                         MulticlassClassificationEvaluator(metricName="accuracy"), "spectrum_id")
