"""Scores from predictions. Large tables are reduced by one map-side combined count;
everything after it works on at most classes x classes rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _as_int(condition: Column) -> Column:
    return condition.cast("int")


def confusion_matrix(df: DataFrame, classes: Sequence | None = None,
                     truth: str = "y", predicted: str = "y_pred") -> DataFrame:
    """``y, y_pred, n`` for every pair of classes, zeros included.

    Classes default to all values found on either side.
    """
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    if classes is None:
        found = counts.select(F.explode(F.array(truth, predicted)).alias("c")).agg(F.collect_set("c").alias("c"))
    else:
        found = df.sparkSession.range(1).select(F.array(*[F.lit(c) for c in classes]).alias("c"))
    grid = (found.select("c", F.explode("c").alias(truth))
            .select(truth, F.explode("c").alias(predicted)))
    return (grid.join(counts, [truth, predicted], "left")
            .select(truth, predicted, F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_matrix_norm(df: DataFrame, classes: Sequence | None = None, truth: str = "y",
                          predicted: str = "y_pred", scale: float = 100.0) -> DataFrame:
    """Share of each true class per predicted class; a class without rows gives zeros."""
    total = F.sum("n").over(Window.partitionBy(truth))
    share = F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)) * scale
    return confusion_matrix(df, classes, truth, predicted).select(truth, predicted, share.alias("share"))


def one_vs_rest_counts(df: DataFrame, classes: Sequence | None = None, truth: str = "y",
                       predicted: str = "y_pred") -> DataFrame:
    """``class, tn, fp, fn, tp`` per class."""
    cells = confusion_matrix(df, classes, truth, predicted)
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    sides = (cells.select("n", hit.alias("hit"), F.explode(F.array(
        F.struct(F.col(truth).alias("class"), F.lit(True).alias("true_side")),
        F.struct(F.col(predicted).alias("class"), F.lit(False).alias("true_side")))).alias("s"))
        .groupBy("s.class")
        .agg(F.sum(F.when(F.col("s.true_side"), F.col("n")).otherwise(0)).alias("actual"),
             F.sum(F.when(~F.col("s.true_side"), F.col("n")).otherwise(0)).alias("guessed"),
             F.sum(F.when(F.col("s.true_side"), F.col("hit")).otherwise(0)).alias("tp")))
    total = F.sum("actual").over(Window.partitionBy())
    return sides.select(
        "class", (total - F.col("actual") - F.col("guessed") + F.col("tp")).alias("tn"),
        (F.col("guessed") - F.col("tp")).alias("fp"), (F.col("actual") - F.col("tp")).alias("fn"), "tp")


def sens_spec(df: DataFrame, classes: Sequence | None = None, truth: str = "y", predicted: str = "y_pred",
              scale: float = 100.0) -> DataFrame:
    """Sensitivity and specificity per class and a last row ``Mean``; NULL where undefined."""
    rates = one_vs_rest_counts(df, classes, truth, predicted).select(
        F.col("class").cast("string").alias("class"),
        (F.try_divide("tp", F.col("tp") + F.col("fn")) * scale).alias("sensitivity"),
        (F.try_divide("tn", F.col("tn") + F.col("fp")) * scale).alias("specificity"))
    mean = rates.agg(F.lit("Mean").alias("class"), F.avg("sensitivity").alias("sensitivity"),
                     F.avg("specificity").alias("specificity"))
    return rates.unionByName(mean)


def accuracy(df: DataFrame, truth: str = "y", predicted: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(_as_int(F.col(truth) == F.col(predicted))).alias("accuracy"))


def cv_scores(df: DataFrame, truth: str = "y", predicted: str = "y_pred", fold: str = "fold") -> DataFrame:
    """Accuracy per fold with the mean and population deviation over the folds on every row."""
    folds = Window.partitionBy()
    return (accuracy(df, truth, predicted, [fold])
            .withColumns({"mean_accuracy": F.avg("accuracy").over(folds),
                          "std_accuracy": F.stddev_pop("accuracy").over(folds)}))


def _label_counts(df: DataFrame, targets: str, predicted: Column) -> DataFrame:
    pairs = df.select(F.posexplode(F.arrays_zip(F.col(targets).alias("y"), predicted.alias("p"))).alias("label", "c"))
    y, p = F.col("c.y") == 1, F.col("c.p") == 1
    return pairs.groupBy("label").agg(
        F.sum(_as_int(~y & ~p)).alias("tn"), F.sum(_as_int(~y & p)).alias("fp"),
        F.sum(_as_int(y & ~p)).alias("fn"), F.sum(_as_int(y & p)).alias("tp"))


def _thresholded(probabilities: str, threshold: float) -> Column:
    return F.transform(probabilities, lambda p: _as_int(p > threshold))


def multilabel_metrics(df: DataFrame, targets: str = "targets", probabilities: str = "probabilities",
                       threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall as unweighted means over the labels; 0 where a label has no basis."""
    counts = _label_counts(df, targets, _thresholded(probabilities, threshold))
    ratio = lambda top, bottom: F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.agg(F.avg(ratio(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
                      F.avg(ratio(tp, tp + fp)).alias("precision"), F.avg(ratio(tp, tp + fn)).alias("recall"))


def multilabel_confusion(df: DataFrame, targets: str = "targets", probabilities: str = "probabilities",
                         threshold: float = 0.5) -> DataFrame:
    """``label, y, y_pred, n``: one 2 x 2 table per label, zeros included."""
    cell = lambda y, p, n: F.struct(F.lit(y).alias("y"), F.lit(p).alias("y_pred"), F.col(n).alias("n"))
    cells = F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
    return (_label_counts(df, targets, _thresholded(probabilities, threshold))
            .select("label", F.inline(cells)))


# Fixed value: logarithms are cut off here.
MIN_LOG = -100.0


def _log(p: Column) -> Column:
    return F.when(p <= 0, MIN_LOG).otherwise(F.greatest(F.log(p), F.lit(MIN_LOG)))


def bce_loss(df: DataFrame, targets: str = "targets", probabilities: str = "probabilities") -> DataFrame:
    """Mean binary cross-entropy over all spectra and labels."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(targets).alias("y"), F.col(probabilities).alias("p"))).alias("c"))
    y, p = F.col("c.y"), F.col("c.p")
    return pairs.agg(F.avg(-(y * _log(p) + (1 - y) * _log(1 - p))).alias("loss"))


def r2_score(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient of determination in one pass."""
    residual = F.sum(F.pow(F.col(truth) - F.col(predicted), 2))
    return df.groupBy(*by).agg((1 - F.try_divide(residual, F.var_pop(truth) * F.count(truth))).alias("r2"))
