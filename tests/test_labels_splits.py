"""Labels, filters, scaling, splits and folds: edge rows and invariants."""

import pytest
from pyspark.sql import functions as F

from spectraloom.operators import joins, labels, metrics, scaling, splits, stats


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.fixture(scope="module")
def annotated(spark):
    rows = [(0, "casei", None), (1, None, "brevis+grayi"), (2, None, None), (3, "lactocasei", "x")]
    return spark.createDataFrame(rows, "id int, species string, pcr string")


def test_multilabel_targets(annotated):
    df = labels.fill_label(annotated)
    names = ["casei", "brevis", "grayi"]
    assert column(labels.multilabel_targets(df, names), "targets") == [[1, 0, 0], [0, 1, 1], [0, 0, 0], [1, 0, 0]]
    token = labels.multilabel_targets(df, names, match="token")
    assert column(token, "targets") == [[1, 0, 0], [0, 1, 1], [0, 0, 0], [0, 0, 0]]
    assert column(labels.has_target(token), "id") == [0, 1]


def test_classification_target(annotated):
    df = labels.fill_label(annotated)
    known = labels.classification_target(df.where("id < 2"), ["brevis", "casei"])
    assert column(known, "target") == [1, 0]
    assert column(labels.classification_target(df, ["brevis", "casei"], unknown="null"), "target") == [1, 0, None, None]
    with pytest.raises(Exception, match="label is not a known class"):
        labels.classification_target(df, ["brevis", "casei"]).collect()


def test_label_list_cells(spark):
    cells = ["['a ', 'b']", "a, b", "a", None, "[]"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, cell string")
    assert column(df.select("id", labels.parse_label_list(F.col("cell")).alias("l")), "l") == [
        ["a", "b"], ["a", "b"], ["a"], None, []]
    assert labels.label_table(df, "cell", "id").count() == 5
    joined = df.where("id in (1, 2, 3)").select("id", labels.join_label_list(F.col("cell")).alias("l"))
    assert column(joined, "l") == ["a+b", "a", None]


def test_first_match_keeps_list_order(spark):
    df = spark.createDataFrame([(0, "/data/BREVIS_casei"), (1, "none")], "id int, path string")
    got = df.select("id", labels.first_match(F.col("path"), ["casei", "brevis"]).alias("m"))
    assert column(got, "m") == ["casei", None]


def test_filter_rows(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 2)], "id int, s string, n int")
    assert column(labels.filter_rows(df, {"s": "a", "n": [1, 2]}), "id") == [0, 2]
    assert column(labels.filter_rows(df, {"n": 2}, "s = 'a'"), "id") == [2]
    with pytest.raises(ValueError):
        labels.filter_rows(df, query=3)


def test_min_max_golden_values(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "id int, v double")
    scale = scaling.fit_min_max(df, "v")
    scaled = df.select("id", scale.transform(F.col("v")).alias("s"))
    assert column(scaled, "s") == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert column(scaled.select("id", scale.inverse(F.col("s")).alias("v")), "v") == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert spark.range(1).select(scale.transform(F.lit(6.0)).alias("s")).first()["s"] == 1.25
    constant = scaling.fit_min_max(df.select(F.lit(7.0).alias("v")), "v")
    assert spark.range(1).select(constant.transform(F.lit(7.0)).alias("s")).first()["s"] == 0.0


def test_class_without_rows_or_predictions(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, y_pred int")
    rates = {r["class"]: (r["sensitivity"], r["specificity"]) for r in metrics.sens_spec(df, [0, 1, 2]).collect()}
    assert rates["0"] == (50.0, 100.0) and rates["1"] == (100.0, 50.0)
    assert rates["2"] == (None, 100.0)
    assert rates["Mean"] == (75.0, pytest.approx(250 / 3))
    cells = metrics.confusion_matrix(df, [0, 1, 2])
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == 3
    assert metrics.confusion_matrix(df).count() == 4
    shares = metrics.confusion_matrix_norm(df, [0, 1, 2]).where("y = 2")
    assert [r["share"] for r in shares.collect()] == [0.0] * 3


def test_multilabel_edges(spark):
    df = spark.createDataFrame([([1, 0], [0.5, 0.9]), ([1, 0], [0.0, 0.2])],
                               "targets array<int>, probabilities array<double>")
    row = metrics.multilabel_metrics(df).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.25, 0.0, 0.0)
    assert metrics.bce_loss(df.limit(1).withColumn("probabilities", F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == 50.0


def skewed(spark, n=3000):
    """One group and one class hold a third of the rows."""
    group = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1)
    label = F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string")))
    return spark.range(n).withColumns({"group": group, "label": label})


@pytest.mark.parametrize("groups,train", [(1, 0), (4, 3), (10, 8)])
def test_group_split_sizes(spark, groups, train):
    df = spark.range(200).withColumn("g", F.col("id") % groups)
    got = splits.group_shuffle_split(df, "g", n_splits=4)
    assert got.count() == 800
    sizes = got.groupBy("split", "role").agg(F.count_distinct("g").alias("n")).where("role = 'train'")
    assert {r["n"] for r in sizes.collect()} == ({train} if train else set())


def test_groups_stay_on_one_side(spark):
    got = splits.group_shuffle_split(skewed(spark), "group", n_splits=3, seed=7)
    sides = got.groupBy("split", "group").agg(F.count_distinct("role").alias("sides"))
    assert sides.where("sides <> 1").count() == 0
    assert got.groupBy("split").agg(F.count_distinct("id").alias("n")).where("n <> 3000").count() == 0
    chosen = {r["split"]: r["g"] for r in got.where("role = 'train'").groupBy("split")
              .agg(F.sort_array(F.collect_set("group")).alias("g")).collect()}
    assert len({tuple(g) for g in chosen.values()}) == 3


@pytest.mark.parametrize("k", [2, 5, 20])
def test_folds_are_balanced_and_complete(spark, k):
    got = splits.stratified_folds(skewed(spark), "label", k, "id", seed=3)
    assert got.count() == 3000 and got.select("id").distinct().count() == 3000
    sizes = got.groupBy("label", "fold").count().groupBy("label").agg(
        F.max("count").alias("high"), F.min("count").alias("low"), F.count("*").alias("folds"))
    assert sizes.where(f"high - low > 1 OR folds <> {k}").count() == 0


def test_folds_of_a_class_smaller_than_k_and_of_missing_labels(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, None), (4, None)], "id int, label string")
    got = splits.stratified_folds(df, "label", 5, "id")
    assert got.count() == 5
    assert got.groupBy("label", "fold").count().where("count > 1").count() == 0


def test_folds_do_not_shuffle_the_rows(spark):
    wide = skewed(spark).withColumn("intensities", F.array_repeat(F.lit(1.0), 10))
    plan = splits.stratified_folds(wide, "label", 5, "id")._jdf.queryExecution().optimizedPlan().toString()
    # the payload column is read in one place only: the row side of a broadcast join
    assert plan.count("array_repeat") <= 1


def test_source_split(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, None)], "id int, source string")
    assert column(splits.split_by_source(df, ["a"]), "role") == ["train", "test", "test"]
    assert column(splits.split_by_source(df, ["a"], ["c"]), "id") == [0, 2]
    with pytest.raises(ValueError):
        splits.split_by_source(df, ["a"], ["a", "b"])


@pytest.mark.parametrize("max_rows", [0, 1, 100])
def test_join_small_gives_the_same_rows_on_both_ways(spark, max_rows):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    assert column(joins.join_small(left, right, ["k"], max_rows=max_rows), "v") == [10, 20, None]


def test_unique_ids(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "spectrum_id string")
    with pytest.raises(ValueError, match="'a'"):
        joins.assert_unique(df)
    assert joins.assert_unique(df.distinct()).count() == 2


def test_bands_leave_out_missing_points(spark):
    df = spark.createDataFrame([(0, "a", [1.0, float("nan")]), (1, "a", [3.0, 4.0]), (2, "b", [5.0, None])],
                               "spectrum_id int, c string, intensities array<double>")
    band = {(r["c"], r["idx"]): (r["mean"], r["std"]) for r in stats.class_mean_band(df, "c", 10.0).collect()}
    assert band[("a", 0)] == (2.0, pytest.approx(2 ** 0.5))
    assert band[("a", 1)] == (4.0, None)
    assert band[("b", 0)] == (15.0, None) and band[("b", 1)] == (None, None)
    explicit = {(r["c"], r["idx"]): r["mean"] for r in stats.class_mean_band(df, "c", 1.0, ["b", "a"]).collect()}
    assert explicit[("b", 0)] == 5.0 and explicit[("a", 0)] == 3.0


def test_culture_means_are_spectra_again(spark):
    df = spark.createDataFrame([("x", [1.0, 2.0, 3.0]), ("x", [3.0, 4.0, 5.0]), ("y", [0.0, 1.0, 0.0])],
                               "culture string, intensities array<double>")
    got = {r["culture"]: r["intensities"] for r in stats.culture_means(df).collect()}
    assert got == {"x": [2.0, 3.0, 4.0], "y": [0.0, 1.0, 0.0]}


def test_last_n_mean_skips_unfinished_blocks(spark):
    log = spark.range(7).select(F.lit(0).alias("epoch"), F.col("id").alias("iter"), F.col("id").cast("double").alias("loss"))
    got = {r["iter"]: r["loss"] for r in stats.last_n_mean(log, ["loss"], 3).collect()}
    assert got == {2: 1.0, 5: 4.0}


def test_caps_and_samples(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.when(F.col("id") < 600, "a").otherwise("b")).alias("c"))
    capped = splits.cap_per_class(df, "c", 50, "id")
    assert {r["c"]: r["count"] for r in capped.groupBy("c").count().collect()} == {"a": 50, "b": 50, None: 50}
    again = splits.cap_per_class(df.repartition(7), "c", 50, "id")
    assert column(capped.orderBy("id"), "id") == column(again.orderBy("id"), "id")
    assert splits.cap_per_class(df, "c", 5000, "id").count() == 1000 and splits.cap_per_class(df, "c", 0, "id").count() == 0
    assert splits.sample_n(df, 77, "id").count() == 77 and splits.sample_n(df, 1000, "id").count() == 1000
    assert splits.sample_n(df.where("false"), 5, "id").count() == 0
    other = splits.cap_per_class(df, "c", 50, "id", seed=1)
    assert column(other.orderBy("id"), "id") != column(capped.orderBy("id"), "id")
