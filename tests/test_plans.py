"""Physical plans of the registered queries: no all-pairs joins, pruned scans, pushed filters, no needless shuffles."""

import pytest

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
# one row per input row, computed in place
NO_SHUFFLE = ["path_fields", "first_match_label", "group_union", "to_long", "fill_label", "multilabel_targets",
              "has_target", "isin_filter", "dict_and_query_filter", "detector_target", "classification_target",
              "label_encode", "label_list_table", "is_target", "prediction_flags", "threshold_labels", "minmax_scale",
              "minmax_inverse", "split_by_source", "stack_splits", "first_difference", "modified_z",
              "modified_z_per_spectrum", "despike", "savgol", "demean", "l2_normalize", "baseline_correct",
              "preprocess_default", "preprocess_subset"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_all_pairs_join(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_row_wise_queries_do_not_shuffle(name, spark, sf_dir):
    assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(QUERIES["dict_and_query_filter"](spark, sf_dir))
    pushed = text[text.index("PushedFilters"):]
    assert "In(o_orderstatus, [F,O])" in pushed and "GreaterThan(o_totalprice,100000.0)" in pushed
    schema = plan(QUERIES["class_counts"](spark, sf_dir))
    assert "ReadSchema: struct<l_returnflag:string>" in schema


@pytest.mark.parametrize("name", ["group_shuffle_split", "stratified_folds"])
def test_splits_compare_rows_with_a_broadcast_table(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    assert "BroadcastHashJoin" in text
