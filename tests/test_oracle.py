"""Every registered query against its SQL, and rows for those without SQL."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle import connect, differences

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf_dir, con):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["name", "idx", "mean", "std", "lower", "upper"]
    assert result.count() == 10 * 64


@pytest.mark.parametrize("name", ["group_shuffle_split", "stratified_folds", "class_mean_band", "despike"])
def test_result_does_not_depend_on_partitioning(name, spark, sf_dir, con):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
