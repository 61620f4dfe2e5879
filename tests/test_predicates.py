"""Query strings against the data-frame library's own reading of them."""

import pandas as pd
import pytest

from spectraloom.operators import labels
from spectraloom.operators.predicates import condition, predicate

ROWS = [(0, 1.5, "x", "casei", True), (1, None, "y", "brevis", False), (2, -3.0, None, "casei", True),
        (3, 0.0, "x & y", None, False), (4, 7.25, "z", "grayi", True), (5, 2.0, "it's", "ecoli", False)]
QUERIES = [
    "a > 1", "a > 1 & kind == 'casei'", "a > 1 and kind == 'casei' or id < 1", "a > 0 | id in [1, 2]", "not (a > 1)",
    "~(a > 1) & id != 3", "0 <= a < 5", "kind in ['casei', 'brevis']", "kind not in ['casei', 'brevis']",
    "kind == ['casei', 'grayi']", "kind != ['casei', 'grayi']", "kind != 'casei'", "`odd name` == 'x & y'",
    "`odd name` == \"it's\" or a == -3", "a + 1 > 2 * id", "a * -1 >= 3", "id % 2 == 1 and a != 7.25", "flag", "not flag and id > 0",
    "a == a", "a != a", "id in [] or id == 4", "(id > 1) & (id < 5) & ~(kind == 'grayi')", "1 < id <= 3 != a", "id / 2 > 1.4",
]


@pytest.fixture(scope="module")
def frames(spark):
    columns = ["id", "a", "odd name", "kind", "flag"]
    local = pd.DataFrame(ROWS, columns=columns)
    return local, spark.createDataFrame(ROWS, "id int, a double, `odd name` string, kind string, flag boolean")


@pytest.mark.parametrize("query", QUERIES)
def test_as_the_data_frame_library(frames, query):
    local, df = frames
    expected = sorted(local.query(query, engine="python")["id"])
    assert sorted(r["id"] for r in df.where(predicate(query)).collect()) == expected
    assert sorted(r["id"] for r in labels.filter_rows(df, query=query, grammar="frame").collect()) == expected
    opposite = df.where(~predicate(query)).count()
    assert opposite == len(ROWS) - len(expected)


@pytest.mark.parametrize("query", ["a >", "a.max() > 1", "@other == 1", "a = 1", "kind in 'casei'", "len(kind) > 1", "a + 1", "[1, 2] > a",
                                   "a is None", "lambda: 1", "`a == 1"])
def test_what_is_no_query(query):
    with pytest.raises(ValueError):
        predicate(query)


def test_filters_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = orders.where(condition("o_orderkey > 100 & o_orderstatus in ['F', 'O']"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThan(o_orderkey,100)" in pushed and "In(o_orderstatus, [F,O])" in pushed
