"""Run a query and its SQL on the same tables and compare them as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
                "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    """What differs between a DataFrame and the SQL result; empty when they agree."""
    result = con.execute(sql)
    sql_columns = {c[0]: str(c[1]) for c in result.description}
    sql_rows = result.fetchall()
    found = []
    spark_columns = {f.name: SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString())
                     for f in df.schema.fields}
    if set(spark_columns) != set(sql_columns):
        return [f"columns {sorted(spark_columns)} against {sorted(sql_columns)}"]
    for name in sorted(spark_columns):
        if spark_columns[name] != sql_columns[name]:
            found.append(f"type of {name}: {spark_columns[name]} against {sql_columns[name]}")
    names = sorted(spark_columns)
    order = [list(sql_columns).index(n) for n in names]
    ours = Counter(tuple(_cell(row[n]) for n in names) for row in df.collect())
    theirs = Counter(tuple(_cell(row[i]) for i in order) for row in sql_rows)
    if ours != theirs:
        found.append(f"{sum(ours.values())} rows against {sum(theirs.values())}")
        found += [f"only Spark: {row}" for row in list((ours - theirs))[:limit]]
        found += [f"only SQL: {row}" for row in list((theirs - ours))[:limit]]
    return found
