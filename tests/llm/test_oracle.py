import os

import duckdb
import pandas as pd
import pytest

from reqloom.llm import registry


def comparable(frame):
    value = lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    columns = sorted(frame.columns)
    return columns, sorted(repr([value(x) for x in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, tables, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        path = f"{tables}/{table}.parquet"
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    assert comparable(registry.QUERIES[name](spark, tables).toPandas()) == comparable(db.sql(registry.ORACLE_SQL[name]).df())
