import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from reqloom.plans import registry


def comparable(frame):
    def value(x):
        if x is None or x is pd.NA or x != x:
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    columns = sorted(frame.columns)
    return columns, sorted(repr([value(x) for x in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(tables):
    db = duckdb.connect()
    for name in os.listdir(tables):
        path = f"{tables}/{name}"
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, tables, duck, name):
    spark.catalog.clearCache()
    rows = registry.QUERIES[name](spark, tables).toPandas()
    assert comparable(rows) == comparable(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_has_rows(spark, tables, name):
    assert registry.QUERIES[name](spark, tables).count() > 0


@pytest.mark.parametrize("name", ["final_export", "bags", "bow_dictionary", "global_nmf", "tfidf", "topic_sizes", "vocabulary"])
def test_sentences_are_held_without_their_documents(spark, tables, name, monkeypatch):
    """Neither memory nor scratch tables get a row a sentence with its whole document: that is its square."""
    from reqloom import scratch

    held = []
    kind = type(spark.range(1))
    persist, written_at = kind.persist, scratch.written_at
    monkeypatch.setattr(kind, "persist", lambda df, *a: held.append(df.columns) or persist(df, *a))
    monkeypatch.setattr(scratch, "written_at", lambda df, *a: held.append(df.columns) or written_at(df, *a))
    registry.QUERIES[name](spark, tables)
    assert held and not [c for c in held if "sent_idx" in c and {"message_raw", "message_punctuated"} & set(c)]
    assert not [c for c in held if "sentence" in c and "context" in c]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_command_line(tables, tmp_path, spark):
    from reqloom import cli

    cli.main(["query", "sentence_flags", "--tables", tables, "--output", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_stream(spark, tmp_path):
    from reqloom.streaming import incremental

    rows = spark.createDataFrame([("0", "good"), ("1", "bad"), ("2", "good")], "sent_id string, sentence string")
    for at in range(2):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.read_sentences(spark, f"{tmp_path}/in")
        incremental.score_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cache", f"{tmp_path}/mark").awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out").count() == 3 * (at + 1)
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 2
