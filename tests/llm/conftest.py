import pytest
from llm_rows import TEXTS, table_of


@pytest.fixture(scope="session")
def messy_rows():
    rows = list(enumerate(TEXTS))
    # a row repeated whole, a null id (twice), an id with two texts
    return [*rows, rows[6], (None, "one two three"), (None, "nobody has this text but rows without an id"), (None, "nobody has this text but rows without an id"), (5, "another text of five")]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return table_of(spark, messy_rows).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return table_of(spark, [])
