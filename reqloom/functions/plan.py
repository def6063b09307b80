"""Ways to have an expression evaluated once where it is used many times; the optimiser would copy it into each use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` bound as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, made as a generated row: projections don't merge across it."""
    return df.withColumn(name, F.explode(F.array(value)))
