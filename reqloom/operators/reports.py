"""Counts, shares, crosstabs, statistics and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, shares: bool = False) -> DataFrame:
    """(column, n[, pct]), the most frequent first; null isn't counted."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if shares:
        out = out.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a value
    return out.orderBy(F.desc("n"), column)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Each row's shares of ``values`` of ``column``, and a last row ``base`` over all."""
    shares = [(F.count_if(F.col(column) == v) / F.count("*")).alias(v) for v in values]
    held = df.where(F.col(row).isNotNull() & F.col(column).isin(list(values)))
    each = held.groupBy(F.col(row).cast("string").alias(row)).agg(F.count("*").alias("n"), *shares)
    return each.unionByName(held.agg(F.lit("base").alias(row), F.count("*").alias("n"), *shares).select(*each.columns))


def length_stats(df: DataFrame, *columns: str) -> DataFrame:
    """(measure, n, mean, median, p95) of numeric columns; quantiles interpolate linearly."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("v.*")
    return long.groupBy("measure").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.percentile("x", 0.95).alias("p95"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) of equal widths from least to largest; the largest value is in the last bin."""
    edges = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    placed = df.select(F.col(column).cast("double").alias("x")).where("x is not null").crossJoin(F.broadcast(edges))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return placed.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """(field, n_present) of every column."""
    present = [F.struct(F.lit(c).alias("field"), F.count(F.col(f"`{c}`")).alias("n_present")) for c in df.columns]
    return df.agg(F.array(*present).alias("p")).select(F.explode("p").alias("f")).select("f.*")


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_before, n_after, n_removed, frac_removed)."""
    counts = before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))  # one row each
    removed = F.col("n_before") - F.col("n_after")
    return counts.select("n_before", "n_after", removed.alias("n_removed"), F.when(F.col("n_before") > 0, removed / F.col("n_before")).alias("frac_removed"))
