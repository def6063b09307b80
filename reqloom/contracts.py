"""Table contracts. Checks of one table share one aggregation, so one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table isn't as it must be."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """``df``, if its keys are unique; the error names up to five that aren't."""
    found = duplicates(df, keys).orderBy(*keys).limit(5).collect()
    if found:
        raise ContractError(f"{name}: duplicate {list(keys)}: {[tuple(r)[:-1] for r in found]}")
    return df


def require(df: DataFrame, rules: Mapping[str, Column], name: str = "table") -> DataFrame:
    """``df``, if no row breaks a rule (a condition that must hold; null counts as broken)."""
    broken = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(str(i)) for i, rule in enumerate(rules.values()))).first()
    bad = {rule: n for rule, n in zip(rules, broken, strict=True) if n}
    if bad:
        raise ContractError(f"{name}: {bad}")
    return df


def require_count(df: DataFrame, least: int, most: int | None = None, name: str = "table") -> DataFrame:
    n = df.count()
    if n < least or (most is not None and n > most) or (most is None and n != least):
        raise ContractError(f"{name}: {n} rows")
    return df


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that either table hasn't exactly once, with how often each has them (in_a, in_b)."""
    counts = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    return counts.groupBy(*keys).agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b")).where("in_a <> 1 or in_b <> 1")


def require_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str = "tables") -> None:
    """Both have the same keys, each once."""
    off = key_differences(a, b, keys).limit(5).collect()
    if off:
        raise ContractError(f"{name}: keys differ: {[tuple(r) for r in off]}")
