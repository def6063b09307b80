"""Document cleaning, deduplication, filters and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqloom.contracts import require, require_unique
from reqloom.functions import text as T
from reqloom.functions.plan import once
from reqloom.operators.ordering import numbered


def reshape(df: DataFrame, rename: Mapping[str, str] = {}, drop: Sequence[str] = (), constants: Mapping[str, object] = {}) -> DataFrame:  # noqa: B006
    """Renames, drops what there is to drop, and adds constants that are absent."""
    df = df.withColumnsRenamed(dict(rename)).drop(*drop)
    return df.withColumns({k: F.lit(v) for k, v in constants.items() if k not in df.columns})


def date_category(df: DataFrame, column: str, pattern: str = "yyyy-MM", into: str = "category") -> DataFrame:
    """A category from a date's format; null where it can't be read."""
    return df.withColumn(into, F.date_format(F.try_to_timestamp(F.col(column).cast("string")), pattern))


def not_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.regexp_replace(F.col(column), T.SPACE, "") != "")


def keep_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """Of rows with equal ``text`` the one with the least ``order`` (unique).

    Texts are grouped by digest and a minimum, which partial aggregation reduces
    before the shuffle, so no task gathers the copies of a text; the rows
    themselves are joined back once.
    """
    digest = F.sha2(F.col(text), 256)
    first = df.groupBy(digest.alias("of_digest")).agg(F.min(order).alias("of_order")).select("of_order")
    return df.join(first, F.col(order) == F.col("of_order"), "left_semi")


def language_is(df: DataFrame, column: Column, language: str) -> DataFrame:
    """Rows of one language; unknown ones go."""
    return df.where(column == language)


def long_enough(df: DataFrame, column: str, chars: int, words: int) -> DataFrame:
    return df.where((F.length(column) >= chars) & (T.word_count(F.col(column)) >= words))


def with_ids(df: DataFrame, order: str, column: str | None = None) -> DataFrame:
    """``post_id`` from a column (text, no nulls, unique) or numbered from 0 in order.

    ``order`` must be unique, so that the numbers are the same at any partitioning.
    """
    if column is not None:
        out = df.withColumn("post_id", F.col(column).cast("string"))
        return require_unique(require(out, {"post_id is there": F.col("post_id").isNotNull()}), ["post_id"])
    placed = numbered(df, [F.col(order)], "post_number")
    return placed.withColumn("post_id", F.format_string("post_%04d", F.col("post_number") - 1)).drop("post_number")


def first_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, *(c for c in df.columns if c not in columns))


def stratified_sample(df: DataFrame, category: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows a category, by a hash of seed and key: the same rows at any partitioning.

    A category may be most of the table, so each partition of a salted shuffle
    first keeps its own ``n``; only these meet.
    """
    ranked = df.withColumn("sample_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(64))
    local = Window.partitionBy(category, salt).orderBy("sample_hash", key)
    total = Window.partitionBy(category).orderBy("sample_hash", key)
    some = ranked.withColumn("sample_rank", F.row_number().over(local)).where(F.col("sample_rank") <= n)
    some = some.withColumn("sample_rank", F.row_number().over(total)).where(F.col("sample_rank") <= n)
    return some.drop("sample_hash", "sample_rank")


def preprocess(
    df: DataFrame, order: str, text: str = "message", language: Column | None = None, keep_language: str | None = "en",
    chars: int = 500, words: int = 100, unescape: bool = True,
) -> DataFrame:
    """Rows with text, the first of equal raw texts, cleaned, of one language and long enough.

    ``message_raw`` is the text before cleaning. Copies are told by raw text, so
    texts that only cleaning makes equal stay. ``language``: an expression over
    the cleaned table; by default the function-word vote on the cleaned text.
    """
    df = keep_first(not_empty(df, text), text, order)
    df = once(df.withColumn("message_raw", F.col(text)), text, T.clean_text(F.col(text), unescape))
    if keep_language is not None:
        df = language_is(df, T.detect_language(F.col(text)) if language is None else language, keep_language)
    return long_enough(df, text, chars, words)
