"""Shared pieces of the training-data operators: scratch tables (of ``reqloom.scratch``), shipping, small helpers."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.scratch import clean_up, delete_path, scratch_path, shared_dir, written, written_at
from reqloom.shipping import ship

__all__ = ["ascii_lower", "clean_up", "crc_mod", "delete_path", "free_shuffles", "fresh_name", "if_few", "scratch_path", "shared_dir", "ship", "slices", "table", "written", "written_at"]

#: Rows of a few words each that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def if_few(df: DataFrame) -> DataFrame:
    """A stored table of small rows, to be broadcast if it has at most BROADCAST_ROWS; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs: it follows the collectors, and works beside the driver."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def slices(batch: pa.RecordBatch, text_at: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have about ``most_bytes`` together; a longer text has a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(sizes.searchsorted((sizes[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


def ascii_lower(column):
    """Lower-case A-Z alone. ``lower`` does that for pure ASCII text; other text is translated."""
    text = F.col(column) if isinstance(column, str) else column
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def fresh_name(columns: list[str], base: str) -> str:
    """``base``, or a variation that no column of the caller's table has (names compare case-insensitively)."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name
