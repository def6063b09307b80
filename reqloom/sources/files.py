"""Reading and writing: JSON arrays, CSV folders, lookups, settings, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.contracts import ContractError
from reqloom.sources import schemas


def parse_json_array(df: DataFrame, column: str, ddl: str = schemas.RAW) -> DataFrame:
    """The records of JSON arrays held as text, one row each.

    A byte-order mark and anything else before the first ``[`` is skipped.
    """
    start = F.instr(column, "[")
    body = F.when(start > 0, F.substring(F.col(column), start, F.length(column)))
    return df.select(F.inline(F.from_json(body, f"ARRAY<STRUCT<{ddl}>>")))


def read_json_array(spark: SparkSession, path: str, ddl: str = schemas.RAW, strict: bool = False) -> DataFrame:
    """Records of JSON array files. ``strict``: nothing but an array of objects is taken (malformed input is an error).

    A file is one record of the reader and so is parsed by one task; many
    files are read in parallel. For very large single files use JSON lines.
    """
    if strict:
        return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return parse_json_array(spark.read.text(path, wholetext=True), "value", ddl)


def read_csv_folder(spark: SparkSession, path: str, ddl: str | None = None, sep: str = ",", encoding: str = "UTF-8", columns: Sequence[str] | None = None) -> DataFrame:
    """All CSV files of a folder as one table, with ``row_file`` and ``row_order`` to restore file and row order.

    ``columns``: only these, as far as they are there; the scan parses no others.
    Only empty cells are null: texts such as ``NA`` stay texts.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("sep", sep).option("encoding", encoding)
    reader = reader.option("quote", '"').option("escape", '"').option("nullValue", "").option("pathGlobFilter", "*.csv")
    df = (reader.schema(ddl) if ddl else reader).csv(path)
    if columns is not None:
        df = df.select(*(c for c in columns if c in df.columns))
    return df.withColumns({"row_file": F.col("_metadata.file_path"), "row_order": F.monotonically_increasing_id()})


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; ``bom`` puts a byte-order mark before the first column's name."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], f"﻿{df.columns[0]}")
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(post_id, product_category) from a hand-kept CSV; empty if the file is missing. Of repeated ids the last line counts."""
    empty = spark.createDataFrame([], "post_id STRING, product_category STRING")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return empty
    rows = spark.read.schema("post_id STRING, product_category STRING").option("header", True).csv(path).withColumn("at", F.monotonically_increasing_id())
    last = rows.where("post_id is not null and post_id <> ''").groupBy("post_id").agg(F.max_by("product_category", "at").alias("product_category"))
    return empty.unionByName(last)


def load_settings(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def settings_section(settings: Mapping, *keys: str) -> Mapping:
    """A nested section; ContractError names the first key that's missing."""
    here: Mapping = settings
    for key in keys:
        if not isinstance(here, Mapping) or key not in here:
            raise ContractError(f"settings have no {'.'.join(keys)}")
        here = here[key]
    return here


def drop_nested(df: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """``column`` (a struct) without ``fields``; those it lacks don't matter."""
    have = {f.name for f in df.schema[column].dataType.fields}
    gone = [f for f in fields if f in have]
    return df.withColumn(column, F.col(column).dropFields(*gone)) if gone else df
