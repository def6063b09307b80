"""Scratch tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names it. Only a local session without that setting
(tests, a notebook) gets a temporary folder of its own; on a cluster its lack is
an error, as executors don't see each other's folders.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; an own temporary one only in a local session where none is set."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="reqloom-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/reqloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application. Results that weren't written elsewhere can't be read afterwards."""
    delete_path(spark, own_folder(spark))


def written_at(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """As :func:`written`, with the path, for those who delete it when it is used up."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: a durable cut of its lineage, and of the plans that use it."""
    return written_at(df, name, partition_by)[0]
