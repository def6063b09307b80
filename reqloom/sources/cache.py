"""A keyed table that keeps what was computed: read by join, extended by append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedCache:
    """Rows (key, <value columns>, written): the latest row of a key counts."""

    def __init__(self, spark: SparkSession, path: str, values: str):
        self.spark, self.path, self.ddl = spark, path, f"key STRING, {values}, written BIGINT"

    def _exists(self) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.ddl).drop("written")
        rows = self.spark.read.schema(self.ddl).parquet(self.path)
        values = [c for c in rows.columns if c not in ("key", "written")]
        newest = rows.groupBy("key").agg(F.max(F.struct("written", *values)).alias("row"))  # one row's values, also where versions tie
        return newest.select("key", *(F.col("row")[c].alias(c) for c in values))

    def missing(self, df: DataFrame, key: str = "key") -> DataFrame:
        """The rows of ``df`` whose key isn't kept."""
        return df.join(self.read().select(F.col("key").alias(key)), key, "left_anti")

    def put(self, df: DataFrame, version: int) -> None:
        """Appends rows; of one key the row with the largest version counts."""
        df.withColumn("written", F.lit(version).cast("bigint")).write.mode("append").parquet(self.path)
