"""New sentences scored as they come: a file stream, a cache, exactly one score for each distinct text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reqloom.operators import sentiment
from reqloom.sources.cache import KeyedCache


def read_sentences(spark: SparkSession, path: str, ddl: str = "sent_id STRING, sentence STRING") -> DataFrame:
    """A stream of Parquet files of sentences."""
    return spark.readStream.schema(ddl).parquet(path)


def score_stream(stream: DataFrame, output: str, cache_path: str, checkpoint: str, classifier: sentiment.Classifier | None = None) -> StreamingQuery:
    """Appends the scores of each micro-batch to ``output``; runs until what is there is done.

    A batch's folder is named by its number, so a batch that runs again after a
    failure replaces its own output. Texts that an earlier batch had come from
    the cache.
    """

    def handle(batch: DataFrame, number: int) -> None:
        cache = KeyedCache(batch.sparkSession, cache_path, sentiment.SCORES)
        scored = sentiment.classify(batch, classifier, cache, number)
        scored.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
