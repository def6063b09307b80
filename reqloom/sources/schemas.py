"""Fixed schemas of the engine's tables, as Spark DDL. Column names and order are part of the file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Metadata fields that are kept, with their types.
METADATA = (
    "id STRING, webpage_url STRING, title STRING, description STRING, channel STRING, channel_id STRING, uploader STRING, "
    "uploader_id STRING, upload_date STRING, timestamp BIGINT, duration BIGINT, duration_string STRING, view_count BIGINT, "
    "like_count BIGINT, comment_count BIGINT, categories ARRAY<STRING>, tags ARRAY<STRING>, language STRING, "
    "availability STRING, live_status STRING, thumbnail STRING"
)
#: Metadata fields that repeat fields of the record.
REPEATED_METADATA = ("title", "duration", "duration_string", "webpage_url")
RAW = f"url STRING, titulo STRING, duracao STRING, transcricao STRING, fonte STRING, youtube_metadata STRUCT<{METADATA}>, metadata_status STRING, metadata_error STRING"
DOCUMENT = (
    "post_id STRING, message STRING, title STRING, channel STRING, upload_date STRING, year INT, view_count BIGINT, like_count BIGINT, "
    "comment_count BIGINT, duration STRING, source STRING, language_meta STRING, product_category STRING, title_has_review BOOLEAN"
)
SENTENCE = (
    "sent_id STRING, post_id STRING, sent_idx INT, sentence STRING, context STRING, message_raw STRING, message_punctuated STRING, "
    "punctuation_restored BOOLEAN, n_words INT, is_fragment BOOLEAN, is_dup_exact BOOLEAN, upload_date STRING, year INT, "
    "channel STRING, source STRING, product_category STRING"
)


def columns_of(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).fieldNames()


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The schema's columns in order and type; those that ``df`` lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)))
