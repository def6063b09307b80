"""Raw records to the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.contracts import require_unique
from reqloom.functions import text as T
from reqloom.sources import schemas
from reqloom.sources.files import drop_nested


def drop_repeated_metadata(records: DataFrame) -> DataFrame:
    """Metadata without the fields that repeat fields of the record."""
    return drop_nested(records, "youtube_metadata", schemas.REPEATED_METADATA)


def metadata_json(records: DataFrame) -> DataFrame:
    """Metadata as JSON with the known fields that aren't null."""
    return records.withColumn("metadata_json", F.to_json("youtube_metadata", {"ignoreNullFields": "true"}))


def merge_metadata(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Records with the metadata (url, youtube_metadata) of their url; status ``ok`` and no error where there is some."""
    fresh = metadata.select("url", F.col("youtube_metadata").alias("fresh"))
    joined = records.join(fresh, "url", "left")
    found = F.col("fresh").isNotNull()
    return joined.withColumns(
        {
            "youtube_metadata": F.coalesce("fresh", "youtube_metadata"),
            "metadata_status": F.when(found, F.lit("ok")).otherwise(F.col("metadata_status")),
            "metadata_error": F.when(~found, F.col("metadata_error")),
        }
    ).select(*records.columns)


def build_documents(records: DataFrame, overrides: DataFrame | None = None, check: bool = True) -> DataFrame:
    """The document table. Records without a transcript or an id are left out; repeated ids are an error."""
    meta = lambda name: F.col(f"youtube_metadata.{name}")
    message = F.regexp_replace(F.coalesce("transcricao", F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    kept = records.withColumn("message", message).where((F.col("message") != "") & (F.coalesce(meta("id"), F.lit("")) != ""))
    title = F.coalesce("titulo", F.lit(""))
    rows = kept.select(
        meta("id").alias("post_id"), "message", title.alias("title"), meta("channel").alias("channel"), T.iso_date(meta("upload_date")).alias("upload_date"),
        meta("view_count").alias("view_count"), meta("like_count").alias("like_count"), meta("comment_count").alias("comment_count"),
        F.col("duracao").alias("duration"), F.col("fonte").alias("source"), meta("language").alias("language_meta"),
    )
    rows = rows.withColumn("year", T.iso_year(F.col("upload_date"))).withColumn("title_has_review", T.title_has_review(F.col("title")))
    rows = categorise(rows, overrides)
    out = schemas.conform(rows, schemas.DOCUMENT)
    return require_unique(out, ["post_id"], "documents") if check else out


def categorise(rows: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds ``product_category``: the hand-kept one of ``overrides`` unless empty, else by title."""
    detected = T.product_category(F.col("title"))
    if overrides is None:
        return rows.withColumn("product_category", detected)
    own = overrides.select(F.col("post_id").alias("override_id"), F.col("product_category").alias("override"))
    joined = rows.join(own, rows["post_id"] == own["override_id"], "left")
    return joined.withColumn("product_category", F.coalesce(F.nullif("override", F.lit("")), detected)).drop("override_id", "override")
